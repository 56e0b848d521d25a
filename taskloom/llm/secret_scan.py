"""Secret scans: keyword automaton, anchored expressions at its hits, then checksums.

One Aho-Corasick pass over a whole text finds every keyword. The expression of a kind is tried only
where one of its keywords begins, so the cost follows the text's length and not the number of kinds.
Runs of hexadecimal digits have no keyword; one search looks for them. Kinds whose values carry a
checksum are reported only if it holds, which makes them free of chance hits.

The work is one pass over the rows: no shuffle, no state, any row can be redone alone.
"""

from __future__ import annotations

import binascii
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of kinds decides between spans with the same start.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "xprv")

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)

# Alphabets of the checked formats.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
_PATTERNS = {
    "assign": re.compile(
        rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.IGNORECASE,
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "xprv": re.compile(rb"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])"),
}
_HEX = re.compile(rb"[0-9a-f]{24,}")


def crc_holds(value: bytes) -> bool:
    """30 characters and their CRC-32 in six base-62 digits."""
    number, digits = binascii.crc32(value[:-6]), []
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits)) == value[-6:]


def base58_holds(value: bytes) -> bool:
    """Base 58 of 78 bytes and the first four of their double SHA-256."""
    number = 0
    for c in value:
        number = number * 58 + BASE58.index(c)
    if number >> (82 * 8):
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _valid(kind: str, match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    return base58_holds(match[1]) if kind == "xprv" else crc_holds(match[1])


def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find_spans(text: str | None, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start and then kind.

    Within a kind, matches are leftmost and do not overlap; those that fail their length or
    checksum still take their place.
    """
    if not text:
        return []
    data = text.encode()
    # Only A-Z change, so positions stay; one character per byte for the automaton.
    lowered = data.lower().decode("latin-1")
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in automaton.iter(lowered):
        hits.setdefault(kind, []).append(last + 1 - size)
    found = [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(data)]
    for kind, starts in hits.items():
        pattern, free = _PATTERNS[kind], 0
        for start in sorted(starts):
            if start >= free and (m := pattern.match(data, start)):
                free = m.end()
                if _valid(kind, m):
                    found.append((start, KINDS.index(kind), free))
    found.sort()
    if len(data) == len(text):
        return [(KINDS[k], s, e) for s, k, e in found]
    spans, at, points = [], 0, 0
    for s, k, e in found:
        points += len(data[at:s].decode())
        at = s
        spans.append((KINDS[k], points, points + len(data[s:e].decode())))
    return spans


def _automata():
    """The automaton, compiled once in each task."""
    kept: list = []

    def get():
        if not kept:
            kept.append(keyword_automaton())
        return kept[0]

    return get


def secret_spans(text):
    """Column of the spans of a text: an array of (kind, start, end)."""
    automaton = _automata()

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton())]
                for t in texts
            ]
        )

    return spans(text)


def scan_secrets(documents: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """Add the secret spans of each row's whole text as ``into``.

    Null and empty texts have no spans. Rows are never merged, so ties and repeated rows keep their
    own result; other columns pass through whatever their names or nulls.
    """
    return documents.withColumn(into, secret_spans(F.col(text)))


def redact_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replace each secret in the texts by ``[kind]``; overlapping spans become one.

    The first kind of an overlapping group names it. A null text stays null.
    """
    automaton = _automata()

    @F.pandas_udf(T.StringType())
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = find_spans(t, automaton())
            if not spans:
                out.append(t)
                continue
            parts, at, i = [], 0, 0
            while i < len(spans):
                kind, start, end = spans[i]
                i += 1
                while i < len(spans) and spans[i][1] < end:
                    end = max(end, spans[i][2])
                    i += 1
                parts += [t[at:start], f"[{kind}]"]
                at = end
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return documents.withColumn(text, cleaned(F.col(text)))
