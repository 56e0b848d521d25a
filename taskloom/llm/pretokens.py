"""Pre-tokens of a text and the pieces of one pre-token, for a tokenizer file.

Files of the ``tokenizers`` library are split by their own normaliser and pre-tokeniser. For the common
rule set in ``_RULES`` the same split is done by one compiled expression, which is several times faster;
scripts beyond the Latin ones are still normalised by the library. Files of ``sentencepiece`` split at
white space only, so there the whole text is one unit.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from .words import Words

# The rule set that the fast path stands for.
_RULES = (
    ["NFC", "Replace", "Lowercase"],
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Kinds of bytes: 0 letter, 1 digit, 2 any other of ASCII, 3 outside ASCII or an apostrophe, whose rules need the whole word.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[48:58] = 1
_KIND[128:] = _KIND[39] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The characters that stand for bytes without a sign of their own in byte-level vocabularies.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


class Remembered(dict):
    """Values of a function by key; when there are too many, those not asked for since the last time are forgotten."""

    def __init__(self, function, held: int):
        super().__init__()
        self.function, self.held, self.earlier = function, held // 2, {}

    def __missing__(self, key):
        value = self.earlier.get(key)
        value = self[key] = self.function(key) if value is None else value
        return value

    def of(self, keys: list) -> list:
        if len(self) > self.held:
            self.earlier = dict(self)
            self.clear()
        return list(map(self.__getitem__, keys))


class PreTokens:
    """Splits texts; made on executors, from the path of a file that each machine has."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        special = [t["content"] for t in rules["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.special_bytes = [x.encode() for x in special]
        plain = all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
            for t in rules["added_tokens"]
        )
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = (
            plain
            and [s["type"] for s in steps] == _RULES[0]
            and len(splits) == 2
            and splits[0].get("pattern", {}).get("Regex") == _RULES[1]
            and splits[1]["type"] == "ByteLevel"
            and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
            and rules.get("post_processor") is None
        )
        self.letters_are_one = not any(x.isalpha() for x in special)
        if not self.fast:
            raise ValueError("this file's pre-tokeniser is not supported")
        self.find = regex.compile(
            "'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^" + _SPACE + "\\p{L}\\p{N}]+"
        ).findall

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Below U+0250 the library and Python agree on case; the sigma rule lies beyond.
        if max(text) < "ɐ" and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; special strings of the file stand for themselves."""
        if self.special is None or not self.special.search(text):
            return self.find(self._normal(text))
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out.extend(self.find(self._normal(part)))
        return out

    def has_special(self, text: bytes) -> bool:
        return any(x in text for x in self.special_bytes)

    def units(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Units of texts without special strings, and the number of each text's first one (and the end).

        A unit is a pre-token of a word in ASCII, its letters lower-cased, or a word as it is that
        has other characters or an apostrophe.
        """
        words = Words(texts)
        size = words.end - words.start
        first = np.concatenate(([0], np.cumsum(size)))
        body = words.body()
        kind = _KIND[body]
        odd = np.logical_or.reduceat(kind == 3, first[:-1]) if len(size) else np.zeros(0, dtype=bool)
        whole = np.repeat(odd, size)
        cut = np.ones(len(body), dtype=bool)
        cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 1)) & ~whole[1:]
        cut[first[:-1]] = True
        body = np.where(whole, body, _LOWER[body])
        starts = np.append(np.flatnonzero(cut), len(body))
        buffers = [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(body)]
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, buffers)
        return units.dictionary_encode(), np.searchsorted(starts, first[words.first])

    def word(self, word: bytes, pieces: Remembered) -> bytes:
        """Packed ids of what stands between white space; ``pieces`` has those of pre-tokens."""
        if self.letters_are_one and word.isalpha():
            return array("I", self.ids(word.lower().decode())).tobytes()
        return b"".join(pieces.of(self.split(word.decode())))

    def ids(self, pretoken: str) -> list[int]:
        """The pieces of one pre-token."""
        if pretoken in self.special_ids:
            return [self.special_ids[pretoken]]
        if not (pretoken.isascii() and pretoken.isprintable()):
            pretoken = pretoken.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return [t.id for t in self.library.model.tokenize(pretoken)]
