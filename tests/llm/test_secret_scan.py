import binascii
import hashlib
import random
import re

from taskloom.llm.secret_scan import (
    BASE58,
    BASE62,
    find_spans,
    keyword_automaton,
    redact_secrets,
    scan_secrets,
)

from .conftest import EDGES, documents_frame

PATTERNS = {
    "assign": (re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    rank = list(PATTERNS)
    out = []
    for kind, (pattern, group, least) in PATTERNS.items():
        out += [(m.start(), rank.index(kind), m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def github(body):
    number, tail = binascii.crc32(body.encode()), ""
    for _ in range(6):
        number, d = divmod(number, 62)
        tail = chr(BASE62[d]) + tail
    return f"ghp_{body}{tail}"


def xprv():
    raw = bytes.fromhex("0488ade4") + bytes(74)
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, d = divmod(number, 58)
        out = chr(BASE58[d]) + out
    return out


def test_base_spans_equal_brute_force():
    random.seed(3)
    bits = ["password", "PassWD", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789",
            "AKIA", "ABCDEFGH12345678", "é", "日", "\n", "ſecret", "K", "+/_.=-", "f" * 23, "f" * 24, "akia"]
    automaton = keyword_automaton()
    for _ in range(3000):
        text = "".join(random.choices(bits, k=random.randint(0, 14)))
        base = [s for s in find_spans(text, automaton) if s[0] in PATTERNS]
        assert base == brute(text), text


def test_checksums_decide():
    automaton = keyword_automaton()
    good = github("a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    kinds = lambda t: [k for k, _, _ in find_spans(t, automaton)]
    assert kinds(f"é {good}.") == ["github"]
    assert find_spans(f"é {good}.", automaton)[0][1:] == (2, 2 + len(good))
    assert kinds(good[:-1] + ("a" if good[-1] != "a" else "b")) == []
    assert len(xprv()) == 111 and kinds(f"key {xprv()}") == ["xprv"]
    assert kinds(f"key {xprv()[:-1]}{'a' if xprv()[-1] == 'b' else 'b'}") == []


def test_edge_rows_keep_their_place(spark, edges, empty):
    rows = scan_secrets(edges, into="found").collect()
    assert len(rows) == len(EDGES) and all(r.spans == "spans of row" for r in rows)
    assert all(r.found == [] for r in rows)
    assert scan_secrets(empty, into="found").collect() == []


def test_redaction(spark):
    text = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"; rest'
    frame = documents_frame(spark, [(1, text), (2, None), (3, "clean")])
    got = {r.doc_id: r.text for r in redact_secrets(frame).collect()}
    assert got == {1: 'é [assign]"; rest', 2: None, 3: "clean"}
