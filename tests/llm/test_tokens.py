import random
from collections import defaultdict

import numpy as np
import pytest
from taskloom.llm import token_counts
from taskloom.llm.packing import pack, pack_documents, sequence_lengths
from taskloom.llm.pretokens import PreTokens, vocabulary_path
from taskloom.llm.token_counts import _frequent, count_tokens

from .conftest import EDGES, documents_frame

PATH = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


TRICKY = [
    "Don't they'll WE'RE it's 'S <|endoftext|>x <|startoftext|> <|ENDOFTEXT|> <|endof text|>",
    "a b c　d\u0085e\x1cf\x1dg",
    "é café ﬁ ½ ² Ⅷ ٣ 12345",
    "ΣΑΣ ὈΔΥΣΣΕΎΣ İI ıi ẞß Ω K",
    "'''s ''t .'re _x_ $%^&*()__+ !!!!",
    "日本語テキスト 한국어 עברית नमस्ते 🎉👩‍👩‍👧",
]


def test_split_equals_library(library):
    splitter = PreTokens(PATH)
    random.seed(5)
    letters = list("abZ '\"s.t!é́ßΣσςİ1²½ \n\t 日<|>endoftext_#") + ["<|endoftext|>"]
    texts = TRICKY + ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        words = [i for w in text.encode().split() for p in splitter.split(w.decode()) for i in splitter.ids(p)]
        assert words == ids(library, text), text


def test_counts_on_edges(spark, edges, empty, library):
    rows = count_tokens(edges, PATH, frequent=20).collect()
    want = sorted((str(i), len((t or "").encode()), len(ids(library, t))) for i, t in EDGES)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert count_tokens(empty, PATH).collect() == []


def test_nothing_left_after_the_last_flush(spark, library, monkeypatch):
    """More distinct words than a task holds, flushed by its very last texts."""
    monkeypatch.setattr(token_counts, "HELD", 5)
    texts = ["one two three four five six seven", "seven eight nine ten eleven twelve"]
    rows = count_tokens(documents_frame(spark, list(enumerate(texts))).coalesce(1), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(ids(library, t)) for i, t in enumerate(texts)}


def test_counts_do_not_depend_on_the_frequent_table(spark, library):
    frame = documents_frame(spark, list(enumerate(TRICKY * 3)))
    for frequent in (0, 5, 1000):
        got = {r.doc_id: r.n_tokens for r in count_tokens(frame, PATH, frequent=frequent).collect()}
        assert got == {i: len(ids(library, t)) for i, t in enumerate(TRICKY * 3)}


def test_room_is_exact():
    for total in (0, 1, 4095, 4096, 4097, 10_000, 123_457):
        rooms = sequence_lengths(total, 4096)
        assert sum(rooms) == total and all(r == 4096 or r & (r - 1) == 0 for r in rooms)


def test_pack_covers_and_balances():
    random.seed(1)
    lengths = [random.choice([1, 3, 60, 700, 5000, 9000]) for _ in range(400)]
    pieces = pack(lengths, 4096)
    rooms = sequence_lengths(sum(lengths), 4096)
    seen, filled = defaultdict(list), defaultdict(list)
    for d, start, n, s, offset in pieces:
        seen[d].append((start, n))
        filled[s].append((offset, n))
    for d, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == length
    for s, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == rooms[s]
    whole = sum(len(seen[d]) == 1 for d, n in enumerate(lengths) if n <= 4096)
    assert whole > 0.9 * sum(n <= 4096 for n in lengths)


def test_packed_ids_on_edges(spark, edges, empty, library):
    rows = pack_documents(edges, PATH, 2, group_tokens=50_000).collect()
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
        assert len(r.ids) == 4 * r.length
    for parts in sequences.values():
        assert sum(n for _, n, _ in parts) == parts[0][2] <= 4096
    want = defaultdict(list)
    for i, t in EDGES:
        want[i] += ids(library, t) + [2]
    for i, tokens in want.items():
        assert sorted(x for _, _, p in got[i] for x in p) == sorted(tokens)
    one = [x for _, _, p in sorted(got[5]) for x in p]
    assert one == ids(library, EDGES[4][1]) + [2]
    assert pack_documents(empty, PATH, 2).collect() == []


def test_frequent_pretokens_beyond_the_old_bin(spark):
    """More pre-tokens than the limit occur very often; the most frequent of them are still sent."""
    rows = [(f"p{i}", 5000 + 40 * i, 1 + i % 3) for i in range(1000)] + [("x" * 100, 10**9, 2), ("rare", 3, 1)]
    frame = spark.createDataFrame(rows, "pretoken string, n long, pieces long")
    for limit in (100, 500, 5000):
        sent = _frequent(frame, limit)
        assert len(sent) <= limit and len(sent) >= min(limit * 0.8, 1001)
        assert set(sent) >= {f"p{i}" for i in range(1000 - int(len(sent) * 0.9), 1000)} and "x" * 100 not in sent
    assert _frequent(frame.limit(0), 10) == {}


def test_units_of_many_texts_equal_library(library):
    splitter = PreTokens(PATH)
    random.seed(8)
    letters = list("abHZ '\"s.t!é̱́ßΣσςİK1²½ \n\t 日<|>_#\x1c\x00")
    texts = ["", " \n", *("".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(2000)), ""]
    units, first = splitter.units([t.encode() for t in texts])
    words = units.to_pylist()
    assert len(first) == len(texts) + 1 and len(set(words)) == len(units.dictionary)
    for text, x, y in zip(texts, first[:-1], first[1:]):
        found = [i for w in words[x:y] for p in splitter.split(w.decode()) for i in splitter.ids(p)]
        assert found == ids(library, text), text
    assert len(splitter.units([b"", b" "])[0]) == 0


def test_packed_ids_equal_library(spark, library):
    texts = [*TRICKY, "", None, "İ̱ H̱ K, K. k k's K12", " ".join(f"Word{i}, it's <|endoftext|>" for i in range(2000))]
    held = defaultdict(dict)
    for r in pack_documents(documents_frame(spark, list(enumerate(texts))).coalesce(1), PATH, 2).collect():
        held[r.doc_id][r.start] = np.frombuffer(r.ids, dtype="<u4").tolist()
    for i, text in enumerate(texts):
        assert sum((held[i][s] for s in sorted(held[i])), []) == [*ids(library, text), 2], text
