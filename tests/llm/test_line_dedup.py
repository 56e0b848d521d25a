import string
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.conftest import EDGES, documents_frame

from taskloom.llm import line_dedup
from taskloom.llm.line_dedup import drop_repeated_lines, keep_bitmaps

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
HOT = "This Line is in nearly every document of the table, twice in some"


def brute(rows, least_documents=5, least_chars=40):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in lines] for _, lines in split]
    holders = defaultdict(set)
    for (d, _), ks in zip(split, keys):
        for k in ks:
            if len(k) >= least_chars:
                holders[k].add(d)
    out = []
    for (d, lines), ks in zip(split, keys):
        kept = []
        for line, k in zip(lines, ks):
            ids = holders.get(k, ())
            keeper = max((i for i in ids if i is not None), default=None)
            if len(ids) < least_documents or d == keeper:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows():
    line = "0123456789 a line with a good forty code points"
    forty = "é" * 40
    out = [(i, f"own words of {i}\n  {line}\t\n{forty}\nlast") for i in range(4)]
    out += [(4, f"{line.upper()}\n{line}\nx{forty[1:]}"), (5, f"{line}\r\n\n{line}")]
    out += [(6, "é" * 39), (7, forty), (8, None), (9, ""), (10, "\n\n"), (None, forty), (None, f"{forty}\n{line}")]
    out += [(i, f"{HOT}\n{i} one\n{HOT.lower()}  " if i % 3 else HOT) for i in range(100, 460)]
    out += [(459, HOT), (100, HOT), (100, HOT)]
    many = "\n".join(f"line number {i} of a very long document with many lines" for i in range(5000))
    out += [(i, many) for i in (700, 701, 702, 703, 704)] + [(705, many + "\ntail"), (706, "\n" * 20_000 + many)]
    return out + [(d, t) for d, t in EDGES]


def got(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def test_equals_brute_force_with_and_without_hot_lines(spark, monkeypatch):
    given = rows()
    frame = documents_frame(spark, given).repartition(5)
    expected = brute(given)
    assert got(drop_repeated_lines(frame)) == expected
    monkeypatch.setattr(line_dedup, "HOT_PARTITIONS", 0)
    named = line_dedup._hot_hashes(line_dedup._long_lines(frame, 40))
    assert len(named) == 1
    monkeypatch.setattr(line_dedup, "_hot_hashes", lambda lines: [])
    assert got(drop_repeated_lines(frame)) == expected
    monkeypatch.setattr(
        line_dedup, "_hot_hashes", lambda lines: [r.h1 for r in lines.select("h1").distinct().limit(1000).collect()]
    )
    assert got(drop_repeated_lines(frame)) == expected


def test_bitmaps_hold_the_dropped_lines(spark):
    given = [(i, "\n".join(["short"] * 70 + [HOT] + ["short"] * 10)) for i in range(6)]
    maps = keep_bitmaps(documents_frame(spark, given)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in maps[:5]] == [(i, 81, 1, [0, 1 << 6]) for i in range(5)]
    assert (maps[5].n_dropped, maps[5].dropped) == (0, [])


def test_empty_table(spark, empty):
    assert drop_repeated_lines(empty).collect() == []
    assert keep_bitmaps(empty).schema["dropped"].dataType.simpleString() == "array<bigint>"


def test_other_limits(spark):
    frame = documents_frame(spark, [(1, "ab\nab"), (2, "AB\nc")])
    out = drop_repeated_lines(frame, least_documents=2, least_chars=2).orderBy("doc_id")
    assert [(r.n_dropped, r.kept_text) for r in out.collect()] == [(2, ""), (0, "AB\nc")]
    assert out.filter(F.col("kept_text").isNull()).count() == 0
