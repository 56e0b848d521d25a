import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from taskloom.llm import hard_negatives, vector_codes
from taskloom.llm.hard_negatives import mine_hard_negatives, reaching
from taskloom.llm.vector_codes import compress_vectors, digest, nearest, transform, with_label_errors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, block string, v string, code string, score int, bucket int"
SIZE = 12


def embeddings(n, seed=3):
    random.seed(seed)
    centres = [[random.gauss(0, 0.2) for _ in range(SIZE)] for _ in range(6)]
    rows = []
    for i in range(n):
        base = centres[i % 6]
        # A third of all rows has one label; every ninth vector is met again.
        vector = rows[i - 9][1] if i % 9 == 8 and i > 9 else [float(np.float32(x + random.gauss(0, 0.1))) for x in base]
        rows.append((i - 20, vector, 0 if i % 3 == 0 else i % 5))
    odd = [(None, rows[3][1], 1), (900, None, 1), (950, rows[4][1], None), (1000, [0.1, NAN], 1), (1050, [INF] * SIZE, 2)]
    odd += [(1100, [None] * SIZE, 1), (1150, [0.5, -0.5], 1), (1151, [], 2), (1200, [0.0] * SIZE, 0)]
    return rows + odd


def table(spark, rows):
    return spark.createDataFrame([(*r, "b", "v", "c", 7, 8) for r in rows], SCHEMA).repartition(3)


def integers(vector, scale):
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    return [int(np.floor(float(np.float32(x)) * scale)) for x in vector]


def brute_negatives(rows, step):
    kept = {}
    for i, v, label in rows:
        v = integers(v, 256)
        if i is not None and v is not None and label is not None:
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    out = []
    for a, (label, x) in kept.items():
        if a % step:
            continue
        scores = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in kept.items() if b != a}
        ranked = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in ranked if kept[b][0] == label][:5]:
            fits = [
                b for b in ranked if kept[b][0] != label and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]
            ]
            out += [(a, p, k, b, scores[p], scores[b]) for k, b in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(frame, step=10):
    found = mine_hard_negatives(frame, F.col("vec_id") % step == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.select(*columns).collect())


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = embeddings(260)
    rows += [rows[30], rows[31], (rows[30][0], rows[40][1], 0)]
    expected = brute_negatives(rows, 10)
    assert len(expected) > 200
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    assert mined(table(spark, rows)) == expected


def test_few_rows_or_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.0], 2), (3, [-1.0, 0.0], 1), (10, [-0.2], None)]
    assert mined(table(spark, rows)) == brute_negatives(rows, 10) == [(0, 1, 1, 2, 58880, 32768)]
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [0.5], 1)])) == []


@pytest.mark.parametrize("scale", [3, 1000, 2**24])
def test_threshold_join_misses_nothing(scale):
    random = np.random.default_rng(scale)
    q = random.integers(-scale, scale, (20, 30)) // (1 + np.arange(30))
    x = random.integers(-scale, scale, (300, 30)) // (1 + np.arange(30))
    x[:5] = q[:5]
    product = q.astype(object) @ x.T.astype(object)
    for share in (-1.0, 0.0, 0.2, 0.6, 0.99):
        threshold = (share * (q.astype(float) ** 2).sum(axis=1)).astype(np.int64)
        a, b, score = reaching(q, x, threshold)
        got = dict(zip(zip(a.tolist(), b.tolist()), score.tolist()))
        want = {(i, j): int(product[i, j]) for i in range(20) for j in range(300) if product[i, j] >= threshold[i]}
        assert got == want


def brute_codes(rows, parts=4, entries=5, rounds=6, scale=4096):
    kept = [(i, integers(v, scale), label) for i, v, label in rows]
    kept = [r for r in kept if r[1] is not None]
    size = max((len(v) for _, v, _ in kept), default=0)
    length = max(1, -(-size // parts))
    kept = [(i, v + [0] * (parts * length - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * length : (p + 1) * length] for _, v, _ in first] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            x = v[p * length : (p + 1) * length]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p])))
        return out

    for _ in range(rounds):
        groups = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, (_, e) in enumerate(assign(v)):
                groups[p][e].append(v[p * length : (p + 1) * length])
        for p in range(parts):
            for e, g in enumerate(groups[p]):
                if g:
                    books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    coded = [(i, label, [e for _, e in assign(v)], sum(d for d, _ in assign(v))) for i, v, label in kept]
    totals = {}
    for _, label, _, error in coded:
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(c) for b in books for y in b for c in y)
    return sorted(map(repr, [(*r, totals[r[1]]) for r in coded])), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts", [4, 5, 12])
def test_codes_equal_brute_force(spark, parts):
    rows = embeddings(120)
    rows += [rows[0], rows[0], (None, rows[5][1], None)]
    codes, books = compress_vectors(table(spark, rows), parts=parts, entries=5)
    got = with_label_errors(codes).select("vec_id", "label", "code", "error", "label_error").collect()
    expected, sha = brute_codes(rows, parts)
    assert sorted(repr(tuple(r)) for r in got) == expected
    assert digest(books) == sha


def test_codes_of_few_rows_or_none(spark):
    rows = [(5, [0.25, -0.3, 0.1], None), (4, [1.0, 2.0, 3.0], 1)]
    codes, books = compress_vectors(table(spark, rows), parts=2)
    expected, sha = brute_codes(rows, 2, 16)
    got = with_label_errors(codes).select("vec_id", "label", "code", "error", "label_error").collect()
    assert sorted(repr(tuple(r)) for r in got) == expected and digest(books) == sha
    codes, _ = compress_vectors(table(spark, [(1, None, 1)]))
    assert with_label_errors(codes).collect() == []


def test_transform_keeps_distances_and_orders_by_sign_changes():
    random = np.random.default_rng(1)
    x = random.integers(-5000, 5000, (40, 13))
    book = np.concatenate((x[:3], random.integers(-5000, 5000, (6, 13)), x[:1]))
    flips = [(np.diff(np.sign(transform(np.eye(16, dtype=np.int64)[:, None, :])[:, 0, k])) != 0).sum() for k in range(16)]
    assert flips == list(range(16))
    plain = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    best, distance = nearest(transform(x), transform(book))
    assert (best == plain.argmin(axis=1)).all() and (distance == 16 * plain.min(axis=1)).all()
    with pytest.raises(ValueError):
        vector_codes.check_range(8, 2**40)
