"""Hard negatives: for an anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a window below that of the positive.

Both searches are joins with a threshold that is lowered until enough is found. Anchors and rows meet block by block. In
a pair of blocks the rows form an inverted index over the leading dimensions: a row leaves out the dimensions from which
on its remaining norm cannot lift any anchor of the block to its threshold. Partial scores are accumulated dimension by
dimension over the postings, pairs that the remaining norms cannot lift any more are dropped, and what is left is
completed from the rows themselves. Scores are integers and exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .vectors import matrix, padded, scaled, shape, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
BLOCK_ROWS, BLOCK_ANCHORS = 1024, 512
MOST_BUCKETS = 4096
# Thresholds of the rounds: shares of an anchor's norm times a usual row's, then none; shares of a window from its top.
NEAR = (0.5, 0.25, 0.125)
DOWN = (0.25, 0.5)
STEP = 8
# Below this share of live pairs, they are followed one by one.
SPARSE = 0.1
LOWEST = -(2**62)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); the score of two rows is their integer inner product, ties go to the smaller id.
    ``is_anchor`` is a condition on vec_id. An anchor's positives are its best other rows of its label; for each, the
    best rows of other labels with low % <= negative score / positive score <= high % are returned, so a positive of a
    negative score has none. Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Rows of one id are one row, that of the smallest label and then vector. Shorter vectors count as followed by zeros.
    Other columns are not read. Scores must fit in 63 bits, else an error is raised.
    """
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    kept = kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled(scale).alias("v"))
    kept = kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")
    kept = materialize(kept, "vectors")
    n, size, most = shape(kept, "v")
    size = max(1, size)
    if size * int(most) ** 2 >= 2**62:
        raise ValueError("components are too large for exact 64-bit scores")
    order, usual = _order_of_dimensions(kept, size)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    buckets = max(1, min(MOST_BUCKETS, n // BLOCK_ROWS))
    laid = kept.select("vec_id", "label", padded("v", size).alias("v"), norm.alias("norm"))
    laid = materialize(_blocked(laid, "vec_id", BLOCK_ROWS, buckets, "block"), "blocks")
    anchors = laid.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v", "norm")

    search = _Search(laid, anchors, order, buckets)
    everything = anchors.select(
        "anchor_id", "norm", F.lit(1).alias("slot"), F.lit(LOWEST).alias("low"), F.lit(-LOWEST).alias("high")
    )
    near = [F.floor(F.col("norm") * (share * usual)) for share in NEAR]
    best = search.rounds(everything, [*near, F.col("low")], positives, same_label=True)
    best = best.select(
        "anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    least = F.expr(f"({low} * positive_score + 99) div 100")
    windows = best.filter("positive_score >= 0").select(
        "*", least.alias("low"), F.expr(f"({high} * positive_score) div 100").alias("high")
    )
    windows = materialize(windows.filter("low <= high"), "windows")
    down = [F.col("high") - F.floor((F.col("high") - F.col("low")) * share) for share in DOWN]
    found = search.rounds(windows, [*down, F.col("low")], negatives, same_label=False)
    return found.join(windows, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("slot").alias("positive_rank"), "rank",
        F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def _order_of_dimensions(kept: DataFrame, size: int) -> tuple[list[int], float]:
    """Dimensions by falling energy, so that remaining norms fall fast; and a usual large norm of a row."""
    each = kept.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") ** 2).alias("e"))
    energy = dict(each.select("d", "e").collect())
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usual = kept.agg(F.percentile_approx(F.sqrt(squares), 0.99, 1000).alias("n")).first().n
    return sorted(range(size), key=lambda d: (-energy.get(d, 0.0), d)), usual or 0.0


def _blocked(rows: DataFrame, key: str, most: int, buckets: int, name: str) -> DataFrame:
    """Add the bucket of a row's label, and a block of about ``most`` rows within it.

    A label of any share of the rows is spread over as many blocks as it needs; rare labels share a bucket.
    """
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    parts = [0] * buckets
    for r in rows.groupBy("bucket").count().collect():
        parts[r.bucket] = math.ceil(r["count"] / most)
    first = np.cumsum([0, *parts[:-1]]).tolist()
    # MOST_BUCKETS numbers at most.
    place = F.create_map(*[F.lit(x) for b in range(buckets) if parts[b] for x in (b, (first[b] << 32) | parts[b])])
    if not any(parts):
        return rows.withColumn(name, F.lit(0).cast("long"))
    rows = rows.withColumn("_place", F.element_at(place, F.col("bucket")).cast("long"))
    number = F.pmod(F.xxhash64(key), F.expr("_place & 4294967295L"))
    return rows.withColumn(name, F.shiftright("_place", 32) + number).drop("_place")


class _Search:
    """Rounds of threshold joins between the anchors and all rows."""

    def __init__(self, laid: DataFrame, anchors: DataFrame, order: list[int], buckets: int):
        self.laid, self.anchors, self.order, self.buckets = laid, anchors, order, buckets
        self.blocks = laid.groupBy("block", "bucket").agg(F.max("norm").alias("norm"))

    def rounds(self, windows: DataFrame, thresholds: list[Column], most: int, same_label: bool) -> DataFrame:
        """(anchor_id, slot, rank, other_id, score): the best ``most`` rows of each window (anchor_id, slot, low, high).

        Each round asks for scores of at least its threshold. A window that then has ``most`` rows, or whose threshold
        has come down to ``low``, is done: whatever lies below the threshold comes after what was found.
        """
        done, left = [], windows
        for i, threshold in enumerate(thresholds):
            asked = materialize(left.withColumn("t", F.greatest(threshold, F.col("low")).cast("long")), "asked")
            if asked.isEmpty() and done:
                break
            found = materialize(self._best(asked, most, same_label), "found")
            if i + 1 == len(thresholds):
                done.append(found)
                break
            full = found.filter(F.col("rank") == most).select("anchor_id", "slot")
            full = full.union(asked.filter("t = low").select("anchor_id", "slot")).distinct()
            done.append(found.join(full, ["anchor_id", "slot"], "left_semi"))
            left = asked.drop("t").join(full, ["anchor_id", "slot"], "left_anti")
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out

    def _best(self, asked: DataFrame, most: int, same_label: bool) -> DataFrame:
        windows = asked.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "t", "high")).alias("windows"))
        anchors = self.anchors.join(windows, "anchor_id")
        anchors = materialize(_blocked(anchors, "anchor_id", BLOCK_ANCHORS, self.buckets if same_label else 1, "group"), "anchors")
        need = F.array_min(F.transform("windows", lambda w: w["t"])) / F.when(F.col("norm") > 0, F.col("norm"))
        groups = anchors.groupBy("group", "bucket").agg(F.min(F.coalesce(need, F.lit(0.0))).alias("need"))
        if same_label:
            pairs = groups.join(self.blocks, "bucket")
        else:
            # The anchors are a stated set of queries, in blocks, against all rows.
            last = groups.agg(F.max("group")).first()[0] or 0
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("group")
            pairs = self.blocks.select("block", "norm", every).join(groups, "group")
        # Scores are at most the product of the norms.
        pairs = pairs.filter(F.col("norm") * (1 + 1e-9) >= F.col("need")).select("group", "block")
        pairs = materialize(pairs, "pairs")
        left = anchors.join(pairs, "group").groupBy("group", "block")
        pairs = pairs.select(F.col("group").alias("with_group"), F.col("block").alias("with_block"))
        right = self.laid.join(pairs, F.col("block") == F.col("with_block")).groupBy("with_group", "with_block")
        found = left.cogroup(right).applyInArrow(
            _meeting(self.order, most, same_label), "anchor_id long, slot int, other_id long, score long"
        )
        best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "other_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def _meeting(order: list[int], most: int, same_label: bool):
    """The best rows of a block for each window of a group of anchors."""

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            q = matrix(anchors.column("v"), len(order))[:, order]
            x = matrix(rows.column("v"), len(order))[:, order]
            ids, labels = (anchors.column(c).to_numpy() for c in ("anchor_id", "label"))
            row_ids, row_labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            windows = anchors.column("windows").to_pylist()
            threshold = np.array([min(w["t"] for w in ws) for ws in windows])
            a, b, score = reaching(q, x, threshold)
            fits = (labels[a] == row_labels[b]) == same_label
            fits &= ids[a] != row_ids[b]
            a, b, score = a[fits], b[fits], score[fits]
            for k in range(max(map(len, windows))):
                have = np.array([k < len(ws) for ws in windows])
                slot, least, high = (
                    np.array([ws[k][f] if k < len(ws) else 0 for ws in windows]) for f in ("slot", "t", "high")
                )
                inside = have[a] & (score >= least[a]) & (score <= high[a])
                first = _first(a[inside], score[inside], row_ids[b[inside]], most)
                who = a[inside][first]
                for column, values in zip(out, (ids[who], slot[who], row_ids[b[inside]][first], score[inside][first])):
                    column.append(values)
        kinds = [("anchor_id", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())]
        return pa.table({n: pa.array(np.concatenate(c) if c else [], k) for (n, k), c in zip(kinds, out)})

    return meet


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best entries of each group."""
    by = np.lexsort((ids, -score, group))
    ordered = group[by]
    start = np.searchsorted(ordered, ordered)
    return by[np.arange(len(by)) - start < most]


def _remaining_norms(v: np.ndarray) -> np.ndarray:
    """Norms of what is left of each vector from each dimension on."""
    squares = np.cumsum((v.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(v), 1))), axis=1))


def reaching(q: np.ndarray, x: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs with a score of at least the anchor's threshold."""
    size = q.shape[1]
    # Whole numbers below 2^53 are exact in floating point, also as sums.
    kind = np.float64 if size * max(1, abs(q).max()) * max(1, abs(x).max()) < 2**52 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    q_rest, x_rest = _remaining_norms(q), _remaining_norms(x)
    indexed = _indexed(q_rest, x_rest, threshold)
    by = np.argsort(-indexed, kind="stable")
    x, x_rest, indexed = x[by], x_rest[by], indexed[by]

    def may_reach(so_far, bound, least):
        # The bound is rounded upwards; scores are whole numbers.
        return so_far + bound * (1 + 1e-9) + 0.5 >= least

    sums = np.zeros((len(q), len(x)), dtype=kind)
    alive = may_reach(0.0, q_rest[:, :1] * x_rest[:, 0], threshold[:, None])
    reached = 0
    while reached < size and alive.any():
        # Rows are in order of what they have indexed: the postings of a dimension are the first ones.
        n = int(np.searchsorted(-indexed, -reached))
        if not n or alive.mean() < SPARSE:
            break
        stop = min(size, reached + STEP)
        sums[:, :n] += q[:, reached:stop] @ x[:n, reached:stop].T
        alive[:, :n] &= may_reach(sums[:, :n], q_rest[:, stop : stop + 1] * x_rest[:n, stop], threshold[:, None])
        reached = stop
    a, b = np.nonzero(alive)
    score, done = sums[a, b], np.minimum(indexed[b], reached)
    for start in range(0, size, STEP):
        stop = min(size, start + STEP)
        due = done <= start
        if due.any():
            score[due] += (q[a[due], start:stop] * x[b[due], start:stop]).sum(axis=1)
            left = ~due | may_reach(score, q_rest[a, stop] * x_rest[b, stop], threshold[a])
            a, b, score, done = a[left], b[left], score[left], done[left]
    whole = score >= threshold[a]
    return a[whole], by[b[whole]], score[whole].astype(np.int64)


def _indexed(q_rest: np.ndarray, x_rest: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """How many leading dimensions of each row the index has, in whole steps.

    From the first dimension on at which the remaining norm of a row times that of every anchor stays below the
    anchor's threshold, the rest of the row is left out.
    """
    size = x_rest.shape[1] - 1
    marks = np.array([*range(0, size, STEP), size])
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(threshold[:, None] > 0, threshold[:, None] / q_rest[:, marks], -np.inf).min(axis=0)
    covered = x_rest[:, marks] * (1 + 1e-9) < need
    covered[:, -1] = True
    return marks[covered.argmax(axis=1)]
