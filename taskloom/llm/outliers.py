"""Quality rules: robust multivariate outliers of text statistics.

For each language and source the minimum-covariance-determinant estimate of location and scatter is computed, and
rows far from it by Mahalanobis distance are rejected. Concentration steps run on Spark over all rows:
each row's distance under the current estimate falls into a bin of a logarithmic scale, counts, sums and products are
aggregated per group and bin, and the bins that hold the nearest share of the group (the last of them in part, so that
it is exactly that share) give the next estimate. Several starts take their first steps side by side in one aggregation;
per group the one of the least determinant goes on. A step moves one row per group, start, bin and task; nothing is
collected, and a group of any size, such as one that holds a third of all rows, is only ever summed. Binning makes the
steps independent of row order and partitions.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .words import Words, inside, text_chunks, window_hashes

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

AXES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
# The least standard deviation on each axis: statistics that hardly vary in a group must not
# turn small differences into large distances. One line said twice is ordinary in a short text, so the axis of lines is
# wide; hardly any ordinary text has symbols, so theirs is narrow.
FLOORS = (0.5, 0.1, 0.04, 0.2, 0.1)
SUBSET = 0.75
# Fixed value: makes the scatter of the nearest 75 % consistent for five normal variables.
CONSISTENT = 1.41
# Share of normal rows within the cutoff.
INSIDE = 0.999
# Groups of fewer rows are judged by a larger group's estimate.
LEAST_ROWS = 50
# Steps of all starts, and in all.
FIRST_STEPS, STEPS = 2, 6
# Each start's centre, as a quantile of every axis, and whether its spread is the quartile range or the floor alone.
STARTS = ((0.5, True), (0.25, True), (0.75, True), (0.5, False))
# A group's rows are dealt in parts of about this many when they meet their group's estimate.
PART_ROWS = 100_000
# The group of all rows; other groups' names begin with "{" or "pool".
EVERY = "every row"
BINS_PER_OCTAVE = 16

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def chi_square_quantile(share: float) -> float:
    """The squared distance within which ``share`` of five independent standard normal variables lie."""
    low, high = 0.0, 200.0
    for _ in range(80):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > 1 - share else (low, x)
    return (low + high) / 2


CUTOFF = chi_square_quantile(INSIDE)


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[first[1:]] - total[first[:-1]]


def repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Per text, the words in windows that occur twice or more in it."""
    windows = window_hashes(words.hashes(), size)
    start = np.flatnonzero(inside(words.first, size)[: len(windows)])
    keys = windows[start] + words.text_of()[start].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(change, start[twice], 1)
    np.add.at(change, start[twice] + size, -1)
    return _per_text(np.cumsum(change[:-1]) > 0, words.first)


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\v\f")]
    return len(lines), len(lines) - len(set(lines))


def with_statistics(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    source = documents.select(*keep, text)

    def count(batches):
        for rows, texts in text_chunks(batches, text):
            words = Words(texts)
            data, begin = words.buffer[:-8], words.text_start[:-1]
            point = ((data & 0xC0) != 0x80) & ~_BLANK[data]
            lines = np.array([repeated_lines(t) for t in texts])
            columns = [
                words.counts(),
                np.add.reduceat(point, begin, dtype=np.int64),
                np.add.reduceat(_SYMBOL[data], begin, dtype=np.int64),
                lines[:, 0],
                lines[:, 1],
                repeated_words(words),
            ]
            kept = [rows.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(c.astype(np.int64)) for c in columns], names=[*keep, *made]
            )

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text]
    return source.mapInArrow(count, ", ".join([*types, *[f"{c} long" for c in made]]))


def axes() -> dict[str, Column]:
    """The statistics on scales where ordinary texts spread evenly."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_words": F.log(words + 1.0),
        "x_length": F.log((chars + 1.0) / (words + 1.0)),
        "x_symbols": F.sqrt(F.col("n_symbols") / (chars + 1.0)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 1.0)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (words + 1.0)),
    }


def _own_group(keys: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"})


def with_group(rows: DataFrame, source: DataFrame, keys: list[str], least: int = LEAST_ROWS) -> DataFrame:
    """Add ``_group`` and its number of rows ``_size``, and that of the table, ``_all``.

    Rows are counted in ``source``, which has the same keys, so that no statistics are made for it. The group is all keys, the first key for groups of under ``least`` rows together, or, where even that pool is
    smaller, the whole table.
    """
    sizes = source.groupBy(_own_group(keys).alias("_own"), F.col(keys[0]).alias("_first")).agg(
        F.count("*").alias("_n"), F.lit(1).alias("_one")
    )
    small = sizes.filter(F.col("_n") < least).groupBy("_first").agg(F.sum("_n").alias("_pool"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.lit(1).alias("_one"))
    own, pooled = F.col("_n") >= least, F.col("_pool") >= least
    chosen = sizes.join(
        small.withColumnRenamed("_first", "_f"), F.col("_first").eqNullSafe(F.col("_f")), "left"
    ).join(whole, "_one").select(
        F.col("_own").alias("_known"),
        F.when(own, F.col("_own")).when(pooled, F.concat(F.lit("pool "), F.coalesce("_first", F.lit("null"))))
        .otherwise(EVERY).alias("_group"),
        F.when(own, F.col("_n")).when(pooled, F.col("_pool")).otherwise(F.col("_all")).alias("_size"),
        "_all",
    )
    named = rows.withColumn("_own", _own_group(keys))
    return named.join(chosen, F.col("_own") == F.col("_known"), "left").drop("_own", "_known")


_ESTIMATE = "_key string, _start int, _parts long, _mean array<double>, _precision array<double>, _determinant double"


def _parts(size) -> Column:
    return F.ceil(size / PART_ROWS)


def first_spreads(low: list, high: list) -> list[float]:
    return [max(f, (h - x) / 1.349) for f, x, h in zip(FLOORS, low, high)]


def _first_estimates(rows: DataFrame) -> DataFrame:
    """The starts of each group: quartiles and their ranges, from bins of 1/64."""
    stacked = rows.select(
        "_group", F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.floor(F.col(a) * 64).alias("bin")) for i, a in enumerate(AXES)])).alias("_v")
    )
    bins = stacked.groupBy("_group", "_v.axis", "_v.bin").agg(F.count("*").alias("n"))

    def estimate(bins: pd.DataFrame) -> pd.DataFrame:
        quartiles = {0.25: [], 0.5: [], 0.75: []}
        for axis in range(len(AXES)):
            own = bins[bins.axis == axis].sort_values("bin")
            share = own.n.cumsum().to_numpy() / own.n.sum()
            for q, found in quartiles.items():
                found.append(own.bin.to_numpy()[np.searchsorted(share, q)] / 64)
        spread = first_spreads(quartiles[0.25], quartiles[0.75])
        size = int(bins.n[bins.axis == 0].sum())
        found = []
        for start, (q, ranged) in enumerate(STARTS):
            squares = np.square(spread if ranged else FLOORS)
            precision = np.diag(1 / squares).ravel().tolist()
            found.append((bins._group.iloc[0], start, -(-size // PART_ROWS), quartiles[q], precision, float(np.prod(squares))))
        return pd.DataFrame(found, columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    return bins.groupBy("_group").applyInPandas(estimate, _ESTIMATE)


def _distance() -> Column:
    off = [F.col(a) - F.col("_mean")[i] for i, a in enumerate(AXES)]
    n = len(AXES)
    return reduce(add, [off[i] * off[j] * F.col("_precision")[i * n + j] for i in range(n) for j in range(n)])


def _with_estimate(rows: DataFrame, estimate: DataFrame, how: str) -> DataFrame:
    """Rows with their group's estimates; a large group's rows stay spread over many tasks."""
    spread = estimate.withColumn("_its_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return rows.join(spread, (F.col("_group") == F.col("_key")) & (F.col("_part") == F.col("_its_part")), how)


def nearest(bins: pd.DataFrame) -> pd.Series:
    """Counts, sums and products of exactly the nearest share of a group; the last bin counts in part."""
    bins = bins.sort_values("_bin").drop(columns="_bin")
    before = bins.n.cumsum() - bins.n
    taken = ((SUBSET * bins.n.sum() - before) / bins.n).clip(0, 1)
    return bins.mul(taken, axis=0).sum()


def _step(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step of every start: the estimate from the nearest rows under the one given."""
    n = len(AXES)
    placed = _with_estimate(rows, estimate, "inner").withColumn(
        "_bin", F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-20))) * BINS_PER_OCTAVE)
    )
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(AXES)]
    products = [F.sum(F.col(AXES[i]) * F.col(AXES[j])).alias(f"p{i}{j}") for i in range(n) for j in range(i, n)]
    bins = placed.groupBy("_group", "_start", "_bin").agg(F.count("*").alias("n"), *sums, *products)

    def estimate_of(bins: pd.DataFrame) -> pd.DataFrame:
        group, start, parts = bins._group.iloc[0], bins._start.iloc[0], -(-int(bins.n.sum()) // PART_ROWS)
        total = nearest(bins.drop(columns=["_group", "_start"]))
        mean = np.array([total[f"s{i}"] for i in range(n)]) / total.n
        scatter = np.array([[total[f"p{min(i, j)}{max(i, j)}"] for j in range(n)] for i in range(n)])
        scatter = (scatter / total.n - np.outer(mean, mean)) * CONSISTENT + np.diag(np.square(FLOORS))
        row = (group, start, parts, mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.det(scatter)))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    return bins.groupBy("_group", "_start").applyInPandas(estimate_of, _ESTIMATE)


def least_determinant(estimates: DataFrame) -> DataFrame:
    """Of each group's starts the one of the least determinant; rounding must not tell equal ones apart."""
    order = F.struct(F.round(F.log("_determinant"), 6), F.col("_start"))
    names = ["_start", "_parts", "_mean", "_precision", "_determinant"]
    best = estimates.groupBy("_key").agg(F.min_by(F.struct(*names), order).alias("_best"))
    return best.select("_key", *[F.col(f"_best.{c}").alias(c) for c in names])


def estimates(known: DataFrame, steps: int = STEPS) -> DataFrame:
    """Location and scatter of each ``_group`` of ``known``, which also holds ``_part`` and the axes."""
    found = _first_estimates(known)
    for _ in range(min(FIRST_STEPS, steps)):
        found = _step(known, found)
    found = least_determinant(found)
    for _ in range(steps - FIRST_STEPS):
        found = _step(known, found)
    return found


def judge_quality(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keys: tuple[str, ...] = ("lang", "source"),
    cutoff: float = CUTOFF,
    steps: int = STEPS,
) -> DataFrame:
    """Statistics of each row, base_failed, distance (squared) and kept.

    The id and the keys pass through, other columns are not read; a null key is a group of its own. Groups under 50 rows are pooled by the first
    key; rows of a pool under 50 are judged by the estimate over all rows, so that every row has a distance, also in a
    tiny table. Null and empty texts have 0 words and fail the base rule. Equal rows get equal results; nothing is
    merged.
    """
    rows = with_statistics(documents, [doc_id, *keys], text).withColumns(axes())
    rows = with_group(rows, documents.select(*keys), list(keys))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "statistics")
    # Every row also counts in the group of all rows.
    homes = F.array_distinct(F.array(F.struct("_group", "_size"), F.struct(F.lit(EVERY).alias("_group"), F.col("_all").alias("_size"))))
    known = rows.select(F.explode(homes).alias("_home"), "_row", *AXES)
    known = known.select("_home._group", F.pmod("_row", _parts(F.col("_home._size"))).alias("_part"), *AXES)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return (
        _with_estimate(rows.withColumn("_part", F.pmod("_row", _parts(F.col("_size")))), estimates(known, steps), "left")
        .withColumns({"base_failed": failed, "distance": _distance()})
        .withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
        .drop(
            "_group", "_size", "_all", "_row", "_key", "_start", "_parts", "_part", "_its_part", "_mean", "_precision",
            "_determinant", *AXES,
        )
    )
