"""Session similarity: column expressions, and the sequence score as a vectorised UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(left, right) -> int:
    """Longest common subsequence, one bit per element of ``left``."""
    places: dict = {}
    for i, x in enumerate(left):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for x in right:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def grams(values, size: int) -> set:
    values = list(values)
    if len(values) < size:
        return {tuple(values)} if values else set()
    return {tuple(values[i : i + size]) for i in range(len(values) - size + 1)}


def sequence_score(left, right) -> float:
    """0.75 LCS over the longer length + 0.25 Jaccard of the bigrams (unigrams if short)."""
    a, b = len(left), len(right)
    if a == 0 and b == 0:
        return 1.0
    size = min(2, max(1, min(a, b)))
    x, y = grams(left, size), grams(right, size)
    union = len(x | y)
    shared = len(x & y) / union if union else 1.0
    return lcs_length(left, right) / max(a, b) * 0.75 + shared * 0.25


@F.pandas_udf(T.DoubleType())
def sequence_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict = {}
    scores = []
    for x, y in zip(left, right):
        key = (tuple(x), tuple(y))
        if key not in known:
            known[key] = sequence_score(*key)
        scores.append(known[key])
    return pd.Series(scores, dtype="float64")


@F.pandas_udf(T.IntegerType())
def lcs_of(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(left, right)], dtype="int32")


def ngrams(values: Column, size: Column) -> Column:
    """Joined n-grams of an array; a shorter list is one gram."""
    n = F.size(values)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(values, i, size), ">"),
    )
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(windows)


def jaccard(left: Column, right: Column) -> Column:
    """Set overlap of two arrays; two empty arrays count as equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)) / union
    )


def time_of_day_similarity(left: Column, right: Column) -> Column:
    """1 at the same minute, 0 half a day apart, around the clock."""
    apart = F.abs(left - right)
    return F.greatest(F.lit(0.0), 1 - F.least(apart, 1440 - apart) / F.lit(720))


def composite(parts: dict[str, Column], weights, strategy: str) -> Column:
    """Weighted total; the sequence-only strategy ignores the other parts."""
    if strategy == "legacy":
        return parts["sequence"]
    w = weights.normalized()
    return (
        parts["sequence"] * F.lit(w.sequence)
        + parts["action_set"] * F.lit(w.action_set)
        + parts["context"] * F.lit(w.context)
        + parts["time_of_day"] * F.lit(w.time_of_day)
    )


def similarity_parts(left: str, right: str, strategy: str = "hybrid_v2") -> dict[str, Column]:
    """The four parts for descriptor columns with the given prefixes."""
    sequence = sequence_similarity(F.col(f"{left}tokens"), F.col(f"{right}tokens"))
    if strategy == "legacy":
        zero = F.lit(0.0)
        return {"sequence": sequence, "action_set": zero, "context": zero, "time_of_day": zero}
    return {
        "sequence": sequence,
        "action_set": jaccard(F.col(f"{left}action_set"), F.col(f"{right}action_set")),
        "context": jaccard(F.col(f"{left}contexts"), F.col(f"{right}contexts")),
        "time_of_day": time_of_day_similarity(
            F.col(f"{left}start_minute"), F.col(f"{right}start_minute")
        ),
    }
