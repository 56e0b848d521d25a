"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on each document. Votes are conditionally independent given an unseen class, whose
share and whose votes' probabilities expectation-maximisation estimates from how the heuristics agree. The corpus enters
that only as counts of vote patterns: one aggregation with at most 3^heuristics rows, a number that no input changes.
The posterior of a document's pattern is its label, and a linear scorer of hashed features learns from the
labels, so documents on which the heuristics abstain or contradict each other are judged by their words.

The scorer is fitted in one task on a sample of at most about ``sample`` distinct texts, chosen by their hash; votes,
estimation and scoring cover all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .outliers import _per_text, repeated_lines, repeated_words
from .words import Words, mix, text_chunks

BINS = 1 << 14
SAMPLE = 20_000
HEURISTICS = (
    "length", "symbols", "repeats", "lines", "capitals", "word_length", "variety", "separators", "letters",
    "plain_words", "sentences", "doubled_words",
)

_NEED_WORDS = ("repeats", "lines", "variety", "sentences", "doubled_words")


def _class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


_SYMBOL = _class_table(b"#*$%&|<>")
_MARK, _END = _class_table(b".,;:!?"), _class_table(b".!?")
_UPPER = _class_table(bytes(range(65, 91)))
_LETTER = _class_table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _ratio(a, b) -> np.ndarray:
    return np.asarray(a, dtype=float) / np.maximum(np.asarray(b, dtype=float), 1)


def votes(words: Words, texts: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Votes of each heuristic on each text: 1 good, -1 bad, 0 abstains. Rates over few words abstain."""
    n = words.counts()
    data, begin = words.buffer[:-8], words.text_start[:-1]
    letters = np.add.reduceat(_LETTER[data], begin, dtype=np.int64)
    ascii_letters = np.add.reduceat(_LETTER[data] & (data < 128), begin, dtype=np.int64)
    upper = np.add.reduceat(_UPPER[data], begin, dtype=np.int64)
    symbols = np.add.reduceat(_SYMBOL[data], begin, dtype=np.int64)
    lines = np.array([repeated_lines(t) for t in texts], dtype=np.int64).reshape(-1, 2)
    with_letter = np.concatenate(([0], np.cumsum(_LETTER[data])))
    own = with_letter[words.end] - with_letter[words.start]
    size = words.end - words.start
    final = data[words.end - 1] if len(words) else data[:0]
    plain = (own > 0) & ((own == size) | ((own == size - 1) & _MARK[final]))
    visible = _ratio(letters, np.maximum(np.diff(np.concatenate(([0], np.cumsum(size)))[words.first]), 1))
    ends = _per_text(_END[final], words.first)
    doubled = np.zeros(len(words), dtype=bool)
    doubled[1:] = hashes[1:] == hashes[:-1]
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:])])

    def vote(value, good, bad):
        return np.where(bad(value), -1, np.where(good(value), 1, 0))

    cast = [
        vote(n, lambda v: v >= 50, lambda v: v < 3),
        vote(_ratio(symbols, n), lambda v: v < 0.05, lambda v: v > 0.3),
        vote(_ratio(repeated_words(words), n), lambda v: v < 0.05, lambda v: v > 0.2),
        vote(_ratio(lines[:, 1], lines[:, 0]), lambda v: v < 0.05, lambda v: v > 0.3),
        vote(_ratio(upper, ascii_letters), lambda v: v < 0.15, lambda v: v > 0.4),
        vote(_ratio(letters, n), lambda v: (v > 2.5) & (v < 9), lambda v: (v < 1.5) | (v > 15)),
        vote(_ratio(distinct, np.sqrt(n)), lambda v: v > 4, lambda v: v < 2),
        vote(_ratio(_per_text(own == 0, words.first), n), lambda v: v < 0.05, lambda v: v > 0.15),
        vote(visible, lambda v: v > 0.9, lambda v: v < 0.8),
        vote(_ratio(_per_text(plain, words.first), n), lambda v: v > 0.9, lambda v: v < 0.7),
        vote(_ratio(ends, n), lambda v: (v > 0.02) & (v < 0.35), lambda v: (v < 0.005) | (v > 0.6)),
        vote(_ratio(_per_text(doubled, words.first), n), lambda v: v < 0.03, lambda v: v > 0.1),
    ]
    cast = np.stack(cast, axis=1)
    cast[np.ix_(n < 10, [HEURISTICS.index(h) for h in _NEED_WORDS])] = 0
    return cast


def pattern_of(cast: np.ndarray) -> np.ndarray:
    return (cast + 1) @ (3 ** np.arange(cast.shape[1]))


def estimate_accuracies(patterns: np.ndarray, counts: np.ndarray, heuristics: int, rounds: int = 200):
    """Expectation-maximisation over vote patterns: the posterior of each, the good share, and vote probabilities.

    Starts from the majority vote. The class whose votes are more often good is the good one;
    without patterns there is nothing to estimate.
    """
    if not len(patterns):
        return np.zeros(0), 0.5, None
    cast = (patterns[:, None] // 3 ** np.arange(heuristics)) % 3
    weight = counts / max(counts.sum(), 1)
    good = np.clip(0.5 + 0.4 * np.sign((cast - 1).sum(axis=1)), 0.05, 0.95)
    share, tables = 0.5, None
    for _ in range(rounds):
        before = good
        share = float(np.clip((weight * good).sum(), 0.01, 0.99))
        tables = []
        for side in (good, 1 - good):
            table = np.stack([[(weight * side * (cast[:, j] == v)).sum() for v in (0, 2)] for j in range(heuristics)])
            tables.append((table + 1e-4) / (table + 1e-4).sum(axis=1, keepdims=True))
        # Abstaining is no evidence.
        log = [
            np.where(cast == 1, 0.0, np.log(t[np.arange(heuristics), cast // 2])).sum(axis=1) for t in tables
        ]
        good = 1 / (1 + np.exp(np.clip(log[1] + np.log(1 - share) - log[0] - np.log(share), -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    if tables[0][:, 1].sum() < tables[1][:, 1].sum():
        good, share, tables = 1 - good, 1 - share, tables[::-1]
    return good, share, tables


def features(words: Words, hashes: np.ndarray, bins: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text: its words' values and its words' shapes, scaled to length one."""
    data = words.buffer
    kind = np.zeros(256, dtype=np.uint64)
    kind[_LETTER], kind[_UPPER], kind[48:58], kind[_SYMBOL] = 1, 2, 3, 4
    kind[np.frombuffer(b".,!?;:", dtype=np.uint8)] = 5
    first, last = kind[data[words.start]], kind[data[words.end - 1]]
    middle = kind[data[(words.start + words.end) // 2]]
    size = np.minimum(np.log2(words.end - words.start), 7).astype(np.uint64)
    shape = mix(((size * np.uint64(8) + first) * np.uint64(8) + middle) * np.uint64(8) + last + np.uint64(1 << 40))
    bits = np.uint64(64 - (bins.bit_length() - 1))
    made = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        bin_, count = np.unique(np.concatenate([hashes[a:b], shape[a:b]]) >> bits, return_counts=True)
        value = np.log1p(count)
        made.append((bin_.astype(np.int32), value / max(np.sqrt((value**2).sum()), 1e-9)))
    return made


def fit_scorer(bin_lists, value_lists, labels, bins: int = BINS, passes: int = 12) -> np.ndarray:
    """Weights and, at the end, the bias of a logistic scorer of soft labels; adaptive steps in the given order."""
    weights, squares = np.zeros(bins + 1), np.full(bins + 1, 1e-6)
    rows = [(np.append(b, bins), np.append(v, 1.0)) for b, v in zip(bin_lists, value_lists)]
    for _ in range(passes):
        for (place, value), label in zip(rows, labels):
            slope = (1 / (1 + np.exp(-np.clip(weights[place] @ value, -30, 30))) - label) * value
            squares[place] += slope**2
            weights[place] -= 0.5 * slope / np.sqrt(squares[place])
    return weights


def classify_quality(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, bins: int = BINS
) -> DataFrame:
    """doc_id, n_votes, weak_label (posterior of good), score (0 to 1) and kept (score of a half or more) of each row.

    A null or empty text is one of no words: the length votes bad, and it is not kept. Every row gives one row, whatever its id;
    equal texts get equal results. With no rows the result is empty. Other columns are not read.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def vote(batches):
        for rows, texts in text_chunks(batches):
            words = Words(texts)
            cast = votes(words, texts, words.hashes())
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(pattern_of(cast), pa.int64())})

    counted = source.select("text").mapInArrow(vote, "pattern long").groupBy("pattern").count().collect()
    patterns = np.array([r[0] for r in counted], dtype=np.int64)
    counts = np.array([r[1] for r in counted], dtype=float)
    order = np.argsort(patterns)
    posterior, _, _ = estimate_accuracies(patterns[order], counts[order], len(HEURISTICS))
    labels = spark.sparkContext.broadcast(dict(zip(patterns[order].tolist(), posterior.tolist())))

    def learn_rows(batches):
        for rows, texts in text_chunks(batches):
            words = Words(texts)
            hashes = words.hashes()
            pattern = pattern_of(votes(words, texts, hashes))
            made = features(words, hashes, bins)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_at"),
                    pa.array([labels.value[p] for p in pattern.tolist()], pa.float64()),
                    pa.array([b for b, _ in made], pa.list_(pa.int32())),
                    pa.array([v for _, v in made], pa.list_(pa.float64())),
                ],
                names=["at", "label", "bins", "values"],
            )

    share = min(1.0, sample / max(counts.sum(), 1))
    chosen = source.select("text", F.xxhash64("text").alias("_at")).filter(
        F.pmod("_at", F.lit(1 << 30)) < int(share * (1 << 30))
    )
    # A text of very many copies counts once, so the sample stays bounded.
    chosen = chosen.groupBy("_at").agg(F.any_value("text").alias("text"))
    rows = chosen.mapInArrow(learn_rows, "at long, label double, bins array<int>, values array<double>")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        return pd.DataFrame({"weights": [fit_scorer(rows.bins, rows["values"], rows.label, bins).tolist()]})

    fitted = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "weights array<double>").first()
    weights = spark.sparkContext.broadcast(np.array(fitted.weights) if fitted else np.zeros(bins + 1))

    def score(batches):
        w = weights.value
        for rows, texts in text_chunks(batches):
            words = Words(texts)
            hashes = words.hashes()
            cast = votes(words, texts, hashes)
            total = np.array([w[b] @ v for b, v in features(words, hashes, bins)]) + w[-1]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array((cast != 0).sum(axis=1), pa.int64()),
                    pa.array([labels.value[p] for p in pattern_of(cast).tolist()], pa.float64()),
                    pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))), pa.float64()),
                ],
                names=["doc_id", "n_votes", "weak_label", "score"],
            )

    scored = source.mapInArrow(score, f"doc_id {kind}, n_votes long, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)
