"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

1. Each task counts its pre-tokens; one shuffle of partial counts gives the distinct ones of the corpus.
2. The tokenizer runs once on each distinct pre-token and only the number of pieces is kept.
3. Documents become (pre-token, frequency) pairs that are joined to those numbers and summed.

The most frequent pre-tokens, at most ``frequent`` of at most 64 characters each, are a table of bounded size
(some 20 MB at the most) that is sent to the tasks; their part of the sum never leaves the task. All other pairs are
joined by shuffle on the pre-token, where no key is frequent any more. Ids are never built for documents.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .pretokens import PreTokens, Remembered
from .words import text_chunks

FREQUENT = 200_000
SHORT = 64
HELD = 300_000


def pretoken_frequencies(documents: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The distinct pre-tokens of the corpus with their number of occurrences."""

    def count(batches):
        splitter, held = PreTokens(path), Counter()

        def rows():
            # No pre-token reaches over white space, so words can be counted first.
            found = Counter()
            for word, n in held.items():
                for p in splitter.split(word.decode()):
                    found[p] += n
            held.clear()
            # Types are stated: what comes after the last flush may be empty and must have the same ones.
            return pa.RecordBatch.from_pydict(
                {"pretoken": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())}
            )

        for _, texts in text_chunks(batches, text):
            for t in texts:
                held.update(t.split())
            if len(held) > HELD:
                yield rows()
        yield rows()

    return (
        documents.select(text)
        .mapInArrow(count, "pretoken string, n long")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
    )


def pretoken_pieces(frequencies: DataFrame, path: str) -> DataFrame:
    """The number of pieces of each distinct pre-token."""

    def pieces(batches):
        splitter = PreTokens(path)
        for batch in batches:
            sizes = [len(splitter.ids(p)) for p in batch.column("pretoken").to_pylist()]
            yield batch.append_column("pieces", pa.array(sizes, pa.int64()))

    return frequencies.mapInArrow(pieces, "pretoken string, n long, pieces long")


def _frequent(pieces: DataFrame, limit: int) -> dict[str, int]:
    """At most ``limit`` short pre-tokens, those above a frequency that a histogram gives.

    Its bins are single numbers, and from 4096 on the 64 parts of an octave, so they are few whatever the counts.
    """
    octaves = F.floor((F.log2("n") - 12) * 64).cast("long") + 4096
    short = pieces.filter(F.length("pretoken") <= SHORT)
    short = short.withColumn("bin", F.when(F.col("n") < 4096, F.col("n")).otherwise(octaves))
    sizes = short.groupBy("bin").count().collect()
    least, total = None, 0
    for n, count in sorted(map(tuple, sizes), reverse=True):
        total += count
        if total > limit:
            break
        least = n
    if least is None:
        return {}
    rows = short.filter(F.col("bin") >= least).select("pretoken", "pieces").collect()
    return {r.pretoken: r.pieces for r in rows}


def count_tokens(
    documents: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row's whole text.

    A null or empty text has 0 of both. Every row gives one row, also if ids are null or occur twice.
    Other columns are not read. The ``frequent`` most frequent short pre-tokens are sent to every task, all others go
    through a join.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = pretoken_pieces(pretoken_frequencies(source, path), path)
    known = materialize(counted, "pretokens")
    table = source.sparkSession.sparkContext.broadcast(_frequent(known, frequent))
    kind = source.schema["doc_id"].dataType.simpleString()

    def parts(batches):
        splitter, sizes = PreTokens(path), table.value

        def look(word: bytes) -> tuple[int, list[str]]:
            """The pieces of a word's known pre-tokens, and the other ones."""
            pretokens = splitter.split(word.decode())
            return sum(sizes.get(p, 0) for p in pretokens), [p for p in pretokens if p not in sizes]

        words = Remembered(look, HELD)
        task, number = TaskContext.get().partitionId(), 0
        for rows, texts in text_chunks(batches):
            row, of, pretoken, times, here, n_bytes = [], [], [], [], [], []
            for i, t in enumerate(texts):
                key = (task << 36) | number
                number += 1
                rest, total = Counter(), 0
                for known_pieces, others in words.of(t.split()):
                    total += known_pieces
                    if others:
                        rest.update(others)
                # A document without other pre-tokens gets a key that is none and its own.
                pairs = list(rest.items()) or [(f" {key}", 0)]
                row += [key] * len(pairs)
                of += [i] * len(pairs)
                pretoken += [p for p, _ in pairs]
                times += [n for _, n in pairs]
                here += [total] + [0] * (len(pairs) - 1)
                n_bytes += [len(t)] * len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row, pa.int64()),
                    rows.column("doc_id").take(pa.array(of, pa.int64())),
                    pa.array(pretoken, pa.string()),
                    pa.array(times, pa.int64()),
                    pa.array(here, pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                ],
                names=["row", "doc_id", "pretoken", "times", "here", "n_bytes"],
            )

    schema = f"row long, doc_id {kind}, pretoken string, times long, here long, n_bytes long"
    pairs = source.mapInArrow(parts, schema)
    return (
        pairs.join(known.select("pretoken", "pieces"), "pretoken", "left")
        .groupBy("row", "doc_id", "n_bytes")
        .agg(F.sum(F.col("here") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens")
    )
