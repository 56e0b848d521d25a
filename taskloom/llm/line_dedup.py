"""Lines that recur across documents, kept only in the document of the largest id.

Main path without Python: lines become 128-bit hashes, which are range-partitioned and sorted by document and
position within a hash. The first rows of each hash are its keeper's, all later ones are dropped where enough documents
follow. What comes back for a document is a bitmap of lines, not text.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
# Hashes named as hot at most, and those tracked in finding them: an unnamed one holds under 1/24,000 of all lines, or
# less than the 1,024th.
HOT_NAMES, HOT_TRACKED = 1024, 32768
HOT_PARTITIONS = 0.5


def keep_bitmaps(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, dropped), one row per row of ``documents``.

    ``dropped`` is the keep bitmap, inverted and without its trailing zeros: bit i % 64 of long i / 64 is set where line
    i goes, so a document that loses nothing has an empty array. ``text_hash`` is ``xxhash64`` of the text and, with
    ``doc_id``, says which text the bitmap is of. See ``drop_repeated_lines`` for the rule.
    """
    rows = _texts(documents).select("doc_id", "text_hash", F.size(_lines()).cast("long").alias("n_lines"))
    return _with_bitmaps(rows, documents, least_documents, least_chars).select(
        "doc_id", "text_hash", "n_lines", "n_dropped", "dropped"
    )


def drop_repeated_lines(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``documents``; other columns are ignored.

    Texts are split at line feeds; null and empty ones are one empty line. A line's key is the line without blanks
    (space, tab to carriage return) at both ends, with A-Z in lower case. Keys of at least ``least_chars`` code points
    in at least ``least_documents`` different ids lose all their lines except those of the largest id. Rows of one id
    are one document; rows without an id are one as well, smaller than all others. Equal rows get equal results.
    """
    joined = _with_bitmaps(_texts(documents), documents, least_documents, least_chars)

    def stays(line, i):
        word = F.get("dropped", (i / 64).cast("int"))
        return word.isNull() | (F.getbit(word, i % 64) == 0)

    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.filter(_lines(), stays), "\n"))
    return joined.select(
        "doc_id", F.size(_lines()).cast("long").alias("n_lines"), "n_dropped", kept.alias("kept_text")
    )


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _lines():
    return F.split("text", "\n", -1)


def _with_bitmaps(rows, documents, least_documents, least_chars):
    maps = _bitmaps(_dropped_lines(_long_lines(documents, least_chars), least_documents))
    maps = maps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped", "n_dropped")
    same = rows.doc_id.eqNullSafe(maps._id) & (rows.text_hash == maps._hash)
    return (
        rows.join(maps, same, "left")
        .withColumn("dropped", F.coalesce("dropped", F.array().cast("array<bigint>")))
        .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
    )


def _long_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, line) of each line whose key is long enough."""
    lines = _texts(documents).select("doc_id", "text_hash", F.posexplode(_lines()).alias("line", "content"))
    lines = lines.withColumn("content", F.btrim("content", F.lit(BLANKS)))
    key = F.translate("content", string.ascii_uppercase, string.ascii_lowercase)
    lines = lines.filter(F.char_length("content") >= least_chars).withColumn("content", key)
    hashes = F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2")
    return materialize(lines.select(*hashes, "doc_id", "text_hash", "line"), "lines")


def _dropped_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """(doc_id, text_hash, line) of the lines that go."""
    hot = _hot_hashes(lines)
    later = _later_occurrences(lines.filter(~F.col("h1").isin(hot)), least_documents)
    if not hot:
        return later
    # A hash that would fill a partition is counted instead of sorted: one row for each task and document.
    often = lines.filter(F.col("h1").isin(hot))
    counted = often.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
    counted = counted.agg(F.count("*").alias("_n"), F.max("doc_id").alias("_keeper"))
    # HOT_NAMES rows at most, so they can go to every task.
    common = F.broadcast(counted.filter(F.col("_n") >= least_documents))
    gone = often.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    return later.unionByName(gone.select("doc_id", "text_hash", "line"))


def _later_occurrences(lines: DataFrame, least_documents: int) -> DataFrame:
    first = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = lines.repartitionByRange("h1").sortWithinPartitions(*first, "text_hash", "line")
    one_hash = Window.partitionBy("h1", "h2")
    ranked = ranged.withColumn("_rank", F.dense_rank().over(one_hash.orderBy(first[2])))
    counted = ranked.withColumn("_documents", F.max("_rank").over(one_hash))
    gone = counted.filter((F.col("_documents") >= least_documents) & (F.col("_rank") > 1))
    return gone.select("doc_id", "text_hash", "line")


def _hot_hashes(lines: DataFrame) -> list[int]:
    """Hashes of more lines than half a partition's share. They only choose between two ways to the same result."""
    named = F.expr(f"approx_top_k(h1, {HOT_NAMES}, {HOT_TRACKED})").alias("named")
    row = lines.agg(named, F.count("*").alias("n")).first()
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(100, HOT_PARTITIONS * row.n / partitions)
    return [x["item"] for x in row.named or [] if x["count"] > limit]


def _bitmaps(lines: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_dropped, dropped) from single lines; a line met twice counts once."""
    word = (F.col("line") / 64).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, line % 64)")
    words = lines.groupBy("doc_id", "text_hash", word).agg(F.bit_or(bit).alias("bits"))
    each = words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("sparse"),
        F.max("word").alias("last"),
        F.sum(F.bit_count("bits")).alias("n_dropped"),
    )
    dense = F.transform(F.sequence(F.lit(0), "last"), lambda w: F.coalesce(F.element_at("sparse", w), F.lit(0)))
    return each.select("doc_id", "text_hash", "n_dropped", dense.cast("array<bigint>").alias("dropped"))
