"""One large JSON document read by many tasks (A2).

A JSON array is one value, so Spark's reader gives it to one task. Here the file is split like lines of text that end in
``}``. Where a piece stands in the document follows from running sums over the pieces before it: an odd number of quotes
says that it begins inside a string, brackets outside strings give its depth, and a piece that closes a bracket at the
depth of the events ends an event. Sums run inside a split, and what comes before a split is one row for each split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import materialize

SPLIT = ["file", "block"]
WRAPPER = r'^\s*\{\s*"events"\s*:\s*\['


def running(pieces: DataFrame, value: Column, into: str) -> DataFrame:
    """Add the sum of ``value`` over all pieces of the file before this one."""
    own = pieces.withColumn("_value", value.cast("long"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = own.groupBy(*SPLIT).agg(F.sum("_value").alias("_sum"))
    splits = splits.select(*SPLIT, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*SPLIT).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return (
        own.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(splits, SPLIT)
        .withColumn(into, F.col("_inside") + F.col("_before"))
        .drop("_value", "_inside", "_before")
    )


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def read_large_json(spark: SparkSession, path: str, schema: T.StructType, corrupt: str) -> DataFrame:
    """The events of documents that are an array of objects or ``{"events": [...]}``, in columns of ``schema``.

    ``corrupt`` names the column that holds the text of events that cannot be read, and of what a broken document has
    after its last whole event. Strings may hold brackets and escaped quotes, objects may be nested and lines may break
    anywhere. Blank files have no events.
    """
    lines = spark.read.option("lineSep", "}").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    pieces = lines.select(
        F.col("file_path").alias("file"),
        F.col("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("text"),
    )
    plain = F.regexp_replace("text", r"\\(?s).", "")
    pieces = materialize(pieces.withColumn("quotes", _count(plain, '"')), "pieces")
    pieces = running(pieces, F.col("quotes"), "quotes_before")
    # Outside strings: what begins or ends inside one loses that part.
    opened = F.when(F.col("quotes_before") % 2 == 1, F.concat(F.lit('"'), plain)).otherwise(plain)
    bare = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    change = _count(bare, "{[") - _count(bare, "}]")
    pieces = pieces.withColumns({"change": change.cast("long"), "closes": closes})
    pieces = pieces.withColumn("change", F.col("change") - F.when(F.col("closes"), 1).otherwise(0))
    pieces = materialize(running(pieces, F.col("change"), "depth_before"), "depths")
    heads = pieces.groupBy("file").agg(F.min_by("text", F.struct("block", "n")).alias("head"))
    heads = heads.select("file", F.when(F.col("head").rlike(WRAPPER), 2).otherwise(1).alias("level"))
    ends = F.col("closes") & (F.col("depth_before") + F.col("change") == F.col("level"))
    placed = pieces.join(heads, "file").withColumn("ends", ends)
    placed = running(placed, F.when(F.col("ends"), 1).otherwise(0), "event")
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "text")))
    events = placed.groupBy("file", "event", "level").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "}").alias("text"), F.max("ends").alias("whole")
    )
    start = F.when(F.col("event") == 0, F.when(F.col("level") == 2, F.lit(WRAPPER)).otherwise(F.lit(r"^\s*\[")))
    text = F.regexp_replace("text", F.coalesce(start, F.lit(r"^\s*,")), "")
    events = events.withColumn("text", F.trim(F.translate(text, "\r\n\t", "   ")))
    events = events.withColumn("text", F.when(F.col("whole"), F.concat("text", F.lit("}"))).otherwise(F.col("text")))
    # Behind the last event only the document's own brackets are left.
    rest = ~F.col("whole") & F.col("text").rlike(r"^[\s\]}]*$")
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    read = F.from_json("text", full, {"columnNameOfCorruptRecord": corrupt, "mode": "PERMISSIVE"})
    return events.filter(~rest).select(read.alias("e")).select("e.*")
