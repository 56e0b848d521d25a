"""Reading events (A1-A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, iso_utc, stable_id
from ..schema import INCOMING, RAW_COLUMNS
from .large_json import read_large_json

CORRUPT = "_corrupt_record"
LINE_SUFFIXES = (".ndjson", ".jsonl")


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def read_ndjson(spark: SparkSession, path) -> DataFrame:
    """One event per line; blank lines are skipped, unreadable ones kept aside (A1)."""
    return spark.read.schema(_with_corrupt(INCOMING)).json(path)


def read_json(spark: SparkSession, path) -> DataFrame:
    """An array, an ``{"events": [...]}`` wrapper or a single event per file (A2).

    One such file is one JSON value and is read by one task; for large ones see ``read_large_events``.
    """
    wrapped = T.StructType(
        INCOMING.fields
        + [T.StructField("events", T.ArrayType(INCOMING)), T.StructField(CORRUPT, T.StringType())]
    )
    rows = spark.read.schema(wrapped).option("multiLine", True).json(path)
    own = F.struct(*[F.col(f.name) for f in INCOMING.fields])
    picked = rows.select(
        F.explode_outer(
            F.when(F.col("events").isNotNull(), F.col("events")).otherwise(F.array(own))
        ).alias("e"),
        CORRUPT,
        (F.col("events").isNotNull() & (F.size("events") == 0)).alias("empty"),
    )
    return picked.filter(~F.col("empty") | F.col("empty").isNull()).select("e.*", CORRUPT)


def read_large_events(spark: SparkSession, path: str) -> DataFrame:
    """The same for files of one large array or wrapper, which are split over tasks (A2)."""
    return read_large_json(spark, path, INCOMING, CORRUPT)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Choose the reader by file name, or by the first character of the text (A3)."""
    lowered = path.lower()
    if lowered.endswith(LINE_SUFFIXES):
        return read_ndjson(spark, path)
    if not lowered.endswith(".json"):
        first = (
            spark.read.text(path).filter(F.trim("value") != "").limit(1).select(F.trim("value").substr(1, 1))
        ).first()
        if first is None or first[0] not in "{[":
            return read_ndjson(spark, path)
    return read_json(spark, path)


def coerce_events(
    incoming: DataFrame, received_at: Column | None = None, stream: str = "local"
) -> tuple[DataFrame, DataFrame]:
    """(accepted raw events, rejected rows): trimmed, defaulted, typed (A4).

    Rows without a ``seq`` get a number from their content, so reading them again gives the
    same ids however the files are split.
    """
    now = iso_utc(F.current_timestamp() if received_at is None else received_at)
    kind = blank_to_null(F.col("sourceEventType"))
    content = [F.col(f.name) for f in INCOMING.fields if f.name != "seq"]
    number = F.coalesce("seq", F.pmod(F.xxhash64(*content), F.lit(2**53)))

    def text(name: str) -> Column:
        return blank_to_null(F.col(name))

    named = incoming.select(
        F.coalesce(text("stream_id"), F.lit(stream)).alias("stream_id"),
        number.alias("seq"),
        F.try_to_timestamp(text("timestamp")).alias("ts"),
        F.coalesce(text("timestamp"), now).alias("ts_text"),
        F.coalesce(text("source"), F.lit("chrome_extension")).alias("source"),
        kind.alias("source_event_type"),
        F.coalesce(text("application"), F.lit("chrome")).alias("application"),
        text("windowTitle").alias("window_title"),
        text("domain").alias("domain"),
        text("url").alias("url"),
        F.col("browserSchemaVersion").alias("browser_schema_version"),
        text("canonicalUrl").alias("canonical_url"),
        text("routeTemplate").alias("route_template"),
        text("routeKey").alias("route_key"),
        text("resourceHash").alias("resource_hash"),
        F.coalesce(text("action"), F.element_at(F.split(kind, r"\."), -1)).alias("action"),
        text("target").alias("target"),
        F.when(F.col("metadata").startswith("{"), F.col("metadata"))
        .otherwise(F.lit("{}"))
        .alias("metadata"),
        (F.col(CORRUPT) if CORRUPT in incoming.columns else F.lit(None).cast("string")).alias(CORRUPT),
    )
    identity = stable_id(
        "raw_event",
        F.col("stream_id"),
        F.coalesce(F.col("seq").cast("string"), F.lit("")),
        F.col("ts_text"),
        F.col("source_event_type"),
        F.col("application"),
        F.coalesce("url", F.lit("")),
        F.coalesce("target", F.lit("")),
    )
    good = F.col(CORRUPT).isNull() & F.col("source_event_type").isNotNull()
    accepted = (
        named.filter(good)
        .withColumn("ts", F.coalesce("ts", F.try_to_timestamp("ts_text")))
        .withColumn("id", identity)
        .select(*RAW_COLUMNS)
    )
    rejected = named.filter(~good).select(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("unreadable record"))
        .otherwise(F.lit("sourceEventType is required"))
        .alias("error"),
        "stream_id",
        "ts_text",
        CORRUPT,
    )
    return accepted, rejected
