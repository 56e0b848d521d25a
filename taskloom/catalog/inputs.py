"""Inputs the registered queries share, derived from the supplied tables.

Results of the heavier steps are written once per session and folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import describe_sessions
from ..operators.label import label_raw_events, spread_over_slices, with_nearby_context
from ..operators.normalize import normalize_events
from ..operators.sessions import SLICE, assign_sessions, roll_up_sessions
from ..options import AnalyzeOptions
from ..plans.activity import raw_events, table
from ..plans.materialize import materialize, partitions
from ..plans.session import configure

# The supplied events are sparse: every duration is stretched by this factor.
STRETCH = 240
OPTIONS = AnalyzeOptions().stretched(STRETCH)
BUCKET_ROWS = 250_000

_known: dict = {}


def forget() -> None:
    _known.clear()


def _once(spark: SparkSession, sf_dir: str, name: str, build, by=None) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        _known[key] = materialize(build(), name, by, by and _tasks(spark, sf_dir))
    return _known[key]


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of events: enough for a task to sort its whole rows in memory."""
    key = (spark.sparkContext.applicationId, sf_dir, "tasks")
    if key not in _known:
        _known[key] = max(partitions(spark), -(-table(spark, sf_dir, "events").count() // BUCKET_ROWS))
    return _known[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return raw_events(spark, sf_dir)


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(raw(spark, sf_dir), OPTIONS.urls)


def in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = spread_over_slices(raw(spark, sf_dir), OPTIONS.labels)
    return with_nearby_context(normalize_events(spread, OPTIONS.urls), OPTIONS.labels)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "labelled",
        lambda: label_raw_events(raw(spark, sf_dir), OPTIONS.labels, OPTIONS.urls, _tasks(spark, sf_dir)),
        SLICE,
    )


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "assigned",
        lambda: assign_sessions(labelled(spark, sf_dir), OPTIONS.sessions, tasks=_tasks(spark, sf_dir)),
        SLICE,
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir)


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        a = assigned(spark, sf_dir)
        return describe_sessions(a, roll_up_sessions(a))

    return _once(spark, sf_dir, "described", build)


def one_stream(frame: DataFrame) -> DataFrame:
    """All users as one stream; event numbers are unique over users here."""
    return frame.withColumn("stream_id", F.lit("all"))


def signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible sessions grouped by workflow signature, as a SQL-computable clustering."""
    from pyspark.sql import Window

    d = one_stream(described(spark, sf_dir)).filter(
        F.col("duration_seconds") >= OPTIONS.clusters.min_duration_seconds
    )
    founders = d.groupBy("workflow_signature").agg(F.min("session_seq").alias("cluster_seq"))
    return d.join(founders, "workflow_signature")
