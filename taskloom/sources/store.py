"""Stored tables: events by day, analysis runs behind a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.privacy import sanitize_events
from ..operators.sessions import SESSION, session_steps
from ..options import UrlOptions


def by_day(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("ts"))


def append_events(events: DataFrame, path: str) -> None:
    by_day(events).write.mode("append").partitionBy("event_date").parquet(path)


def events_between(events: DataFrame, start, end) -> DataFrame:
    """``[start, end)`` in time order; prunes days and pushes the range down."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    kept = events.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    if "event_date" in events.columns:
        kept = kept.filter(F.col("event_date").between(F.to_date(lo), F.to_date(hi)))
    return kept.orderBy("ts", "seq")


def latest_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """A7."""
    return events.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def event_by_id(events: DataFrame, event_id: str, column: str = "id") -> DataFrame:
    """By raw or normalised id."""
    return events.filter(F.col(column) == event_id)


TABLES = ("events", "sessions", "steps", "clusters", "bridge")


def write_analysis(run, path: str, at: Column | None = None) -> str:
    """Store one run in a directory of its own, then point to it.

    Readers follow the pointer and so never see a half-written run.
    """
    name = f"run-{uuid.uuid4().hex}"
    spark = run.events.sparkSession
    frames = {
        "sessions": run.sessions,
        "steps": session_steps(run.assigned),
        "clusters": run.clusters,
        "bridge": run.bridge,
    }
    by_day(run.events).write.partitionBy("event_date").parquet(f"{path}/{name}/events")
    for table, frame in frames.items():
        frame.write.parquet(f"{path}/{name}/{table}")
    pointer = spark.range(1).select(
        F.lit(name).alias("run"), (F.current_timestamp() if at is None else at).alias("written_at")
    )
    pointer.write.mode("append").parquet(f"{path}/pointer")
    return name


def read_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """Tables of the newest complete run, None if there is none."""
    try:
        newest = spark.read.parquet(f"{path}/pointer").orderBy(F.desc("written_at")).first()
    except AnalysisException:
        return None
    return {t: spark.read.parquet(f"{path}/{newest['run']}/{t}") for t in TABLES}


def without_session(raw: DataFrame, steps: DataFrame, sessions: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Raw events without those of the given sessions (A8). ``session_ids``: session_id."""
    doomed = (
        steps.join(sessions.select(*SESSION, "session_id"), SESSION)
        .join(session_ids, "session_id", "left_semi")
        .select(F.col("raw_event_id").alias("id"))
    )
    return raw.join(doomed, "id", "left_anti")


def refresh_events(raw: DataFrame, options: UrlOptions = UrlOptions()) -> DataFrame:
    """Stored events under the current privacy rules."""
    return sanitize_events(raw, options)
