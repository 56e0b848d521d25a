"""Windowed reports, comparisons, snapshots and the review board."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import humanize_node, iso_utc, round_score
from ..options import AnalyzeOptions, ClusterOptions
from .clusters import cluster_lane
from .feedback import apply_feedback

LIST_SIZE = 5
STALE_AFTER_SECONDS = 300


# --- windows ----------------------------------------------------------------------


@dataclass(frozen=True)
class ReportWindow:
    window: str
    report_date: str
    timezone: str
    offset_minutes: int
    start: datetime | None = None
    end: datetime | None = None

    def shifted(self) -> "ReportWindow | None":
        """The window before this one: a day or a week earlier."""
        days = {"day": 1, "week": 7}.get(self.window)
        if days is None:
            return None
        earlier = date.fromisoformat(self.report_date) - timedelta(days=days)
        return resolve_window(self.window, earlier.isoformat(), self.offset_minutes, self.timezone)


def resolve_window(
    window: str, report_date: str, offset_minutes: int = 0, timezone_name: str = "UTC"
) -> ReportWindow:
    """Local calendar days at a fixed offset -> UTC instants."""
    if window not in ("all", "day", "week"):
        raise ValueError(f"unknown report window: {window}")
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", report_date):
        raise ValueError(f"invalid report date: {report_date}")
    day = date.fromisoformat(report_date)
    if window == "all":
        return ReportWindow(window, report_date, timezone_name, offset_minutes)

    def instant(d: date) -> datetime:
        midnight = datetime(d.year, d.month, d.day, tzinfo=timezone.utc)
        return midnight - timedelta(minutes=offset_minutes)

    first = day - timedelta(days=6 if window == "week" else 0)
    return ReportWindow(
        window, report_date, timezone_name, offset_minutes, instant(first), instant(day + timedelta(days=1))
    )


def window_bounds(window: Column, report_date: Column, offset_minutes: Column):
    """(start, end) columns for tables of windows; NULL for ``all``."""
    shift = F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes)
    first = F.when(window == "week", F.date_sub(report_date, 6)).when(window == "day", report_date)
    end = F.when(window.isin("day", "week"), F.date_add(report_date, 1))
    return first.cast("timestamp") - shift, end.cast("timestamp") - shift


def in_window(events: DataFrame, w: ReportWindow) -> DataFrame:
    """Rows of ``[start, end)``; a plain range filter that reaches the scan."""
    if w.start is None:
        return events
    return events.filter((F.col("ts") >= F.lit(w.start)) & (F.col("ts") < F.lit(w.end)))


def window_days(events: DataFrame, w: ReportWindow) -> DataFrame:
    """Length of the window in days per stream, at least 1."""
    if w.start is not None:
        days = max(1.0, (w.end - w.start) / timedelta(days=1))
        return events.select("stream_id").distinct().withColumn("days", F.lit(days))
    span = (F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))) / F.lit(86_400_000)
    return events.groupBy("stream_id").agg(
        F.when(F.count("*") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), span)).alias("days")
    )


# --- entries ----------------------------------------------------------------------


def visible(clusters: DataFrame, include_excluded=False, include_hidden=False) -> DataFrame:
    """I2."""
    kept = clusters
    if not include_excluded:
        kept = kept.filter(~F.col("excluded"))
    if not include_hidden:
        kept = kept.filter(~F.col("hidden"))
    return kept


def automation_score(grade: Column, confidence: Column) -> Column:
    base = F.when(grade == "high", 0.9).when(grade == "medium", 0.6).otherwise(0.3)
    return round_score(base * 0.7 + confidence * 0.3)


def workflow_graph(sequence: Column) -> Column:
    """The chain of steps as nodes, edges and text."""
    nodes = F.transform(sequence, humanize_node)
    edges = F.transform(
        F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0))),
        lambda n, i: F.struct(
            n.alias("from"), F.get(nodes, i + 1).alias("to"), F.lit(1).alias("weight")
        ),
    )
    return F.struct(
        nodes.alias("nodes"), edges.alias("edges"), F.array_join(nodes, " -> ").alias("text")
    )


def latest_labels(labels: DataFrame) -> DataFrame:
    """Newest external label per workflow (K5)."""
    newest = Window.partitionBy("workflow_cluster_id").orderBy(F.desc("created_at"))
    return labels.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def report_entries(
    clusters: DataFrame,
    days: DataFrame,
    labels: DataFrame | None = None,
    include_excluded: bool = False,
    include_hidden: bool = False,
) -> DataFrame:
    """Visible workflows as report rows (I4). ``clusters`` carry their feedback."""
    rows = visible(clusters, include_excluded, include_hidden).join(days, "stream_id", "left")
    if labels is not None:
        rows = rows.join(
            latest_labels(labels).select(
                F.col("workflow_cluster_id").alias("cluster_id"),
                F.col("workflow_name").alias("suggested_name"),
            ),
            "cluster_id",
            "left",
        )
    else:
        rows = rows.withColumn("suggested_name", F.lit(None).cast("string"))
    name, baseline = F.col("name"), F.col("baseline_name")
    source = (
        F.when(name == baseline, F.lit("baseline"))
        .when(F.col("suggested_name") == name, F.lit("llm_overlay"))
        .otherwise(F.lit("feedback"))
    )
    per_week = round_score(F.col("frequency") / F.coalesce("days", F.lit(1.0)) * 7)
    return rows.select(
        "stream_id",
        "cluster_id",
        "workflow_signature",
        "detection_mode",
        name.alias("workflow_name"),
        baseline.alias("baseline_workflow_name"),
        source.alias("workflow_name_source"),
        "suggested_name",
        "business_purpose",
        "frequency",
        per_week.alias("frequency_per_week"),
        "average_duration_seconds",
        "total_duration_seconds",
        "representative_sequence",
        "representative_steps",
        "involved_apps",
        automation_score(F.col("automation_suitability"), F.col("confidence_score")).alias(
            "automation_suitability_score"
        ),
        "confidence_score",
        "user_labeled",
        workflow_graph(F.col("representative_sequence")).alias("graph"),
        "automation_suitability",
        "recommended_approach",
        "automation_hints",
        "automation_candidate",
        "approved_automation_candidate",
    )


def in_report_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy(
        "stream_id",
        F.col("detection_mode") == "short_form",
        F.desc("frequency"),
        F.desc("total_duration_seconds"),
        "workflow_signature",
    )


def summary_lists(entries: DataFrame) -> DataFrame:
    """The four top-5 lists of a report, tagged by ``list``."""
    stream = Window.partitionBy("stream_id")
    # A stream without repeated workflows falls back to the ones users labelled.
    repeats = F.coalesce(F.max((F.col("frequency") >= 2).cast("int")).over(stream), F.lit(0)) == 1
    known = entries.withColumn("_repeats", repeats)
    repetitive = F.when(F.col("_repeats"), F.col("frequency") >= 2).otherwise(F.col("user_labeled"))
    total, tie = F.desc("total_duration_seconds"), F.col("workflow_signature")
    quick = (
        (F.col("detection_mode") == "standard")
        & (F.col("automation_suitability_score") >= 0.6)
        & (F.col("confidence_score") >= 0.6)
    )
    judge = (
        (F.col("confidence_score") < 0.65)
        | (F.col("automation_suitability") == "low")
        | ~F.col("user_labeled")
    )
    lists = {
        "top_repetitive": (repetitive, [F.desc("frequency"), total, tie]),
        "most_time": (repetitive, [total, tie]),
        "quick_wins": (quick, [F.desc("automation_suitability_score"), total, tie]),
        "needs_judgment": (judge, [F.asc("confidence_score"), tie]),
    }
    out = None
    for name, (test, order) in lists.items():
        ranked = (
            known.filter(test)
            .withColumn("rank", F.row_number().over(stream.orderBy(*order)))
            .filter(F.col("rank") <= LIST_SIZE)
            .withColumn("list", F.lit(name))
            .drop("_repeats")
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out


def emerging_workflows(
    described: DataFrame,
    assigned: DataFrame,
    confirmed: DataFrame,
    folded: DataFrame,
    include_excluded: bool = False,
    include_hidden: bool = False,
) -> DataFrame:
    """Provisional workflows that are not confirmed yet (I7). Always default thresholds."""
    lax = ClusterOptions(min_frequency=1, min_duration_seconds=0)
    provisional, _ = cluster_lane(described, assigned, lax)
    fresh = provisional.join(
        confirmed.select("stream_id", "cluster_id"), ["stream_id", "cluster_id"], "left_anti"
    )
    shown = visible(apply_feedback(fresh, folded), include_excluded, include_hidden)
    return shown.select(
        "stream_id",
        "cluster_id",
        F.col("name").alias("workflow_name"),
        "frequency",
        "average_duration_seconds",
        "total_duration_seconds",
        "representative_steps",
        F.lit("provisional").alias("confidence"),
    )


def report_totals(sessions: DataFrame) -> DataFrame:
    """Sessions and tracked time per stream (I8)."""
    ms = F.greatest(F.lit(0), F.unix_millis("end_ts") - F.unix_millis("start_ts"))
    return sessions.groupBy("stream_id").agg(
        F.count("*").alias("total_sessions"),
        (F.coalesce(F.sum(ms), F.lit(0)) / F.lit(1000)).alias("total_tracked_seconds"),
    )


# --- comparison -------------------------------------------------------------------


def compare_reports(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Workflows of two reports side by side, tagged new / disappeared / continued."""
    fields = ["cluster_id", "workflow_name", "frequency", "total_duration_seconds",
              "approved_automation_candidate"]
    keys = ["stream_id", "workflow_signature"]

    def side(entries: DataFrame, prefix: str) -> DataFrame:
        # Two entries can share a signature; as in a keyed table, the last one counts.
        last = Window.partitionBy(*keys).orderBy("frequency", "total_duration_seconds")
        one = entries.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        return one.select(*keys, F.struct(*fields).alias(prefix))

    joined = side(current, "c").join(side(previous, "p"), keys, "full_outer")
    c, p = F.col("c"), F.col("p")

    def number(s: Column, f: str) -> Column:
        return F.coalesce(s[f], F.lit(0))

    change = (
        F.when(p.isNull(), F.lit("new"))
        .when(c.isNull(), F.lit("disappeared"))
        .otherwise(F.lit("continued"))
    )
    both = c.isNotNull() & p.isNotNull() & (c["workflow_name"] != p["workflow_name"])
    return joined.select(
        *keys,
        change.alias("change"),
        F.coalesce(c["cluster_id"], p["cluster_id"]).alias("cluster_id"),
        F.coalesce(c["workflow_name"], p["workflow_name"]).alias("workflow_name"),
        F.when(both, p["workflow_name"]).alias("previous_workflow_name"),
        number(c, "frequency").alias("current_frequency"),
        number(p, "frequency").alias("previous_frequency"),
        (number(c, "frequency") - number(p, "frequency")).alias("frequency_delta"),
        number(c, "total_duration_seconds").alias("current_total_seconds"),
        number(p, "total_duration_seconds").alias("previous_total_seconds"),
        (number(c, "total_duration_seconds") - number(p, "total_duration_seconds")).alias(
            "total_seconds_delta"
        ),
        F.coalesce(
            c["approved_automation_candidate"], p["approved_automation_candidate"]
        ).alias("approved_automation_candidate"),
    )


def approved_changes(comparison: DataFrame) -> DataFrame:
    """Approved candidates whose time or frequency moved, biggest move first."""
    moved = (F.col("total_seconds_delta") != 0) | (F.col("frequency_delta") != 0)
    return comparison.filter(F.col("approved_automation_candidate") & moved).orderBy(
        F.desc(F.abs("total_seconds_delta")), F.desc(F.abs("frequency_delta"))
    )


def compare_totals(
    current: DataFrame,
    previous: DataFrame,
    current_totals: DataFrame,
    previous_totals: DataFrame,
    current_emerging: DataFrame | None = None,
    previous_emerging: DataFrame | None = None,
) -> DataFrame:
    """Changes of the totals between two reports per stream.

    The last two frames are the reports' emerging workflows; without them their change is 0.
    """
    approved = F.coalesce(F.col("approved_automation_candidate"), F.lit(False))

    def sums(entries: DataFrame, totals: DataFrame, emerging: DataFrame | None, sign: int) -> DataFrame:
        counted = entries.groupBy("stream_id").agg(
            F.count("*").alias("workflows"),
            F.count(F.when(approved, 1)).alias("approved"),
            F.sum(F.when(approved, F.col("total_duration_seconds")).otherwise(0.0)).alias("approved_seconds"),
        )
        joined = totals.join(counted, "stream_id", "full_outer")
        if emerging is None:
            joined = joined.withColumn("emerging", F.lit(0).cast("long"))
        else:
            found = emerging.groupBy("stream_id").agg(F.count("*").alias("emerging"))
            joined = joined.join(found, "stream_id", "full_outer")
        joined = joined.na.fill(0)
        values = [
            "total_sessions", "total_tracked_seconds", "workflows", "emerging", "approved", "approved_seconds",
        ]
        return joined.select("stream_id", *[(F.col(v) * sign).alias(v) for v in values])

    both = sums(current, current_totals, current_emerging, 1).unionByName(
        sums(previous, previous_totals, previous_emerging, -1)
    )
    return both.groupBy("stream_id").agg(
        F.sum("total_sessions").alias("session_delta"),
        F.sum("total_tracked_seconds").alias("tracked_seconds_delta"),
        F.sum("workflows").alias("confirmed_workflow_delta"),
        F.sum("emerging").alias("emerging_workflow_delta"),
        F.sum("approved").alias("approved_candidate_delta"),
        F.sum("approved_seconds").alias("approved_candidate_seconds_delta"),
    )


# --- snapshots --------------------------------------------------------------------

SNAPSHOT_KEY = ["stream_id", "window", "report_date", "timezone"]


def make_snapshot(
    entries: DataFrame, emerging: DataFrame | None, totals: DataFrame, w: ReportWindow, generated_at: Column
) -> DataFrame:
    """One stored report per stream."""
    row = F.struct(*[c for c in entries.columns if c != "stream_id"])
    order = F.struct(
        (F.col("detection_mode") == "short_form"), -F.col("frequency"), -F.col("total_duration_seconds")
    )
    listed = entries.groupBy("stream_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), "cluster_id", F.to_json(row).alias("r")))),
            lambda s: s["r"],
        ).alias("workflows")
    )
    out = totals.join(listed, "stream_id", "left")
    if emerging is not None:
        out = out.join(
            emerging.groupBy("stream_id").agg(
                F.array_sort(F.collect_list(F.to_json(F.struct("*")))).alias("emerging")
            ),
            "stream_id",
            "left",
        )
    else:
        out = out.withColumn("emerging", F.lit(None).cast("array<string>"))
    key = [F.lit(w.window).alias("window"), F.lit(w.report_date).alias("report_date"), F.lit(w.timezone).alias("timezone")]
    return out.select(
        F.sha1(F.concat_ws(":", F.lit("snapshot"), "stream_id", *key)).alias("id"),
        "stream_id",
        *key,
        F.lit(w.offset_minutes).alias("timezone_offset_minutes"),
        F.lit(w.start).cast("timestamp").alias("start_time"),
        F.lit(w.end).cast("timestamp").alias("end_time"),
        "total_sessions",
        "total_tracked_seconds",
        F.coalesce("workflows", F.array().cast("array<string>")).alias("workflows"),
        F.coalesce("emerging", F.array().cast("array<string>")).alias("emerging"),
        generated_at.alias("generated_at"),
    )


def upsert_snapshots(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows replace stored ones of the same key but keep their id."""
    kept = stored.join(fresh.select(*SNAPSHOT_KEY), SNAPSHOT_KEY, "left_anti")
    old = stored.select(*SNAPSHOT_KEY, F.col("id").alias("_old"))
    replaced = (
        fresh.join(old, SNAPSHOT_KEY, "left")
        .withColumn("id", F.coalesce("_old", "id"))
        .select(*stored.columns)
    )
    return kept.select(*stored.columns).unionByName(replaced)


def list_snapshots(
    stored: DataFrame, window: str | None = None, timezone_name: str | None = None, limit: int = 50
) -> DataFrame:
    """I12."""
    kept = stored
    if window is not None:
        kept = kept.filter(F.col("window") == window)
    if timezone_name is not None:
        kept = kept.filter(F.col("timezone") == timezone_name)
    return (
        kept.orderBy(F.desc("report_date"), F.desc("generated_at"), "window", "stream_id")
        .limit(limit)
        .select(
            "id", "stream_id", "window", "report_date", "timezone", "total_sessions",
            F.size("workflows").alias("workflow_count"),
            F.size("emerging").alias("emerging_workflow_count"),
            "generated_at",
        )
    )


def latest_snapshots(stored: DataFrame, report_date: str | None = None) -> DataFrame:
    """Newest snapshot per stream, window and timezone, optionally of one date."""
    kept = stored if report_date is None else stored.filter(F.col("report_date") == report_date)
    newest = Window.partitionBy("stream_id", "window", "timezone").orderBy(
        F.desc("report_date"), F.desc("generated_at")
    )
    return kept.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def report_freshness(streams: DataFrame, stored: DataFrame, w: ReportWindow, now: Column) -> DataFrame:
    """fresh / stale / missing, per stream (I13). ``streams``: (stream_id, latest_raw_event_at)."""
    known = latest_snapshots(
        stored.filter((F.col("window") == w.window) & (F.col("timezone") == w.timezone))
    ).select("stream_id", F.col("generated_at").alias("latest_snapshot_at"))
    age = F.unix_millis(now) - F.unix_millis("latest_snapshot_at")
    status = (
        F.when(F.col("latest_snapshot_at").isNull() | F.lit(w.window == "all"), F.lit("missing"))
        .when(age > STALE_AFTER_SECONDS * 1000, F.lit("stale"))
        .otherwise(F.lit("fresh"))
    )
    return streams.join(known, "stream_id", "left").withColumn("snapshot_status", status)


def report_cycle(
    raw: DataFrame,
    windows: list[ReportWindow],
    generated_at: Column,
    folded: DataFrame | None = None,
    options: AnalyzeOptions = AnalyzeOptions(),
) -> DataFrame:
    """Snapshots of every stream for every window."""
    from ..plans.analysis import analyze

    out = None
    for w in windows:
        events = in_window(raw, w)
        run = analyze(events, options, folded)
        feedback = folded if folded is not None else empty_feedback(raw.sparkSession)
        applied = apply_feedback(run.clusters, feedback)
        entries = report_entries(applied, window_days(events, w))
        emerging = None
        if w.window != "all":
            emerging = emerging_workflows(run.described, run.assigned, applied, feedback)
        one = make_snapshot(entries, emerging, report_totals(run.sessions), w, generated_at)
        out = one if out is None else out.unionByName(one)
    return out


def empty_feedback(spark) -> DataFrame:
    from ..schema import FEEDBACK
    from .feedback import fold_feedback

    return fold_feedback(spark.createDataFrame([], FEEDBACK))


# --- review board -----------------------------------------------------------------


def session_summaries(sessions: DataFrame) -> DataFrame:
    seconds = F.greatest(
        F.lit(0.0), (F.unix_millis("end_ts") - F.unix_millis("start_ts")) / F.lit(1000)
    )
    return sessions.select(
        "stream_id", "session_seq", "session_id", "start_time", "end_time",
        seconds.alias("duration_seconds"), "primary_application", "primary_domain",
        "boundary_reason", "step_count",
    )


def review_board(clusters: DataFrame, entries: DataFrame) -> DataFrame:
    """Workflows for review with a visibility flag, in board order (I16)."""
    shown = entries.select("stream_id", "cluster_id").distinct().withColumn("visible_in_report", F.lit(True))
    return (
        clusters.join(shown, ["stream_id", "cluster_id"], "left")
        .withColumn("visible_in_report", F.coalesce("visible_in_report", F.lit(False)))
        .orderBy(
            F.col("detection_mode") == "short_form",
            "hidden",
            "excluded",
            F.desc("frequency"),
            F.desc("total_duration_seconds"),
            "name",
        )
    )


def board_sessions(bridge: DataFrame, sessions: DataFrame) -> DataFrame:
    """The sessions of each workflow on the board, one row each (I16)."""
    return bridge.drop("session_id").join(session_summaries(sessions), ["stream_id", "session_seq"])
