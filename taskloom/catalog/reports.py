"""Queries for reports, inspection, payloads, derivation and streaming (B, I, J, K, L)."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.text import duration_text, iso_utc, savings_text
from ..operators import clusters as C
from ..operators import derive as B
from ..operators import feedback as H
from ..operators import inspect as J
from ..operators import payloads as K
from ..operators import report as R
from ..operators.sessions import session_steps
from ..options import SessionOptions
from ..plans.activity import raw_events, table
from ..plans.materialize import scratch_dir
from ..plans.session import configure
from ..schema import FEEDBACK_FIELDS
from ..streaming import live, refresh
from . import inputs as I
from . import sql as Q
from .registry import query
from .workflows import WIDE, _EMERGING, _FACTS, _HUMAN, _LANES, _LOG, _lane, _log, _membership_sql, _peer_texts, _stream_clusters, _summary

c = F.col


def _feedback(clusters):
    """Decisions that follow from the number of each workflow's founder."""
    n = c("cluster_seq")
    values = {
        "rename_to": F.when(n % 3 == 0, F.concat(F.lit("Renamed "), n.cast("string"))),
        "excluded": F.when(n % 7 == 0, F.lit(True)),
        "hidden": F.when(n % 5 == 0, F.lit(True)),
        "approved_automation_candidate": F.when(n % 2 == 0, F.lit(True)),
    }
    texts = {"rename_to", "business_purpose", "automation_difficulty", "merge_into_workflow_id",
             "merge_into_workflow_signature", "split_after_action_name"}
    full = [
        values.get(f, F.lit(None)).cast("string" if f in texts else "boolean").alias(f)
        for f in FEEDBACK_FIELDS
    ]
    return clusters.select(c("workflow_signature").alias("key"), F.struct(*full).alias("feedback"))


def _applied(spark, sf_dir):
    clusters = _summary(spark, sf_dir)
    return H.apply_feedback(clusters, _feedback(clusters))


def _entries(spark, sf_dir):
    window = R.resolve_window("all", "2024-01-31")
    days = R.window_days(I.one_stream(I.raw(spark, sf_dir)), window)
    return R.report_entries(_applied(spark, sf_dir), days)


_ENTRIES = _FACTS + f""",
span AS (SELECT greatest(1, (epoch_ms(MAX(ts)) - epoch_ms(MIN(ts))) / 86400000) AS days FROM activity),
applied AS (SELECT *, cluster_seq % 7 = 0 AS excluded, cluster_seq % 5 = 0 AS hidden, cluster_seq % 2 = 0 AS approved, {_HUMAN.format('main')} || ' workflow' AS baseline,
    coalesce(CASE WHEN cluster_seq % 3 = 0 THEN 'Renamed ' || cluster_seq END, {_HUMAN.format('main')} || ' workflow') AS name,
    CASE WHEN cluster_seq % 3 = 0 OR cluster_seq % 7 = 0 OR cluster_seq % 5 = 0 OR cluster_seq % 2 = 0 THEN true ELSE false END AS user_labeled,
    floor((CASE grade WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 ELSE 0.3 END * 0.7 + confidence * 0.3) * 100 + 0.5) / 100 AS score FROM facts),
entries AS (SELECT *, floor(n / days * 7 * 100 + 0.5) / 100 AS per_week FROM applied, span WHERE NOT excluded AND NOT hidden)"""


# --- reports ----------------------------------------------------------------------


@query(
    "i1_window_bounds",
    """SELECT d AS report_date, w AS "window", d::TIMESTAMP - INTERVAL 540 MINUTE - CASE WHEN w = 'week' THEN INTERVAL 6 DAY ELSE INTERVAL 0 DAY END AS start_time,
      d::TIMESTAMP - INTERVAL 540 MINUTE + INTERVAL 1 DAY AS end_time FROM (SELECT DISTINCT ts::DATE AS d FROM events), (VALUES ('day'), ('week')) v(w)""",
)
def i1(spark, sf_dir):
    configure(spark)
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("report_date")).distinct()
    rows = days.withColumn("window", F.explode(F.array(F.lit("day"), F.lit("week"))))
    start, end = R.window_bounds(c("window"), c("report_date"), F.lit(540))
    return rows.select("report_date", "window", start.alias("start_time"), end.alias("end_time"))


@query("i2_visible_workflows", Q.upto("grouped", "SELECT cluster_seq FROM entries", _ENTRIES))
def i2(spark, sf_dir):
    return R.visible(_applied(spark, sf_dir)).select("cluster_seq")


@query(
    "i3_window_days",
    Q.upto("activity", "SELECT stream_id, round(greatest(1, (epoch_ms(MAX(ts)) - epoch_ms(MIN(ts))) / 86400000), 6) AS days FROM activity GROUP BY 1"),
)
def i3(spark, sf_dir):
    days = R.window_days(I.raw(spark, sf_dir), R.resolve_window("all", "2024-01-31"))
    return days.select("stream_id", F.round("days", 6).alias("days"))


@query(
    "i4_report_entries",
    Q.upto("grouped", """SELECT workflow_signature, name AS workflow_name, CASE WHEN name = baseline THEN 'baseline' ELSE 'feedback' END AS workflow_name_source, n AS frequency,
      per_week AS frequency_per_week, round(secs, 3) AS total_duration_seconds, score AS automation_suitability_score, user_labeled FROM entries""", _ENTRIES),
)
def i4(spark, sf_dir):
    return _entries(spark, sf_dir).select(
        "workflow_signature", "workflow_name", "workflow_name_source", "frequency", "frequency_per_week",
        F.round("total_duration_seconds", 3).alias("total_duration_seconds"), "automation_suitability_score", "user_labeled",
    )


@query(
    "i5_workflow_graph",
    Q.upto("described", f"""SELECT session_seq, array_to_string(list_transform(actions, lambda a: {_HUMAN.format('a')}), ' -> ') AS text, len(actions) AS nodes, len(actions) - 1 AS edges FROM described"""),
)
def i5(spark, sf_dir):
    g = I.described(spark, sf_dir).select("session_seq", R.workflow_graph(c("actions")).alias("g"))
    return g.select("session_seq", "g.text", F.size("g.nodes").alias("nodes"), F.size("g.edges").alias("edges"))


@query(
    "i6_summary_lists",
    Q.upto("grouped", """SELECT 'top_repetitive' AS list, row_number() OVER (ORDER BY n DESC, secs DESC, workflow_signature) AS rank, workflow_signature FROM entries QUALIFY rank <= 5
      UNION ALL SELECT 'most_time', row_number() OVER (ORDER BY secs DESC, workflow_signature) AS rank, workflow_signature FROM entries QUALIFY rank <= 5
      UNION ALL SELECT 'quick_wins', row_number() OVER (ORDER BY score DESC, secs DESC, workflow_signature) AS rank, workflow_signature FROM entries WHERE score >= 0.6 AND confidence >= 0.6 QUALIFY rank <= 5
      UNION ALL SELECT 'needs_judgment', row_number() OVER (ORDER BY confidence, workflow_signature) AS rank, workflow_signature FROM entries WHERE confidence < 0.65 OR grade = 'low' OR NOT user_labeled QUALIFY rank <= 5""", _ENTRIES),
)
def i6(spark, sf_dir):
    return R.summary_lists(_entries(spark, sf_dir)).select("list", "rank", "workflow_signature")


@query("i7_emerging_workflows", Q.upto("grouped", f"""SELECT stream_id, cluster_id, {_HUMAN.format('main')} || ' workflow' AS workflow_name,
  size AS frequency, secs AS total_duration_seconds FROM hints h
  ANTI JOIN (SELECT stream_id, sha1('workflow_cluster:' || signature) AS cluster_id FROM flow) f USING (stream_id, cluster_id)""",
  _lane("", "grp0", 0.74, 3) + "," + _EMERGING))
def i7(spark, sf_dir):
    none = R.empty_feedback(spark)
    d, a = I.described(spark, sf_dir), I.assigned(spark, sf_dir)
    confirmed, _ = C.cluster_lane(d, a, I.OPTIONS.clusters)
    return R.emerging_workflows(d, a, confirmed, none).select(
        "stream_id", "cluster_id", "workflow_name", "frequency", "total_duration_seconds"
    )


@query(
    "i8_report_totals",
    Q.upto("described", "SELECT stream_id, COUNT(*) AS total_sessions, round(SUM(duration_seconds), 3) AS total_tracked_seconds FROM described GROUP BY 1"),
)
def i8(spark, sf_dir):
    t = R.report_totals(I.described(spark, sf_dir))
    return t.select("stream_id", "total_sessions", F.round("total_tracked_seconds", 3).alias("total_tracked_seconds"))


CURRENT = R.resolve_window("week", "2024-01-21")


def _window_entries(spark, sf_dir, w):
    """Signature groups of the sessions of one report window as entries."""
    d = I.one_stream(R.in_window(I.described(spark, sf_dir).withColumn("ts", c("start_ts")), w))
    return d.groupBy("stream_id", "workflow_signature").agg(
        F.sha1(F.concat(F.lit("workflow_cluster:"), c("workflow_signature"))).alias("cluster_id"),
        F.lit("w").alias("workflow_name"),
        F.count("*").alias("frequency"),
        F.sum("duration_seconds").alias("total_duration_seconds"),
        (F.max(F.size("actions")) > 1).alias("approved_automation_candidate"),
    )


_WINDOWS = """cur AS (SELECT workflow_signature, COUNT(*) AS n, SUM(duration_seconds) AS secs, MAX(len(actions)) > 1 AS approved FROM described
    WHERE start_ts >= TIMESTAMP '2024-01-15' AND start_ts < TIMESTAMP '2024-01-22' GROUP BY 1),
prv AS (SELECT workflow_signature, COUNT(*) AS n, SUM(duration_seconds) AS secs, MAX(len(actions)) > 1 AS approved FROM described
    WHERE start_ts >= TIMESTAMP '2024-01-08' AND start_ts < TIMESTAMP '2024-01-15' GROUP BY 1),
cmp AS (SELECT coalesce(c.workflow_signature, q.workflow_signature) AS workflow_signature,
    CASE WHEN q.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'disappeared' ELSE 'continued' END AS change,
    coalesce(c.n, 0) - coalesce(q.n, 0) AS frequency_delta, round(coalesce(c.secs, 0) - coalesce(q.secs, 0), 3) AS total_seconds_delta, coalesce(c.approved, q.approved) AS approved
  FROM cur c FULL OUTER JOIN prv q ON c.workflow_signature = q.workflow_signature)"""


def _comparison(spark, sf_dir):
    return R.compare_reports(
        _window_entries(spark, sf_dir, CURRENT), _window_entries(spark, sf_dir, CURRENT.shifted())
    )


@query("i9_report_comparison", Q.upto("described", "SELECT workflow_signature, change, frequency_delta, total_seconds_delta FROM cmp", _WINDOWS))
def i9(spark, sf_dir):
    return _comparison(spark, sf_dir).select(
        "workflow_signature", "change", "frequency_delta", F.round("total_seconds_delta", 3).alias("total_seconds_delta")
    )


@query(
    "i9_approved_changes",
    Q.upto("described", "SELECT workflow_signature, frequency_delta, total_seconds_delta FROM cmp WHERE approved AND (frequency_delta <> 0 OR total_seconds_delta <> 0)", _WINDOWS),
)
def i9_approved(spark, sf_dir):
    return R.approved_changes(_comparison(spark, sf_dir)).select(
        "workflow_signature", "frequency_delta", F.round("total_seconds_delta", 3).alias("total_seconds_delta")
    )


@query(
    "i10_previous_window_totals",
    Q.upto("described", """SELECT (SELECT SUM(n) FROM cur)::BIGINT - (SELECT SUM(n) FROM prv)::BIGINT AS session_delta, round((SELECT SUM(secs) FROM cur) - (SELECT SUM(secs) FROM prv), 2) AS tracked_seconds_delta,
      (SELECT COUNT(*) FROM cur) - (SELECT COUNT(*) FROM prv) AS confirmed_workflow_delta, (SELECT COUNT(*) FROM cur WHERE approved) - (SELECT COUNT(*) FROM prv WHERE approved) AS approved_candidate_delta,
      (SELECT COUNT(*) FROM cur WHERE NOT coalesce(approved, false)) - (SELECT COUNT(*) FROM prv WHERE NOT coalesce(approved, false)) AS emerging_workflow_delta""", _WINDOWS),
)
def i10(spark, sf_dir):
    before = CURRENT.shifted()
    d = I.one_stream(I.described(spark, sf_dir)).withColumn("ts", c("start_ts"))
    entries = [_window_entries(spark, sf_dir, w) for w in (CURRENT, before)]
    totals = [R.report_totals(R.in_window(d, w)) for w in (CURRENT, before)]
    # What is not approved stands for the emerging workflows here.
    open_ones = [e.filter(~F.coalesce("approved_automation_candidate", F.lit(False))) for e in entries]
    out = R.compare_totals(*entries, *totals, *open_ones)
    return out.select(
        "session_delta", F.round("tracked_seconds_delta", 2).alias("tracked_seconds_delta"),
        "confirmed_workflow_delta", "approved_candidate_delta", "emerging_workflow_delta",
    )


def _snapshots(spark, sf_dir, generated: str, odd_only: bool = False, lead: str = "old"):
    """A stored report per stream: its totals over the whole period."""
    totals = R.report_totals(I.described(spark, sf_dir))
    if odd_only:
        totals = totals.filter(c("stream_id").cast("int") % 2 == 1)
    none = F.array().cast("array<string>")
    return totals.select(
        F.concat(F.lit(f"{lead}-"), "stream_id").alias("id"), "stream_id", F.lit("week").alias("window"),
        F.lit("2024-01-21").alias("report_date"), F.lit("UTC").alias("timezone"), F.lit(0).alias("timezone_offset_minutes"),
        F.lit(CURRENT.start).cast("timestamp").alias("start_time"), F.lit(CURRENT.end).cast("timestamp").alias("end_time"),
        "total_sessions", "total_tracked_seconds", F.array(F.lit("{}")).alias("workflows"), none.alias("emerging"),
        F.lit(generated).cast("timestamp").alias("generated_at"),
    )


def _stored(spark, sf_dir):
    return R.upsert_snapshots(
        _snapshots(spark, sf_dir, "2024-02-01 00:00:00"),
        _snapshots(spark, sf_dir, "2024-02-01 00:10:00", odd_only=True, lead="new"),
    )


@query(
    "i11_snapshot_upsert",
    Q.upto("described", """SELECT 'old-' || stream_id AS id, stream_id, COUNT(*) AS total_sessions,
      CASE WHEN stream_id::INT % 2 = 1 THEN TIMESTAMP '2024-02-01 00:10:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS generated_at FROM described GROUP BY stream_id"""),
)
def i11(spark, sf_dir):
    return _stored(spark, sf_dir).select("id", "stream_id", "total_sessions", "generated_at")


@query(
    "i12_snapshot_list",
    Q.upto("described", """SELECT 'old-' || stream_id AS id, COUNT(*) AS total_sessions, 1 AS workflow_count, 0 AS emerging_workflow_count FROM described
      GROUP BY stream_id ORDER BY stream_id::INT % 2 DESC, stream_id LIMIT 50"""),
)
def i12(spark, sf_dir):
    return R.list_snapshots(_stored(spark, sf_dir), "week", "UTC").select(
        "id", "total_sessions", "workflow_count", "emerging_workflow_count"
    )


@query(
    "i13_report_freshness",
    Q.upto("activity", f"""SELECT stream_id, strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_raw_event_at,
      CASE WHEN stream_id::INT % 2 = 1 THEN 'fresh' ELSE 'stale' END AS snapshot_status FROM activity GROUP BY stream_id"""),
)
def i13(spark, sf_dir):
    streams = I.raw(spark, sf_dir).groupBy("stream_id").agg(iso_utc(F.max("ts")).alias("latest_raw_event_at"))
    out = R.report_freshness(streams, _stored(spark, sf_dir), CURRENT, F.lit("2024-02-01 00:12:00").cast("timestamp"))
    return out.select("stream_id", "latest_raw_event_at", "snapshot_status")


CYCLE = [R.resolve_window("day", "2024-01-21"), CURRENT]


def _cycle_sql() -> str:
    """The whole analysis anew for the events of each window."""
    parts = []
    for w in CYCLE:
        counts = f"""SELECT stream_id, '{w.window}' AS "window", COUNT(*) AS total_sessions,
          any_value((SELECT COUNT(*) FROM flows f WHERE f.stream_id = d.stream_id))::INT AS workflows,
          any_value((SELECT COUNT(*) FROM hints h WHERE h.stream_id = d.stream_id AND NOT EXISTS (SELECT 1 FROM flows f
            WHERE f.stream_id = h.stream_id AND f.cluster_id = h.cluster_id)))::INT AS emerging
          FROM described d GROUP BY stream_id"""
        whole = Q.upto("grouped", counts, f"{_LANES},{_EMERGING}")
        body = Q.ACTIVITY.replace("activity AS (", "activity_all AS (")
        span = f"activity AS (SELECT * FROM activity_all WHERE ts >= '{w.start:%Y-%m-%d %H:%M:%S}' AND ts < '{w.end:%Y-%m-%d %H:%M:%S}')"
        parts.append("SELECT * FROM (" + whole.replace(Q.ACTIVITY, f"{body},\n{span}", 1) + ")")
    return "\nUNION ALL\n".join(parts)


def _cycle_rows(snapshots):
    return snapshots.select(
        "stream_id", "window", "total_sessions", F.size("workflows").alias("workflows"), F.size("emerging").alias("emerging")
    )


@query("i14_report_cycle", _cycle_sql())
def i14(spark, sf_dir):
    return _cycle_rows(
        R.report_cycle(I.raw(spark, sf_dir), CYCLE, F.lit("2024-02-01").cast("timestamp"), options=I.OPTIONS)
    )


@query(
    "i15_duration_texts",
    Q.upto("described", """SELECT session_seq, CASE WHEN floor(floor(duration_seconds + 0.5) / 60) = 0 THEN floor(duration_seconds + 0.5)::BIGINT || 's'
        ELSE floor(floor(duration_seconds + 0.5) / 60)::BIGINT || 'm ' || (floor(duration_seconds + 0.5)::BIGINT % 60) || 's' END AS duration,
      'about ' || CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END || ' per similar week' AS savings
      FROM (SELECT *, greatest(1, floor(duration_seconds / 60 + 0.5))::BIGINT AS m FROM described)"""),
)
def i15(spark, sf_dir):
    return I.described(spark, sf_dir).select(
        "session_seq", duration_text(c("duration_seconds")).alias("duration"), savings_text(c("duration_seconds")).alias("savings")
    )


@query(
    "i16_review_board",
    Q.upto("grouped", "SELECT workflow_signature, name, NOT excluded AND NOT hidden AS visible_in_report, n AS frequency FROM applied", _ENTRIES),
)
def i16(spark, sf_dir):
    board = R.review_board(_applied(spark, sf_dir), _entries(spark, sf_dir))
    return board.select("workflow_signature", "name", "visible_in_report", "frequency")


@query(
    "i16_board_sessions",
    Q.upto("grouped", "SELECT cluster_seq, session_seq, duration_seconds, step_count FROM grouped"),
)
def i16_sessions(spark, sf_dir):
    bridge = I.signature_groups(spark, sf_dir).select("stream_id", "cluster_seq", "session_seq", "session_id")
    return R.board_sessions(bridge, I.one_stream(I.described(spark, sf_dir))).select(
        "cluster_seq", "session_seq", "duration_seconds", "step_count"
    )


# --- coverage, quality, lineage ---------------------------------------------------


@query(
    "j1_domain_pack_coverage",
    Q.upto("normalized", """SELECT domain, COUNT(*) AS total_browser_events, COUNT(route_family) AS matched_events, COUNT(*) - COUNT(route_family) AS unmatched_events,
      COUNT(route_family) / COUNT(*) AS match_rate FROM (SELECT coalesce(domain, 'unknown') AS domain, route_family FROM normalized WHERE source = 'chrome_extension' OR domain IS NOT NULL) GROUP BY ROLLUP (domain)"""),
)
def j1(spark, sf_dir):
    return J.domain_pack_coverage(I.labelled(spark, sf_dir))


@query(
    "j1_domain_pack_listing",
    Q.upto("normalized", "SELECT stream_id, seq, domain, route_template, route_family, page_type, resource_hint, domain_pack_id FROM normalized"),
)
def j1_listing(spark, sf_dir):
    events = I.labelled(spark, sf_dir)
    seq = events.select("raw_event_id", "seq")
    return J.domain_pack_listing(events).join(seq, "raw_event_id").select(
        "stream_id", "seq", "domain", "route_template", "route_family", "page_type", "resource_hint", "domain_pack_id"
    )


@query(
    "j2_layer_coverage",
    Q.upto("labelled", """SELECT layer, COUNT(x) AS event_count, COUNT(x) / (SELECT COUNT(*) FROM labelled) AS rate
      FROM (VALUES ('domain_pack'), ('page_type'), ('generic'), ('unknown')) v(layer) LEFT JOIN (SELECT layer, 1 AS x FROM labelled) USING (layer) GROUP BY 1"""),
)
def j2(spark, sf_dir):
    return J.layer_coverage(I.labelled(spark, sf_dir))


@query(
    "j2_pack_coverage",
    Q.upto("labelled", "SELECT pack_id, COUNT(*) AS event_count, 0::BIGINT AS unknown_event_count, 0.0::DOUBLE AS unknown_rate FROM labelled WHERE pack_id IS NOT NULL GROUP BY 1"),
)
def j2_packs(spark, sf_dir):
    return J.pack_coverage(I.labelled(spark, sf_dir))


@query("j2_top_actions", Q.upto("labelled", "SELECT action_name, COUNT(*) AS event_count FROM labelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def j2_top(spark, sf_dir):
    return J.top_actions(I.labelled(spark, sf_dir))


@query(
    "j2_action_totals",
    Q.upto("labelled", "SELECT COUNT(*) AS total_events, COUNT(*) FILTER (WHERE action_name = 'unknown_action') AS unknown_event_count, COUNT(*) FILTER (WHERE action_name = 'unknown_action') / COUNT(*) AS unknown_rate FROM labelled"),
)
def j2_totals(spark, sf_dir):
    return J.action_totals(I.labelled(spark, sf_dir))


@query(
    "j3_workflow_unknown_rate",
    Q.upto("grouped", f"""SELECT a.workflow_signature, 0 AS unknown_action_count, SUM(g.step_count)::BIGINT AS total_action_count FROM
      (SELECT f.*, {_HUMAN.format('main')} || ' workflow' AS name FROM facts f ORDER BY n DESC, secs DESC, name LIMIT 20) a JOIN grouped g USING (cluster_seq) GROUP BY 1""", _FACTS),
)
def j3(spark, sf_dir):
    counts = I.one_stream(J.unknown_counts(I.assigned(spark, sf_dir)))
    members = I.signature_groups(spark, sf_dir).select("stream_id", "cluster_seq", "session_seq").join(counts, ["stream_id", "session_seq"])
    out = J.workflow_unknown_rate(_summary(spark, sf_dir), members)
    return out.select("workflow_signature", "unknown_action_count", "total_action_count")


def _unknowns(spark, sf_dir):
    """Events whose label is kept only where a rule matched; the rest count as unknown."""
    ruled = c("action_match.rule_id").isNotNull()
    return I.labelled(spark, sf_dir).withColumn(
        "action_name", F.when(ruled, c("action_name")).otherwise(F.lit(J.UNKNOWN))
    )


@query(
    "j4_review_queue",
    Q.upto("labelled", """SELECT sha1('unknown_action_queue:' || concat_ws('|', application, action, coalesce(domain_pack_id, 'no-pack'), coalesce(route_family, 'no-route-family'), coalesce(page_type, 'no-page-type'))) AS queue_id,
      COUNT(*) AS occurrences, application, action AS event_type,
      coalesce(array_to_string(list_transform(list_sort(list(struct_pack(f := f, v := target)) FILTER (WHERE rn = 1 AND target IS NOT NULL))[1:3], lambda s: s.v), ','), '') AS sample_targets
      FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || lpad(stream_id, 9, ' ') AS f,
          row_number() OVER (PARTITION BY application, action, domain_pack_id, route_family, page_type, target ORDER BY ts, stream_id, seq) AS rn FROM labelled WHERE how <> 'rule') GROUP BY ALL""".replace(
        "GROUP BY ALL", "GROUP BY application, action, domain_pack_id, route_family, page_type"
    )),
)
def j4(spark, sf_dir):
    return J.review_queue(_unknowns(spark, sf_dir)).select(
        "queue_id", "occurrences", "application", "event_type", F.array_join("sample_targets", ",").alias("sample_targets")
    )


def _cluster_flags(spark, sf_dir):
    return _applied(spark, sf_dir)


_QUALITY = f"""SELECT (SELECT COUNT(*) FROM activity) AS raw_events, (SELECT COUNT(*) FROM labelled WHERE action_name LIKE 'switch\\_to\\_%' ESCAPE '\\') AS switch_actions,
  floor((SELECT COUNT(*) FILTER (WHERE action_name LIKE 'switch\\_to\\_%' ESCAPE '\\') / COUNT(*) FROM labelled) * 1000 + 0.5) / 10 AS switch_action_pct,
  (SELECT COUNT(*) FROM labelled WHERE domain IS NOT NULL) AS normalized_with_domain, (SELECT COUNT(*) FROM described) AS total_sessions,
  (SELECT COUNT(*) FROM described WHERE duration_seconds < 1) AS zero_or_subsecond_sessions, (SELECT COUNT(*) FROM described WHERE duration_seconds <= 5) AS lte_5_second_sessions,
  (SELECT COUNT(*) FROM described WHERE duration_seconds <= 20 AND step_count <= 3) AS short_form_eligible_sessions, (SELECT COUNT(*) FROM facts) AS total_clusters,
  (SELECT COUNT(*) FROM activity WHERE source_event_type = 'error') AS unanalyzed_count"""


@query("j5_dataset_quality", Q.upto("grouped", _QUALITY, _FACTS))
def j5(spark, sf_dir):
    report = J.quality_report(
        I.raw(spark, sf_dir), I.labelled(spark, sf_dir), I.described(spark, sf_dir), _cluster_flags(spark, sf_dir)
    )
    return report.select(
        "raw_events", "switch_actions", "switch_action_pct", "normalized_with_domain", "total_sessions",
        "zero_or_subsecond_sessions", "lte_5_second_sessions", "short_form_eligible_sessions", "total_clusters", "unanalyzed_count",
    )


@query("j5_counts_by_source", Q.upto("activity", """SELECT source AS "key", COUNT(*) AS "count" FROM activity GROUP BY 1"""))
def j5_source(spark, sf_dir):
    return J.count_by(I.raw(spark, sf_dir), "source")


@query(
    "j6_quality_issues",
    Q.upto("activity", "SELECT 'analysis_artifacts_stale' AS code, 'warn' AS severity, COUNT(*)::DOUBLE AS detail FROM activity WHERE event_type = 'view'"),
)
def j6(spark, sf_dir):
    events = I.labelled(spark, sf_dir).filter("source_event_type <> 'chrome.navigation'")
    report = J.quality_report(
        I.raw(spark, sf_dir), events, I.described(spark, sf_dir), _cluster_flags(spark, sf_dir)
    )
    return J.quality_issues(report).select("code", "severity", "detail")


@query(
    "j7_unanalyzed_events",
    Q.upto("activity", "SELECT COUNT(*) AS unanalyzed_count, MIN(ts) AS first_unanalyzed, MAX(ts) AS last_unanalyzed FROM activity WHERE event_type = 'view'"),
)
def j7(spark, sf_dir):
    events = I.labelled(spark, sf_dir).filter("source_event_type <> 'chrome.navigation'")
    return J.unanalyzed(I.raw(spark, sf_dir), events)


@query(
    "j8_analysis_readiness",
    Q.upto("grouped", """SELECT s.* FROM (SELECT COUNT(*) AS n, epoch_ms(MAX(ts)) AS last FROM activity) r,
      (SELECT COUNT(*) AS n, epoch_ms(MAX(ts)) AS last FROM activity WHERE seq % 3 > 0) p, (SELECT COUNT(*) AS n FROM described) d, (SELECT COUNT(*) AS n FROM flow) f,
      LATERAL (VALUES ('empty', 0, 0, 0, 0, NULL, NULL), ('needs_analysis', r.n, 0, 0, 0, r.last, NULL), ('stale', r.n, p.n, d.n, 0, r.last, p.last),
        ('ready', r.n, r.n, d.n, f.n, r.last, r.last)) s(readiness, raw_event_count, normalized_event_count, session_count, workflow_count, latest_raw_ms, latest_normalized_ms)""",
        _lane("", "grp0", 0.6, 2)),
)
def j8(spark, sf_dir):
    """A store in each of the four states it can be in."""
    raw, events = I.raw(spark, sf_dir), I.labelled(spark, sf_dir)
    described = I.described(spark, sf_dir)
    clusters, _ = C.cluster_lane(described, I.assigned(spark, sf_dir), WIDE)
    states = [
        J.analysis_readiness(raw.limit(0), events.limit(0)),
        J.analysis_readiness(raw, events.limit(0)),
        J.analysis_readiness(raw, events.filter("seq % 3 > 0"), described),
        J.analysis_readiness(raw, events, described, clusters),
    ]
    out = states[0]
    for more in states[1:]:
        out = out.unionByName(more)
    return out.select(
        "readiness", "raw_event_count", "normalized_event_count", "session_count", "workflow_count",
        F.unix_millis("latest_raw_event_at").alias("latest_raw_ms"),
        F.unix_millis("latest_normalized_event_at").alias("latest_normalized_ms"),
    )


@query(
    "j9_event_lineage",
    Q.upto("grouped", """SELECT o.seq, o.action_name, o.session_seq, row_number() OVER (PARTITION BY o.session_seq ORDER BY o.idx) AS step_order, f.workflow_signature
      FROM placed o LEFT JOIN grouped g ON g.session_seq = o.session_seq LEFT JOIN facts f ON f.cluster_seq = g.cluster_seq""", _FACTS),
)
def j9(spark, sf_dir):
    clusters = _summary(spark, sf_dir)
    bridge = I.signature_groups(spark, sf_dir).select(
        "stream_id", "session_seq", "cluster_seq", F.lit("standard").alias("detection_mode")
    )
    signs = clusters.select("cluster_id", "workflow_signature")
    trace = J.event_lineage(
        I.one_stream(I.raw(spark, sf_dir)), I.labelled(spark, sf_dir), session_steps(I.assigned(spark, sf_dir)), bridge, clusters
    )
    return trace.join(signs, "cluster_id", "left").select("seq", "action_name", "session_seq", "step_order", "workflow_signature")


@query(
    "j10_session_lineage",
    Q.upto("placed", "SELECT session_seq, row_number() OVER (PARTITION BY session_seq ORDER BY idx) AS step_order, source_event_type, action_name FROM placed"),
)
def j10(spark, sf_dir):
    sessions = I.described(spark, sf_dir)
    out = J.session_lineage(session_steps(I.assigned(spark, sf_dir)), sessions, I.raw(spark, sf_dir))
    return out.join(sessions.select("session_id", "session_seq"), "session_id").select(
        "session_seq", "step_order", "source_event_type", "action_name"
    )


_FLOW_ID = "sha1('workflow_cluster:' || signature)"


@query(
    "j10_session_workflows",
    Q.upto("placed", f"""SELECT p.stream_id, p.seq, row_number() OVER (PARTITION BY p.stream_id, p.session_seq ORDER BY p.idx) AS step_order, p.action_name, cluster_id
      FROM placed p LEFT JOIN (SELECT m.stream_id, m.session_seq, {_FLOW_ID} AS cluster_id FROM mem m JOIN flow USING (stream_id, cluster_seq)) h
        ON h.stream_id = p.stream_id AND h.session_seq = p.session_seq""",
        Q.SESSIONS + "," + Q.GROUPS + "," + _lane("", "grp0", 0.6, 2)),
)
def j10_workflows(spark, sf_dir):
    """Every event of every session with the workflow the session belongs to."""
    described, assigned, raw = I.described(spark, sf_dir), I.assigned(spark, sf_dir), I.raw(spark, sf_dir)
    clusters, bridge = C.cluster_lane(described, assigned, WIDE)
    rows = J.session_lineage(session_steps(assigned), described, raw, bridge, clusters)
    return rows.join(raw.select(c("id").alias("raw_event_id"), "seq"), "raw_event_id").select(
        "stream_id", "seq", c("step_order").cast("long").alias("step_order"), "action_name", "cluster_id"
    )


@query(
    "j10_workflow_lineage",
    Q.upto("grouped", f"""SELECT m.stream_id, {_FLOW_ID} AS cluster_id, m.session_seq, m.start_time, m.primary_application, m.step_count, size AS frequency,
      e.comparison_window, e.membership_score, e.peers FROM mem m JOIN flow f USING (stream_id, cluster_seq) JOIN explained e USING (stream_id, session_seq)""",
        _lane("", "grp0", 0.6, 2) + "," + _membership_sql("hybrid_v2")),
)
def j10_lineage(spark, sf_dir):
    """Every workflow with its sessions and why they belong to it."""
    described = I.described(spark, sf_dir)
    clusters, bridge = C.cluster_lane(described, I.assigned(spark, sf_dir), WIDE)
    return J.workflow_lineage(clusters, bridge, described).select(
        "stream_id", "cluster_id", "session_seq", "start_time", "primary_application", "step_count", "frequency",
        "comparison_window", "membership_score", _peer_texts(),
    )


# --- payloads ---------------------------------------------------------------------


@query("k1_payload_candidates", Q.upto("grouped", "SELECT workflow_signature FROM entries", _ENTRIES))
def k1(spark, sf_dir):
    return K.payload_candidates(_applied(spark, sf_dir)).select("workflow_signature")


@query(
    "k2_payload_records",
    Q.upto("grouped", """SELECT workflow_signature, n AS frequency, array_to_string(list_sort(involved), ',') AS applications,
      (SELECT coalesce(string_agg(d, ',' ORDER BY d), '') FROM (SELECT DISTINCT unnest(domains) AS d FROM mem WHERE mem.cluster_seq = facts.cluster_seq)) AS domains FROM facts""", _FACTS),
)
def k2(spark, sf_dir):
    bridge = I.signature_groups(spark, sf_dir).select(
        "stream_id", "session_seq", "session_id", "cluster_seq", F.lit("standard").alias("detection_mode")
    )
    clusters = _summary(spark, sf_dir)
    out = K.payload_records(clusters, bridge, I.one_stream(I.described(spark, sf_dir)))
    p = c("payload")
    return out.join(clusters.select("cluster_id", "workflow_signature"), "cluster_id").select(
        "workflow_signature", p["frequency"].alias("frequency"),
        F.array_join(F.array_sort(p["applications"]), ",").alias("applications"),
        F.array_join(F.array_sort(p["domains"]), ",").alias("domains"),
    )


@query(
    "k3_preparation_summary",
    Q.upto("grouped", "SELECT COUNT(*) AS workflow_count, 0 AS short_form_excluded_count, COUNT(*) AS payload_count FROM entries", _ENTRIES),
)
def k3(spark, sf_dir):
    return K.preparation_summary(_applied(spark, sf_dir), _entries(spark, sf_dir))


def _answers(spark, sf_dir):
    """Returned label texts: one per conversation turn, some incomplete or malformed."""
    rows = table(spark, sf_dir, "conversations")
    grade = F.when(c("turn") % 3 == 0, F.lit("high")).when(c("turn") % 3 == 1, F.lit("low")).otherwise(F.lit("maybe"))
    good = F.to_json(
        F.struct(
            F.concat(F.lit("Name "), c("conv_id").cast("string")).alias("workflow_name"),
            F.lit("summary").alias("workflow_summary"),
            grade.alias("automation_suitability"),
            F.lit("Playwright").alias("recommended_approach"),
            F.when(c("role") == "user", F.lit("")).otherwise(F.lit("why")).alias("rationale"),
        )
    )
    return rows.select(
        F.concat(F.lit("id-"), c("conv_id").cast("string")).alias("cluster_id"),
        F.lit("p").alias("provider"),
        F.lit("m").alias("model"),
        good.alias("answer"),
        F.concat(F.lit("2024-02-01T00:00:"), F.lpad(c("turn").cast("string"), 6, "0")).alias("created_at"),
        "conv_id",
        "turn",
    )


_LABELS = """lb AS (SELECT 'id-' || conv_id AS workflow_cluster_id, 'Name ' || conv_id AS workflow_name, CASE turn % 3 WHEN 0 THEN 'high' ELSE 'low' END AS automation_suitability,
  turn, conv_id FROM conversations WHERE turn % 3 < 2 AND role <> 'user')"""


@query("k4_parsed_labels", f"WITH {_LABELS} SELECT workflow_cluster_id, workflow_name, automation_suitability FROM lb")
def k4(spark, sf_dir):
    labels, _ = K.parse_labels(_answers(spark, sf_dir))
    return labels.select("workflow_cluster_id", "workflow_name", "automation_suitability")


@query("k4_rejected_labels", "SELECT COUNT(*) AS rejected FROM conversations WHERE NOT (turn % 3 < 2 AND role <> 'user')")
def k4_rejected(spark, sf_dir):
    _, rejected = K.parse_labels(_answers(spark, sf_dir))
    return rejected.agg(F.count("*").alias("rejected"))


@query(
    "k5_latest_labels",
    f"WITH {_LABELS} SELECT workflow_cluster_id, arg_max(automation_suitability, turn) AS automation_suitability FROM lb GROUP BY 1",
)
def k5(spark, sf_dir):
    labels, _ = K.parse_labels(_answers(spark, sf_dir))
    return R.latest_labels(labels).select("workflow_cluster_id", "automation_suitability")


@query(
    "k5_name_overlay",
    Q.upto("activity", f"""SELECT stream_id, CASE WHEN rename_to IS NULL THEN 'baseline' WHEN rename_to = (SELECT MAX(workflow_name) FROM lb WHERE lb.workflow_cluster_id = 'id-' || stream_id) THEN 'llm_overlay' ELSE 'feedback' END AS workflow_name_source FROM fold""",
        _LOG + ", " + _LABELS),
)
def k5_overlay(spark, sf_dir):
    from .workflows import _stream_clusters

    labels, _ = K.parse_labels(_answers(spark, sf_dir))
    applied = H.apply_feedback(_stream_clusters(spark, sf_dir), H.fold_feedback(_log(spark, sf_dir)))
    return K.overlay_names(applied, labels).select("stream_id", "workflow_name_source")


@query(
    "k5_names_written_back",
    Q.upto("activity", f"""SELECT s.stream_id, coalesce(n.name, 'Workflow ' || s.stream_id) AS name, n.name IS NOT NULL AS user_labeled
      FROM (SELECT DISTINCT stream_id FROM activity) s LEFT JOIN (SELECT workflow_cluster_id, arg_max(workflow_name || ' ' || turn, turn) AS name FROM lb GROUP BY 1) n
        ON n.workflow_cluster_id = 'id-' || s.stream_id""", _LABELS),
)
def k5_written(spark, sf_dir):
    """Suggested names become feedback; the last one of a workflow is its name."""
    answers = _answers(spark, sf_dir)
    labels, _ = K.parse_labels(answers)
    turn = F.regexp_replace(F.regexp_extract("created_at", r"(\d+)$", 1), "^0+(?=.)", "")
    labels = labels.withColumn("workflow_name", F.concat_ws(" ", "workflow_name", turn))
    clusters = _stream_clusters(spark, sf_dir)
    accepted, _ = K.labels_as_feedback(K.list_labels(labels), clusters)
    applied = H.apply_feedback(clusters, H.fold_feedback(accepted))
    return applied.select("stream_id", "name", "user_labeled")


# --- derivation -------------------------------------------------------------------


def _meetings(spark, sf_dir):
    """Every purchase is a meeting of as many minutes as its k, five times over."""
    configure(spark)
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.date_trunc("millisecond", "ts")
    return e.select(
        c("user_id").cast("string").alias("stream_id"),
        F.concat(F.lit("Meeting-"), c("event_id").cast("string")).alias("id"),
        F.concat(F.lit(" Standup "), k.cast("string")).alias("summary"),
        start.alias("start_at"),
        F.timestamp_millis(F.unix_millis(start) + (k + 1) * 300_000).alias("end_at"),
        k.alias("attendees_count"),
    )


_MEET = """mt AS (SELECT user_id::VARCHAR AS stream_id, 'Meeting-' || event_id AS id, ' Standup ' || json_extract_string(props, '$.k') AS summary, date_trunc('milliseconds', ts) AS s,
    date_trunc('milliseconds', ts) + (CAST(json_extract_string(props, '$.k') AS INT) + 1) * INTERVAL 5 MINUTE AS t FROM events WHERE event_type = 'purchase'),
po AS (SELECT DISTINCT user_id::VARCHAR AS stream_id, date_trunc('milliseconds', ts) AS a FROM events WHERE event_type <> 'purchase'),
pn AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY a) AS p FROM po),
act AS (SELECT pn.stream_id, mt.id, pn.p, pn.a FROM pn JOIN mt ON mt.stream_id = pn.stream_id AND mt.s <= pn.a AND pn.a < mt.t)"""


def _polls(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    return e.select(c("user_id").cast("string").alias("stream_id"), F.date_trunc("millisecond", "ts").alias("at")).distinct()


@query(
    "b1_calendar_signals",
    f"""WITH {_MEET} SELECT stream_id, typ AS target, strftime(CASE WHEN typ = 'meeting_start' THEN s ELSE t END, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_text,
      substr(sha256(lower(id)), 1, 16) AS id_hash, substr(sha256(lower(trim(summary))), 1, 16) AS summary_hash FROM mt CROSS JOIN (VALUES ('meeting_start'), ('meeting_end')) v(typ)""",
)
def b1(spark, sf_dir):
    m = _meetings(spark, sf_dir).withColumns({"start_at": iso_utc(c("start_at")), "end_at": iso_utc(c("end_at"))})
    s = c("calendar_signal")
    return B.calendar_signals(m).select(
        "stream_id", "target", "ts_text", s["eventIdHash"].alias("id_hash"), s["summaryHash"].alias("summary_hash")
    )


@query("b2_active_meetings", f"WITH {_MEET} SELECT stream_id, id, a AS at FROM act")
def b2(spark, sf_dir):
    return B.active_meetings(_polls(spark, sf_dir), _meetings(spark, sf_dir)).select("stream_id", "id", "at")


@query(
    "b3_meeting_changes",
    f"""WITH {_MEET} SELECT stream_id, id, a AS at, 'meeting_start' AS signal_type FROM act x WHERE p > 1 AND NOT EXISTS (SELECT 1 FROM act y WHERE y.stream_id = x.stream_id AND y.id = x.id AND y.p = x.p - 1)
      UNION ALL SELECT x.stream_id, x.id, n.a, 'meeting_end' FROM act x JOIN pn n ON n.stream_id = x.stream_id AND n.p = x.p + 1
        WHERE NOT EXISTS (SELECT 1 FROM act y WHERE y.stream_id = x.stream_id AND y.id = x.id AND y.p = x.p + 1)""",
)
def b3(spark, sf_dir):
    return B.meeting_changes(_polls(spark, sf_dir), _meetings(spark, sf_dir)).select("stream_id", "id", "at", "signal_type")


@query(
    "b4_window_changes",
    Q.upto("activity", """SELECT seq FROM (SELECT seq, raw_application || '|' || coalesce(window_title, '') AS f,
      lag(raw_application || '|' || coalesce(window_title, '')) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS b FROM activity) WHERE b IS NULL OR b <> f"""),
)
def b4(spark, sf_dir):
    return B.window_changes(I.raw(spark, sf_dir), I.OPTIONS.sessions.slice_ms).select("seq")


def _files(spark, sf_dir):
    """Polls of ten files per stream; views and edits lie minutes before the poll."""
    configure(spark)
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.date_trunc("millisecond", "ts")
    # Times are stated by the day, so that polls of one day see the same file state.
    base = F.date_trunc("day", "ts")
    return e.select(
        c("user_id").cast("string").alias("stream_id"),
        c("event_id").alias("seq"),
        ts.alias("ts"),
        iso_utc(ts).alias("ts_text"),
        F.concat(F.lit("file-"), (k % 3).cast("string")).alias("file_id"),
        F.when(k % 2 == 0, F.lit("application/vnd.google-apps.spreadsheet")).otherwise(F.lit("application/pdf")).alias("mime_type"),
        F.when(k % 5 != 0, iso_utc(base)).alias("modified_time"),
        F.when(k % 4 != 0, iso_utc(F.timestamp_millis(F.unix_millis(base) + (k % 3) * 60_000))).alias("viewed_time"),
        (k % 2).alias("sheet_count"),
        (k % 2).alias("grid_sheet_count"),
    )


_FILES = """fl AS (SELECT user_id::VARCHAR AS stream_id, event_id AS seq, date_trunc('milliseconds', ts) AS ts, 'file-' || (k % 3) AS file_id, k,
    CASE WHEN k % 5 <> 0 THEN date_trunc('day', ts) END AS m, CASE WHEN k % 4 <> 0 THEN date_trunc('day', ts) + (k % 3) * INTERVAL 1 MINUTE END AS v
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
fa AS (SELECT *, CASE WHEN v IS NOT NULL AND (m IS NULL OR v >= m) THEN 'viewed' WHEN m IS NOT NULL THEN 'modified' END AS typ,
    CASE WHEN v IS NOT NULL AND (m IS NULL OR v >= m) THEN v ELSE m END AS obs FROM fl),
fr AS (SELECT *, coalesce(m::VARCHAR, '') || '|' || coalesce(v::VARCHAR, '') AS f FROM fa WHERE typ IS NOT NULL AND epoch_ms(obs) >= epoch_ms(ts) - 43200000)"""


@query(
    "b5_file_activity",
    f"""WITH {_FILES} SELECT seq, 'workspace.drive.' || typ AS source_event_type, CASE typ WHEN 'viewed' THEN 'review_' ELSE 'update_' END || CASE WHEN k % 2 = 0 THEN 'spreadsheet' ELSE 'pdf' END AS target,
      sha256(file_id) AS resource_hash FROM (SELECT *, lag(f) OVER (PARTITION BY stream_id, file_id ORDER BY ts, seq) AS b FROM fr) WHERE b IS NULL OR b <> f""",
)
def b5(spark, sf_dir):
    return B.file_activity(_files(spark, sf_dir), 12 * 3_600_000).select("seq", "source_event_type", "target", "resource_hash")


@query(
    "b6_spreadsheet_activity",
    f"""WITH {_FILES} SELECT seq, 'workspace.sheets.' || typ AS source_event_type, CASE WHEN typ = 'viewed' AND k % 2 = 0 THEN 'open_sheet' ELSE 'update_sheet' END AS target
      FROM (SELECT *, lag(f || (k % 2)) OVER (PARTITION BY stream_id, file_id ORDER BY ts, seq) AS b FROM fr) WHERE b IS NULL OR b <> f || (k % 2)""",
)
def b6(spark, sf_dir):
    return B.spreadsheet_activity(_files(spark, sf_dir), 12 * 3_600_000).select("seq", "source_event_type", "target")


@query(
    "b7_repository_activity",
    """WITH rp AS (SELECT user_id::VARCHAR AS stream_id, event_id AS seq, date_trunc('milliseconds', ts) AS ts, 'repo-' || (k % 2) AS repo, k % 3 AS dirty, date_trunc('day', ts)::VARCHAR AS last
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
      rl AS (SELECT *, row_number() OVER w AS n, lag(dirty) OVER w AS bd, lag(last) OVER w AS bl FROM rp WINDOW w AS (PARTITION BY stream_id, repo ORDER BY ts, seq))
      SELECT seq, CASE WHEN n = 1 OR bl <> last THEN 'git.repo.commit' ELSE 'git.repo.status' END AS source_event_type,
        CASE WHEN n = 1 OR bl <> last THEN 'record_git_commit' WHEN dirty > 0 THEN 'review_git_changes' ELSE 'sync_git_repo' END AS target FROM rl WHERE n = 1 OR bl <> last OR bd <> dirty""",
)
def b7(spark, sf_dir):
    configure(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    repos = table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("stream_id"), c("event_id").alias("seq"), F.date_trunc("millisecond", "ts").alias("ts"),
        iso_utc(c("ts")).alias("ts_text"), F.concat(F.lit("repo-"), (k % 2).cast("string")).alias("repo_hash"), F.lit("git.example").alias("remote_host"),
        (k % 3).alias("dirty_file_count"), iso_utc(F.date_trunc("day", "ts")).alias("last_commit_at"),
    )
    return B.repository_activity(repos, I.OPTIONS.sessions.slice_ms).select("seq", "source_event_type", "target")


def _tabs(spark, sf_dir):
    configure(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("stream_id"), c("event_id").alias("seq"), F.date_trunc("millisecond", "ts").alias("ts"),
        iso_utc(c("ts")).alias("ts_text"), (k % 2).alias("window_id"), (k % 3).alias("tab_id"), kinds[c("event_type")].alias("kind"),
        F.concat(F.lit("https://x.example/"), (F.floor(c("event_id") / 400) % 2).cast("string")).alias("url"),
        F.when(c("event_type") == "view", c("event_id").cast("string")).alias("document_type"),
    )


_KINDS = {"click": "tab_activated", "view": "navigation", "purchase": "window_blur", "signup": "tab_removed", "error": "window_focus"}
_TABS = f"""tb AS (SELECT user_id::VARCHAR AS stream_id, event_id AS seq, date_trunc('milliseconds', ts) AS ts, k % 2 AS window_id, k % 3 AS tab_id, {Q.case_map(_KINDS, 'event_type', 'NULL')} AS kind,
    (event_id // 400) % 2 AS url, CASE WHEN event_type = 'view' THEN event_id::VARCHAR END AS document_type FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


# A period of an active tab: from its activation to the next one or to the tab's closing.
_PERIODS = f"""{_TABS},
    o AS (SELECT *, row_number() OVER (PARTITION BY stream_id, window_id ORDER BY ts, seq) AS n FROM tb),
    acts AS (SELECT *, lead(n) OVER w AS next_n, lead(tab_id) OVER w AS next_tab FROM o WHERE kind = 'tab_activated' WINDOW w AS (PARTITION BY stream_id, window_id ORDER BY n)),
    closed AS (SELECT a.stream_id, a.window_id, a.n, MIN(r.n) AS closed_n FROM acts a JOIN o r ON r.stream_id = a.stream_id AND r.window_id = a.window_id AND r.kind = 'tab_removed' AND r.tab_id = a.tab_id
      AND r.n > a.n AND r.n < coalesce(a.next_n, 9e15) GROUP BY ALL),
    periods AS (SELECT a.*, closed_n, coalesce(closed_n, next_n, 9e15) AS last_n FROM acts a LEFT JOIN closed USING (stream_id, window_id, n))"""


@query(
    "b8_tab_order",
    f"""WITH {_PERIODS} SELECT seq, row_number() OVER (PARTITION BY stream_id ORDER BY ts, seq) AS global_sequence, row_number() OVER w AS window_sequence,
      CASE WHEN lag(closed_n) OVER w IS NULL THEN lag(tab_id) OVER w END AS previous_tab_id FROM periods WINDOW w AS (PARTITION BY stream_id, window_id ORDER BY ts, seq)""",
)
def b8(spark, sf_dir):
    rows = B.tab_order(_tabs(spark, sf_dir), I.OPTIONS.sessions.slice_ms)
    return rows.select("seq", "global_sequence", "window_sequence", "previous_tab_id")


@query(
    "b9_dwell_segments",
    f"""WITH {_PERIODS},
      ev AS (SELECT p.stream_id, p.window_id, p.n AS p, p.tab_id AS tab, p.next_n, p.next_tab, p.closed_n, p.last_n, e.n, e.seq, e.ts, e.kind FROM periods p
        JOIN o e ON e.stream_id = p.stream_id AND e.window_id = p.window_id AND e.n BETWEEN p.n AND p.last_n
        WHERE e.n IN (p.n, p.last_n) OR e.kind IN ('window_focus', 'window_blur') OR (e.kind = 'navigation' AND e.tab_id = p.tab_id)),
      tl AS (SELECT *, lead(n) OVER w AS nn, lead(ts) OVER w AS nt, lead(kind) OVER w AS nk FROM ev WINDOW w AS (PARTITION BY stream_id, window_id, p ORDER BY n)),
      tr AS (SELECT seq, tab AS tab_id, epoch_ms(nt) - epoch_ms(ts) AS duration_ms, CASE WHEN nn = closed_n THEN 'tab_closed' WHEN nn = next_n AND closed_n IS NULL THEN CASE WHEN next_tab <> tab THEN 'tab_switch' END
          WHEN nk IN ('navigation', 'window_blur') THEN nk END AS reason FROM tl WHERE n < last_n AND kind <> 'window_blur')
      SELECT * FROM tr WHERE duration_ms > 0 AND reason IS NOT NULL""",
)
def b9(spark, sf_dir):
    rows = B.dwell_segments(_tabs(spark, sf_dir), I.OPTIONS.sessions.slice_ms)
    return rows.select("seq", "tab_id", "duration_ms", "reason")


@query(
    "b10_carried_context",
    f"""WITH {_TABS}, t1 AS (SELECT *, coalesce((lag(url) OVER (PARTITION BY stream_id, tab_id ORDER BY ts, seq) <> url)::INT, 1) AS moved FROM tb),
      t2 AS (SELECT *, SUM(moved) OVER (PARTITION BY stream_id, tab_id ORDER BY ts, seq) AS run FROM t1)
      SELECT seq, last_value(document_type IGNORE NULLS) OVER (PARTITION BY stream_id, tab_id, run ORDER BY ts, seq) AS document_type FROM t2""",
)
def b10(spark, sf_dir):
    return B.carried_context(_tabs(spark, sf_dir), ["document_type"], I.OPTIONS.sessions.slice_ms).select("seq", "document_type")


def _bucket(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} = 1 THEN '1' WHEN {n} <= 4 THEN '2_4' WHEN {n} <= 9 THEN '5_9' ELSE '10_plus' END"


def _tag_count(pattern: str) -> str:
    return _bucket(f"len(regexp_extract_all(mk, {Q.quote(pattern)}))")


_LANDMARKS = ", ".join(f"CASE WHEN regexp_matches(mk, '(?i)<{n}\\b') THEN '{n}' END" for n in B.LANDMARKS)


_TAGS = {
    "forms": r"(?i)<form\b", "tables": r"(?i)<table\b", "links": r"(?i)<a\b[^>]*\shref\b",
    "buttons": r"""(?i)<button\b|<[a-z0-9]+\b[^>]*\srole\s*=\s*["']?button\b""",
    "inputs": r"(?i)<(?:input|textarea|select)\b", "headings": r"(?i)<h[123]\b",
}


@query(
    "b11_page_structures",
    f"""WITH mk AS (SELECT html, lower(regexp_extract(html, '(?i)^\\s*<!doctype\\s+([a-z]+)', 1)) AS dt, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS mk FROM pages)
      SELECT CASE WHEN dt = 'html' THEN 'CSS1Compat' ELSE 'BackCompat' END AS mode, CASE WHEN dt = '' THEN 'unknown' ELSE dt END AS doctype,
        array_to_string(list_filter([{_LANDMARKS}], lambda x: x IS NOT NULL), ',') AS landmarks, {', '.join(f'{_tag_count(x)} AS {n}' for n, x in _TAGS.items())},
        regexp_matches(mk, '(?i)<input\\b[^>]*\\stype\\s*=\\s*["'']?file\\b') AS file_input,
        regexp_matches(mk, '(?i)\\scontenteditable\\s*=\\s*["'']?true\\b|\\srole\\s*=\\s*["'']?textbox\\b') AS rich_text, COUNT(*) AS pages FROM mk GROUP BY ALL""".replace("\\\\", "\\"),
)
def b11(spark, sf_dir):
    counts = ", ".join(f"{n}: STRING" for n in _TAGS)
    shape = f"compatMode STRING, doctype STRING, landmarks ARRAY<STRING>, counts STRUCT<{counts}>, hasFileInput BOOLEAN, hasRichText BOOLEAN"
    grouped = B.pages_by_structure(table(spark, sf_dir, "pages")).withColumn("d", F.from_json("descriptor", shape))
    return grouped.groupBy(
        c("d.compatMode").alias("mode"), c("d.doctype").alias("doctype"), F.array_join("d.landmarks", ",").alias("landmarks"),
        *[c(f"d.counts.{n}").alias(n) for n in _TAGS], c("d.hasFileInput").alias("file_input"), c("d.hasRichText").alias("rich_text"),
    ).agg(F.sum("pages").alias("pages"))


# --- streaming --------------------------------------------------------------------

STREAMED = SessionOptions(inactivity_ms=I.OPTIONS.sessions.inactivity_ms)


def _event_stream(spark, sf_dir):
    """The events table as a stream."""
    configure(spark)
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _written(spark, rows):
    """Run a stream over all that is there and read back what it appended."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    live.append_stream(rows, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


_IDLE = f"""g0 AS (SELECT stream_id, ts, coalesce((epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > {150000 * Q.S})::INT, 1) AS cut FROM activity WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq)),
g1 AS (SELECT *, SUM(cut) OVER (PARTITION BY stream_id ORDER BY ts) AS s FROM g0),
g2 AS (SELECT stream_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS step_count FROM g1 GROUP BY stream_id, s)"""


@query(
    "l2_streaming_idle_sessions",
    Q.upto("activity", f"""SELECT stream_id, start_ts, end_ts, step_count FROM g2
      WHERE epoch_ms(end_ts) + {150000 * Q.S} <= (SELECT epoch_ms(MAX(ts)) FROM activity) - 3600000""", _IDLE),
)
def l2(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select(
        c("user_id").cast("string").alias("stream_id"), F.date_trunc("millisecond", "ts").alias("ts")
    )
    return _written(spark, live.live_idle_sessions(events.withWatermark("ts", "1 hour"), STREAMED))


# Labels from an event alone: no neighbours fill in for what it does not say.
_ALONE = """ctx AS (SELECT *, NULL::VARCHAR AS b_target, NULL::VARCHAR AS a_target, page_type AS any_page_type, resource_hint AS any_hint FROM normalized),
""" + Q.LABELLED


@query("l1_streaming_labels", Q.upto("normalized", "SELECT stream_id, seq, application, action_name, action_confidence FROM labelled", _ALONE))
def l1(spark, sf_dir):
    raw = raw_events(spark, sf_dir, _event_stream(spark, sf_dir))
    labels = live.live_labels(raw).select("stream_id", "seq", "application", "action_name", "action_confidence")
    return _written(spark, labels)


_LIVE = f"""ls AS (SELECT stream_id, session_seq, MAX(boundary_reason) AS boundary_reason, MIN(epoch_ms(ts)) AS start_ms, MAX(epoch_ms(ts)) AS end_ms, COUNT(*) AS step_count FROM placed GROUP BY ALL),
lm AS (SELECT epoch_ms(MAX(ts)) - 3600000 AS mark FROM placed),
ln AS (SELECT *, lead(start_ms) OVER (PARTITION BY stream_id ORDER BY start_ms, session_seq) AS next_ms FROM ls)"""


@query(
    "l3_streaming_sessions",
    Q.upto("placed", f"SELECT ln.* EXCLUDE (next_ms) FROM ln, lm WHERE next_ms < mark OR end_ms + {150000 * Q.S} < mark", _LIVE),
)
def l3(spark, sf_dir):
    """All sessions that the final watermark, an hour before the last event, has passed."""
    known = I.labelled(spark, sf_dir)
    folder = known.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(known.schema).parquet(folder).withWatermark("ts", "1 hour")
    return _written(spark, live.live_sessions(stream, I.OPTIONS.sessions))


@query(
    "l4_late_events",
    Q.upto("placed", f"SELECT ln.* EXCLUDE (next_ms) FROM ln, lm WHERE next_ms < mark OR end_ms + {150000 * Q.S} < mark", _LIVE),
)
def l4(spark, sf_dir):
    """Every seventh event comes a batch late, most of them behind the watermark; the sessions are those of all events."""
    known = I.labelled(spark, sf_dir).drop("raw_event_id", "raw")  # no session depends on them
    base = f"{scratch_dir(spark)}/late-{uuid.uuid4().hex}"
    late = (c("seq") % 7 == 3) & (c("ts") < known.agg(F.max("ts")).first()[0] - timedelta(hours=1))
    known.filter(~late).write.parquet(f"{base}/arriving")
    # The first batch takes just these files, which are older; there are no more late ones.
    files = len(spark.read.schema(known.schema).parquet(f"{base}/arriving").inputFiles())
    known.filter(late).coalesce(files).write.mode("append").parquet(f"{base}/arriving")
    arriving = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/arriving")
    merge = refresh.keep_late_sessions(base, 3_600_000, I.OPTIONS.sessions)
    live.refresh_reports(arriving, merge, f"{base}/checkpoint").awaitTermination()
    streamed = _written(spark, live.live_sessions(arriving.withWatermark("ts", "1 hour"), I.OPTIONS.sessions))
    return refresh.current_sessions(streamed, base, I.OPTIONS.sessions.inactivity_ms)


@query("l5_periodic_refresh", _cycle_sql())
def l5(spark, sf_dir):
    """Raw events come in order of time; every batch brings up to date the reports of the windows it reaches."""
    configure(spark)
    base = f"{scratch_dir(spark)}/refresh-{uuid.uuid4().hex}"
    raw = I.raw(spark, sf_dir)
    raw.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/arriving")
    arriving = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/arriving")
    fresh = refresh.keep_reports_fresh(base, CYCLE, F.lit("2024-02-01").cast("timestamp"), options=I.OPTIONS)
    live.refresh_reports(arriving, fresh, f"{base}/checkpoint").awaitTermination()
    return _cycle_rows(refresh.current_reports(spark, base))
