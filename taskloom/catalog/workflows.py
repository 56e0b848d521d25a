"""Queries for sessions, similarity, clusters and feedback (F, G, H)."""

from __future__ import annotations

import uuid
from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import (
    composite,
    jaccard,
    lcs_of,
    ngrams,
    sequence_similarity,
    similarity_parts,
    time_of_day_similarity,
)
from ..operators import clusters as C
from ..operators import feedback as H
from ..operators import inspect as J
from ..operators import sessions as S
from ..options import SimilarityWeights
from ..plans.analysis import find_workflows
from ..plans.materialize import scratch_dir
from ..plans.slices import with_previous_row
from ..sources import store
from . import inputs as I
from . import sql as Q
from .registry import query

c = F.col


# --- sessions ---------------------------------------------------------------------


@query(
    "f1_chronological_order",
    Q.upto("marked", "SELECT stream_id, seq, idx AS position FROM marked"),
)
def f1(spark, sf_dir):
    from ..plans.slices import with_running_number

    rows = I.raw(spark, sf_dir).select("id", "stream_id", "seq", "ts", "ts_text")
    return with_running_number(rows, ["stream_id"], "position", I.OPTIONS.sessions.slice_ms).select(
        "stream_id", "seq", "position"
    )


@query(
    "f2_context_shift",
    Q.upto("marked", "SELECT seq, score AS context_shift_score, array_to_string(changed, ',') AS changed_fields FROM marked"),
)
def f2(spark, sf_dir):
    m = S.mark_boundaries(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return m.select("seq", "context_shift_score", F.array_join("changed_fields", ",").alias("changed_fields"))


@query(
    "f3_idle_boundaries",
    Q.upto("marked", "SELECT seq, gap_ms, hard_reason FROM marked WHERE hard_reason IN ('idle_gap', 'idle_and_context_shift')"),
)
def f3(spark, sf_dir):
    m = S.mark_boundaries(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return m.filter(c("hard_reason").startswith("idle")).select("seq", "gap_ms", "hard_reason")


@query(
    "f4_context_shift_boundaries",
    Q.upto("marked", "SELECT seq, gap_ms FROM marked WHERE soft_reason = 'context_shift'"),
)
def f4(spark, sf_dir):
    m = S.mark_boundaries(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return m.filter("soft_reason = 'context_shift'").select("seq", "gap_ms")


@query(
    "f5_reset_boundaries",
    Q.upto("marked", "SELECT seq, gap_ms FROM marked WHERE soft_reason = 'reset_after_interruption'"),
)
def f5(spark, sf_dir):
    m = S.mark_boundaries(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return m.filter("soft_reason = 'reset_after_interruption'").select("seq", "gap_ms")


def _with_signals(spark, sf_dir):
    """Sign-ups play the part of meeting signals."""
    signal = F.struct(
        F.lit("meeting_start").alias("signalType"),
        F.lit(None).cast("string").alias("eventIdHash"),
        F.lit(None).cast("string").alias("summaryHash"),
        c("ts_text").alias("startAt"),
        F.lit(None).cast("string").alias("endAt"),
        F.lit(None).cast("long").alias("attendeesCount"),
        F.lit(True).alias("signalOnly"),
    )
    return I.labelled(spark, sf_dir).withColumn(
        "calendar_signal", F.when(c("source_event_type") == "app.switch", signal)
    )


_SIGNALS = """sg AS (SELECT stream_id, seq, ts, source_event_type = 'app.switch' AS is_signal,
  COUNT(*) FILTER (WHERE source_event_type = 'app.switch') OVER (PARTITION BY stream_id ORDER BY ts, seq) AS signals FROM labelled),
sr AS (SELECT *, lag(signals) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS before FROM sg WHERE NOT is_signal)"""


@query(
    "f6_calendar_boundaries",
    Q.upto("labelled", "SELECT seq, signals - before AS signal_count FROM sr WHERE signals > before", _SIGNALS),
)
def f6(spark, sf_dir):
    m = S.mark_boundaries(_with_signals(spark, sf_dir), I.OPTIONS.sessions)
    return m.filter("hard_reason = 'calendar_signal'").select("seq", "signal_count")


@query(
    "f6_boundary_signals",
    Q.upto("labelled", f"""SELECT r.seq AS session_seq, strftime(s.ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS signal_time
      FROM sr r JOIN sg s ON s.stream_id = r.stream_id AND s.is_signal AND s.signals > r.before AND s.signals <= r.signals
      WHERE r.signals > r.before""", _SIGNALS),
)
def f6_signals(spark, sf_dir):
    return S.session_signals(_with_signals(spark, sf_dir), I.OPTIONS.sessions).select(
        "session_seq", "signal_time"
    )


@query(
    "f7_surviving_soft_boundaries",
    Q.upto("placed", "SELECT stream_id, seq FROM placed WHERE soft_reason IS NOT NULL AND start_idx = idx"),
)
def f7(spark, sf_dir):
    m = S.mark_boundaries(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return S.surviving_soft_boundaries(m, I.OPTIONS.sessions)


@query(
    "f8_assigned_sessions",
    Q.upto("placed", "SELECT stream_id, seq, session_seq, boundary_reason FROM placed"),
)
def f8(spark, sf_dir):
    a = S.assign_sessions(I.labelled(spark, sf_dir), I.OPTIONS.sessions)
    return a.select("stream_id", "seq", "session_seq", "boundary_reason")


@query(
    "f9_sessions",
    Q.upto("described", """SELECT stream_id, session_seq, start_time, end_time, primary_application, primary_domain, boundary_reason, step_count,
      array_to_string(applications, ',') AS applications, array_to_string(domains, ',') AS domains FROM described"""),
)
def f9(spark, sf_dir):
    s = S.roll_up_sessions(I.assigned(spark, sf_dir))
    return s.select(
        "stream_id", "session_seq", "start_time", "end_time", "primary_application", "primary_domain",
        "boundary_reason", "step_count",
        F.array_join("applications", ",").alias("applications"), F.array_join("domains", ",").alias("domains"),
    )


@query(
    "f9_session_steps",
    Q.upto("placed", """SELECT stream_id, session_seq, row_number() OVER (PARTITION BY stream_id, session_seq ORDER BY idx) AS step_order,
      action_name, application, ts_text AS timestamp FROM placed"""),
)
def f9_steps(spark, sf_dir):
    return S.session_steps(I.assigned(spark, sf_dir)).select(
        "stream_id", "session_seq", "step_order", "action_name", "application", "timestamp"
    )


SPLIT_AFTER = "search_order"


def _split_rules(described):
    """A split rule for the signature of every session that holds the action."""
    held = described.filter(F.array_contains("actions", SPLIT_AFTER)).select("workflow_signature").distinct()
    return held.select(
        c("workflow_signature").alias("key"),
        F.struct(
            F.lit(SPLIT_AFTER).alias("split_after_action_name"),
        ).alias("feedback"),
    )


@query(
    "f10_split_sessions",
    Q.upto("placed", f"""SELECT stream_id, new_seq AS session_seq, COUNT(*) AS step_count, MIN(pos) AS first_position FROM fin GROUP BY ALL""",
        f"""pos AS (SELECT stream_id, session_seq, seq, action_name, row_number() OVER w AS pos, COUNT(*) OVER (PARTITION BY stream_id, session_seq) AS n
          FROM placed WINDOW w AS (PARTITION BY stream_id, session_seq ORDER BY idx)),
        cut AS (SELECT stream_id, session_seq, MIN(pos) FILTER (WHERE action_name = '{SPLIT_AFTER}') AS at, MAX(n) AS n FROM pos GROUP BY ALL),
        fin AS (SELECT p.*, CASE WHEN c.at > 1 AND c.at < c.n AND p.pos > c.at
            THEN MIN(CASE WHEN p.pos = c.at + 1 THEN p.seq END) OVER (PARTITION BY p.stream_id, p.session_seq) ELSE p.session_seq END AS new_seq
          FROM pos p JOIN cut c ON c.stream_id = p.stream_id AND c.session_seq = p.session_seq)"""),
)
def f10(spark, sf_dir):
    d = I.described(spark, sf_dir)
    steps = S.session_steps(I.assigned(spark, sf_dir)).select("stream_id", "normalized_event_id", "step_order")
    split = S.split_sessions(I.assigned(spark, sf_dir), d, _split_rules(d))
    return (
        split.join(steps.withColumnRenamed("normalized_event_id", "id"), ["stream_id", "id"])
        .groupBy("stream_id", "session_seq")
        .agg(F.count("*").alias("step_count"), F.min("step_order").alias("first_position"))
    )


@query(
    "f11_short_form_candidates",
    Q.upto("described", f"""SELECT stream_id, session_seq FROM described WHERE duration_seconds BETWEEN 0 AND {20 * Q.S} AND len(actions) BETWEEN 1 AND 3
      AND len(list_filter(actions, lambda a: a <> 'unknown_action' AND NOT starts_with(a, 'switch_to_'))) >= 1"""),
)
def f11(spark, sf_dir):
    return I.described(spark, sf_dir).filter(C.is_short_form(I.OPTIONS.short_form)).select("stream_id", "session_seq")


@query(
    "f12_session_list",
    Q.upto("described", "SELECT stream_id, start_time, end_time, primary_application, primary_domain, boundary_reason, step_count FROM described ORDER BY start_time DESC"),
)
def f12(spark, sf_dir):
    return S.list_sessions(I.described(spark, sf_dir)).drop("session_id")


@query(
    "f13_sessions_with_steps",
    Q.upto("placed", """SELECT stream_id, session_seq, row_number() OVER (PARTITION BY stream_id, session_seq ORDER BY idx) AS step_order, action_name FROM placed"""),
)
def f13(spark, sf_dir):
    steps = S.session_steps(I.assigned(spark, sf_dir))
    return steps.select("stream_id", "session_seq", c("step_order").cast("long").alias("step_order"), "action_name")


@query(
    "f13_sessions_of_events",
    Q.upto("described", """SELECT p.stream_id, p.seq, p.session_seq, p.step_order, d.primary_application, d.step_count
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, session_seq ORDER BY idx) AS step_order FROM placed) p
      JOIN described d USING (stream_id, session_seq) WHERE p.source_event_type = 'form.submit'"""),
)
def f13_of_events(spark, sf_dir):
    assigned = I.assigned(spark, sf_dir)
    wanted = assigned.filter(c("source_event_type") == "form.submit").select(c("id").alias("normalized_event_id"), "seq")
    found = S.sessions_of_events(S.session_steps(assigned), I.described(spark, sf_dir), wanted)
    return found.join(wanted, "normalized_event_id").select(
        "stream_id", "seq", "session_seq", c("step_order").cast("long").alias("step_order"), "primary_application", "step_count"
    )


@query(
    "f13_session_details",
    Q.upto("described", """SELECT stream_id, session_seq, row_number() OVER (PARTITION BY stream_id, session_seq ORDER BY idx) AS step_order, p.action_name, p.application, d.boundary_reason
      FROM placed p JOIN (SELECT stream_id, session_seq, boundary_reason FROM described WHERE step_count >= 4) d USING (stream_id, session_seq)"""),
)
def f13_details(spark, sf_dir):
    sessions = I.described(spark, sf_dir)
    details = S.session_details(
        S.session_steps(I.assigned(spark, sf_dir)),
        sessions.select("stream_id", "session_seq", "session_id", "boundary_reason", "step_count"),
        sessions.filter("step_count >= 4"),
    )
    return details.select(
        "stream_id", "session_seq", c("step_order").cast("long").alias("step_order"), "action_name", "application", "boundary_reason"
    )


# --- similarity -------------------------------------------------------------------


@query(
    "g1_descriptors",
    Q.upto("described", """SELECT stream_id, session_seq, array_to_string(tokens, '>') AS tokens, array_to_string(actions, '>') AS actions,
      array_to_string(action_set, ',') AS action_set, array_to_string(contexts, ',') AS contexts, duration_seconds, start_minute FROM described"""),
)
def g1(spark, sf_dir):
    a = I.assigned(spark, sf_dir)
    d = C.describe_sessions(a, S.roll_up_sessions(a))
    return d.select(
        "stream_id", "session_seq", F.array_join("tokens", ">").alias("tokens"), F.array_join("actions", ">").alias("actions"),
        F.array_join("action_set", ",").alias("action_set"), F.array_join("contexts", ",").alias("contexts"),
        "duration_seconds", "start_minute",
    )


@query(
    "g2_workflow_signatures",
    Q.upto("described", """SELECT stream_id, session_seq, workflow_signature, sha1('workflow_signature:short_form:' || workflow_signature) AS short_form_signature,
      sha1('workflow_signature:' || array_to_string(actions, '>')) AS legacy_signature FROM described"""),
)
def g2(spark, sf_dir):
    return I.described(spark, sf_dir).select(
        "stream_id", "session_seq", "workflow_signature", "short_form_signature", "legacy_signature"
    )


def _neighbours(spark, sf_dir, *facts):
    """The given facts of every session beside those of the one before it in its stream."""
    d = I.described(spark, sf_dir).select(
        "stream_id", "session_seq", c("session_id").alias("id"), c("start_ts").alias("ts"),
        c("start_time").alias("ts_text"), c("start_order")["seq"].alias("seq"), *facts,
    )
    rows = with_previous_row(d, ["stream_id"], "before", facts, I.OPTIONS.sessions.slice_ms)
    return rows.filter("before IS NOT NULL").select(
        "stream_id", "session_seq", *facts, *[c("before")[f].alias(f"left_{f}") for f in facts]
    )


_JAC = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


def _jac(a: str, b: str) -> str:
    return _JAC.format(a, b)


_GRAM = "CASE WHEN len({0}) < gn THEN [array_to_string({0}, '>')] ELSE list_transform(range(1, len({0}) - gn + 2), lambda i: array_to_string({0}[i:i + gn - 1], '>')) END"
_PAIRS = f"""pr0 AS (SELECT stream_id, session_seq, tokens AS t, action_set AS s, contexts AS x, start_minute AS m,
    lag(tokens) OVER w AS lt, lag(action_set) OVER w AS ls, lag(contexts) OVER w AS lx, lag(start_minute) OVER w AS lm
  FROM described WINDOW w AS (PARTITION BY stream_id ORDER BY start_ts, session_seq)),
pr1 AS (SELECT *, least(2, greatest(1, least(len(t), len(lt)))) AS gn FROM pr0 WHERE lt IS NOT NULL),
pr2 AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, len(t) + 1), lambda z: 0),
      list_transform(lt, lambda a: list_prepend(0, list_transform(t, lambda b: (a = b)::INT)))),
    lambda prev, hit: list_transform(range(1, len(prev) + 1), lambda j: list_max(list_transform(range(1, j + 1),
      lambda i: greatest(prev[i], CASE WHEN i > 1 AND hit[i] = 1 THEN prev[i - 1] + 1 ELSE 0 END)))))[-1] AS lcs FROM pr1),
pr3 AS (SELECT *, {_GRAM.format('lt')} AS lg, {_GRAM.format('t')} AS g FROM pr2),
pr4 AS (SELECT *, lcs / greatest(len(t), len(lt)) * 0.75 + ({_jac('lg', 'g')}) * 0.25 AS sequence, {_jac('ls', 's')} AS action_set,
    {_jac('lx', 'x')} AS context, greatest(0, 1 - least(abs(m - lm), 1440 - abs(m - lm)) / 720) AS time_of_day FROM pr3)"""


@query("g3_lcs_length", Q.upto("described", "SELECT stream_id, session_seq, lcs::INT AS lcs FROM pr2", _PAIRS))
def g3(spark, sf_dir):
    return _neighbours(spark, sf_dir, "tokens").select("stream_id", "session_seq", lcs_of("left_tokens", "tokens").alias("lcs"))


@query("g4_ngrams", Q.upto("described", "SELECT stream_id, session_seq, array_to_string(g, ' ') AS grams FROM pr3", _PAIRS))
def g4(spark, sf_dir):
    size = F.least(F.lit(2), F.greatest(F.lit(1), F.least(F.size("tokens"), F.size("left_tokens"))))
    return _neighbours(spark, sf_dir, "tokens").select(
        "stream_id", "session_seq", F.array_join(ngrams(c("tokens"), size), " ").alias("grams")
    )


@query("g5_jaccard", Q.upto("described", "SELECT stream_id, session_seq, action_set AS score FROM pr4", _PAIRS))
def g5(spark, sf_dir):
    return _neighbours(spark, sf_dir, "action_set").select(
        "stream_id", "session_seq", jaccard(c("left_action_set"), c("action_set")).alias("score")
    )


@query("g6_sequence_similarity", Q.upto("described", "SELECT stream_id, session_seq, round(sequence, 9) AS score FROM pr4", _PAIRS))
def g6(spark, sf_dir):
    return _neighbours(spark, sf_dir, "tokens").select(
        "stream_id", "session_seq", F.round(sequence_similarity("left_tokens", "tokens"), 9).alias("score")
    )


@query("g7_time_of_day", Q.upto("described", "SELECT stream_id, session_seq, round(time_of_day, 9) AS score FROM pr4", _PAIRS))
def g7(spark, sf_dir):
    return _neighbours(spark, sf_dir, "start_minute").select(
        "stream_id", "session_seq", F.round(time_of_day_similarity(c("left_start_minute"), c("start_minute")), 9).alias("score")
    )


def _composite(spark, sf_dir, weights, strategy="hybrid_v2"):
    parts = similarity_parts("left_", "", strategy)
    facts = ["tokens", "action_set", "contexts", "start_minute"]
    rows = _neighbours(spark, sf_dir, *facts).select("stream_id", "session_seq", *[v.alias(k) for k, v in parts.items()])
    total = composite({k: c(k) for k in parts}, weights, strategy)
    return rows.select("stream_id", "session_seq", F.round(total, 9).alias("score"))


@query(
    "g8_composite_similarity",
    Q.upto("described", "SELECT stream_id, session_seq, round(sequence * 0.35 + action_set * 0.25 + context * 0.25 + time_of_day * 0.15, 9) AS score FROM pr4", _PAIRS),
)
def g8(spark, sf_dir):
    return _composite(spark, sf_dir, SimilarityWeights())


@query(
    "g9_custom_weights",
    Q.upto("described", "SELECT stream_id, session_seq, round((sequence * 2 + action_set + context) / 4, 9) AS score FROM pr4", _PAIRS),
)
def g9(spark, sf_dir):
    return _composite(spark, sf_dir, SimilarityWeights(2, 1, 1, 0))


@query("g10_eligible_sessions", Q.upto("grouped", "SELECT stream_id, session_seq FROM grouped"))
def g10(spark, sf_dir):
    return C.eligible(I.described(spark, sf_dir), I.OPTIONS.clusters).select("stream_id", "session_seq")


# --- clusters ---------------------------------------------------------------------


# The sequential rule itself: one step for each session of a stream. ``home`` holds the founders of the sessions so far.
_TOTAL = "((sequence * 0.35 + action_set * 0.25) + context * 0.25) + time_of_day * 0.15"


def _led(source: str, threshold: float, n: str = "", total: str = _TOTAL) -> str:
    """Statements that end in clustered{n}: the rows of ``source`` with their cluster_seq."""
    steps = _PAIRS[_PAIRS.index("pr1 AS") :]
    for k in range(5):
        steps = steps.replace(f"pr{k} ", f"pr{k}{n} ").replace(f"pr{k})", f"pr{k}{n})")
    return f"""el{n} AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_time, session_seq) AS k FROM {source}),
pr0{n} AS (SELECT b.stream_id, b.k, a.k AS j, b.tokens AS t, b.action_set AS s, b.contexts AS x, b.start_minute AS m,
    a.tokens AS lt, a.action_set AS ls, a.contexts AS lx, a.start_minute AS lm
  FROM el{n} a JOIN el{n} b ON a.stream_id = b.stream_id AND a.k < b.k),
{steps},
scored{n} AS (SELECT *, {total} AS total FROM pr4{n}),
sims{n} AS (SELECT stream_id, k, list(total ORDER BY j) AS sims FROM scored{n} GROUP BY ALL),
led{n} AS (
  SELECT stream_id, k, [k] AS home FROM el{n} WHERE k = 1
  UNION ALL
  SELECT stream_id, k, list_append(home, CASE WHEN list_max(scores) >= {threshold}
      THEN founders[list_position(scores, list_max(scores))] ELSE k END)
  FROM (SELECT *, list_transform(founders, lambda c: list_avg(list_reverse_sort(list_filter(sims, lambda x, i: home[i] = c))[1:2])) AS scores
    FROM (SELECT l.stream_id, q.k, l.home, q.sims, list_sort(list_distinct(l.home)) AS founders
      FROM led{n} l JOIN sims{n} q ON q.stream_id = l.stream_id AND q.k = l.k + 1))),
clustered{n} AS (SELECT e.*, f.session_seq AS cluster_seq
  FROM el{n} e JOIN led{n} l ON l.stream_id = e.stream_id AND l.k = e.k
  JOIN el{n} f ON f.stream_id = e.stream_id AND f.k = l.home[-1])"""


@query("g11_assigned_clusters", Q.upto("grouped", "SELECT stream_id, session_seq, cluster_seq FROM clustered", _led("grp0", 0.74)))
def g11(spark, sf_dir):
    d = C.eligible(I.described(spark, sf_dir), I.OPTIONS.clusters)
    return C.assign_clusters(d, I.OPTIONS.clusters).select("stream_id", "session_seq", "cluster_seq")


_LOOSE = replace(I.OPTIONS.clusters, min_frequency=3)
# Workflows of few and less equal sessions, of which single users have some here.
WIDE = replace(I.OPTIONS.clusters, min_frequency=2, similarity_threshold=0.6)


@query(
    "g12_confirmed_clusters",
    Q.upto("grouped", """SELECT DISTINCT cluster_seq FROM (SELECT cluster_seq, start_ts,
      lead(start_ts, 2) OVER (PARTITION BY cluster_seq ORDER BY start_ts, session_seq) AS reach FROM grouped)
      WHERE epoch_ms(reach) - epoch_ms(start_ts) <= 7 * 86400000"""),
)
def g12(spark, sf_dir):
    return C.confirmed_clusters(I.signature_groups(spark, sf_dir), _LOOSE).select("cluster_seq")


_BY_CONTEXT = """byctx AS (SELECT *, MIN(session_seq) OVER (PARTITION BY array_to_string(contexts, ',')) AS ctx_seq FROM grouped),
var0 AS (SELECT ctx_seq, array_to_string(actions, '>') AS sequence, COUNT(*) AS occurrence_count, SUM(round(duration_seconds * 1000)::BIGINT) / 1000 / COUNT(*) AS average_duration_seconds,
  MIN(struct_pack(t := start_time, s := session_seq)) AS first FROM byctx GROUP BY ALL),
var1 AS (SELECT *, row_number() OVER (PARTITION BY ctx_seq ORDER BY occurrence_count DESC, average_duration_seconds DESC, first) AS rank FROM var0)"""


def _by_context(spark, sf_dir):
    g = I.signature_groups(spark, sf_dir).drop("cluster_seq")
    w = g.groupBy("contexts").agg(F.min("session_seq").alias("cluster_seq"))
    return g.join(w, "contexts")


@query(
    "g13_top_variants",
    Q.upto("grouped", "SELECT ctx_seq AS cluster_seq, rank, sequence, occurrence_count, round(average_duration_seconds, 6) AS average_duration_seconds FROM var1 WHERE rank <= 3", _BY_CONTEXT),
)
def g13(spark, sf_dir):
    v = C.sequence_variants(_by_context(spark, sf_dir)).filter("rank <= 3")
    return v.select(
        "cluster_seq", "rank", F.array_join("actions", ">").alias("sequence"), "occurrence_count",
        F.round("average_duration_seconds", 6).alias("average_duration_seconds"),
    )


@query(
    "g14_representatives",
    Q.upto("grouped", "SELECT ctx_seq AS cluster_seq, sequence, first.s AS session_seq FROM var1 WHERE rank = 1", _BY_CONTEXT),
)
def g14(spark, sf_dir):
    v = C.sequence_variants(_by_context(spark, sf_dir)).filter("rank = 1")
    return v.select("cluster_seq", F.array_join("actions", ">").alias("sequence"), c("first_session").alias("session_seq"))


def _summary(spark, sf_dir):
    """Facts of the signature groups, computed by the real cluster operator."""
    return C.summarize_clusters(
        I.signature_groups(spark, sf_dir), I.one_stream(I.assigned(spark, sf_dir)), _LOOSE
    )


# In a signature group all action sequences and contexts agree, so set and context
# similarity are 1; token sequences may differ in their applications.
_FACTS = f"""ok AS (SELECT DISTINCT cluster_seq FROM (SELECT cluster_seq, start_ts,
    lead(start_ts, 2) OVER (PARTITION BY cluster_seq ORDER BY start_ts, session_seq) AS reach FROM grouped)
    WHERE epoch_ms(reach) - epoch_ms(start_ts) <= 7 * 86400000),
mem AS (SELECT g.* FROM grouped g JOIN ok USING (cluster_seq)),
rep AS (SELECT cluster_seq, arg_min(tokens, start_time || '#' || lpad(session_seq::VARCHAR, 12, '0')) AS lt,
    arg_min(start_minute, start_time || '#' || lpad(session_seq::VARCHAR, 12, '0')) AS lm FROM mem GROUP BY 1),
pr1 AS (SELECT m.cluster_seq, m.session_seq, m.tokens AS t, r.lt, m.start_minute AS m, r.lm,
    least(2, greatest(1, least(len(m.tokens), len(r.lt)))) AS gn FROM mem m JOIN rep r USING (cluster_seq)),
pr2 AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, len(t) + 1), lambda z: 0),
      list_transform(lt, lambda a: list_prepend(0, list_transform(t, lambda b: (a = b)::INT)))),
    lambda prev, hit: list_transform(range(1, len(prev) + 1), lambda j: list_max(list_transform(range(1, j + 1),
      lambda i: greatest(prev[i], CASE WHEN i > 1 AND hit[i] = 1 THEN prev[i - 1] + 1 ELSE 0 END)))))[-1] AS lcs FROM pr1),
pr3 AS (SELECT *, {_GRAM.format('lt')} AS lg, {_GRAM.format('t')} AS g FROM pr2),
sim AS (SELECT cluster_seq, avg(lcs / greatest(len(t), len(lt)) * 0.75 + ({_jac('lg', 'g')}) * 0.25) AS seq_sim,
    avg(greatest(0, 1 - least(abs(m - lm), 1440 - abs(m - lm)) / 720)) AS tod_sim FROM pr3 GROUP BY 1),
app0 AS (SELECT cluster_seq, a, MIN(start_time || '#' || lpad(session_seq::VARCHAR, 12, '0') || '#' || lpad(p::VARCHAR, 6, '0')) AS f
    FROM (SELECT cluster_seq, start_time, session_seq, unnest(applications) AS a, generate_subscripts(applications, 1) AS p FROM mem) GROUP BY 1, 2),
apps AS (SELECT cluster_seq, list(a ORDER BY f) AS involved FROM app0 GROUP BY 1),
agg AS (SELECT cluster_seq, COUNT(*) AS n, SUM(round(duration_seconds * 1000)::BIGINT) / 1000 AS secs, any_value(actions) AS actions,
    any_value(workflow_signature) AS workflow_signature, SUM(len(applications)) AS na,
    SUM(len(list_filter(applications, lambda a: a IN ('chrome', 'safari', 'firefox')))) AS nb FROM mem GROUP BY 1),
facts0 AS (SELECT *, floor((seq_sim * 0.35 + 0.25 + 0.25 + tod_sim * 0.15) * 100 + 0.5) / 100 AS comp,
    floor(((seq_sim * 0.35 + 0.5 + tod_sim * 0.15) * 0.55 + 0.25 + least(1, n / 5) * 0.2) * 100 + 0.5) / 100 AS confidence, nb / na AS share
  FROM agg JOIN sim USING (cluster_seq) JOIN apps USING (cluster_seq)),
facts1 AS (SELECT *, CASE WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END + CASE WHEN comp >= 0.9 THEN 2 WHEN comp >= 0.75 THEN 1 ELSE 0 END
    + CASE WHEN share >= 0.7 THEN 1 ELSE 0 END + CASE WHEN len(actions) <= 8 THEN 1 ELSE 0 END - CASE WHEN len(involved) > 3 THEN 1 ELSE 0 END AS points FROM facts0),
facts2 AS (SELECT *, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS grade FROM facts1),
facts AS (SELECT *, CASE WHEN grade = 'low' THEN 'Manual review before automation' WHEN share >= 0.75 THEN 'Browser automation'
    WHEN list_contains(involved, 'chrome') THEN 'Hybrid desktop and browser automation' ELSE 'Desktop workflow automation' END AS approach,
    coalesce(list_filter(actions, lambda a: a <> 'unknown_action' AND NOT starts_with(a, 'open_') AND NOT starts_with(a, 'switch_to_'))[1], actions[1]) AS main,
    len(list_filter(involved, lambda a: a NOT IN ('chrome', 'safari', 'firefox'))) = 0 AS browser_only,
    len(list_filter(actions, lambda a: regexp_matches(a, '^(edit|update|verify|review)_'))) > 0 AS structured FROM facts2)"""

_HUMAN = "replace(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace({0}, '[._-]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' '), '{{id}}', '{{Id}}')"


@query(
    "g15_confidence",
    Q.upto("grouped", "SELECT cluster_seq, confidence AS confidence_score, comp AS composite, floor(seq_sim * 100 + 0.5) / 100 AS sequence, floor(tod_sim * 100 + 0.5) / 100 AS time_of_day FROM facts", _FACTS),
)
def g15(spark, sf_dir):
    d = c("confidence_details")
    return _summary(spark, sf_dir).select(
        "cluster_seq", "confidence_score", d["average_composite_similarity"].alias("composite"),
        d["average_sequence_similarity"].alias("sequence"), d["average_time_of_day_similarity"].alias("time_of_day"),
    )


@query("g16_suitability", Q.upto("grouped", "SELECT cluster_seq, grade AS automation_suitability FROM facts", _FACTS))
def g16(spark, sf_dir):
    return _summary(spark, sf_dir).select("cluster_seq", "automation_suitability")


@query("g17_workflow_names", Q.upto("grouped", f"SELECT cluster_seq, {_HUMAN.format('main')} || ' workflow' AS name FROM facts", _FACTS))
def g17(spark, sf_dir):
    return _summary(spark, sf_dir).select("cluster_seq", "name")


_STEPS = f"""st0 AS (SELECT session_seq, idx, action_name, application, domain, title_pattern,
    CASE WHEN title_pattern IS NOT NULL AND lower({_HUMAN.format('title_pattern')}) <> lower({_HUMAN.format('application')}) THEN {_HUMAN.format('title_pattern')}
         ELSE {_HUMAN.format('domain')} END AS where_ FROM placed),
st1 AS (SELECT *, concat_ws('|', application, action_name, coalesce(where_, '')) AS token FROM st0),
st2 AS (SELECT *, lag(token) OVER (PARTITION BY session_seq ORDER BY idx) AS prev FROM st1)"""


@query(
    "g18_step_texts",
    Q.upto("placed", f"""SELECT session_seq, string_agg(concat_ws(' ', {_HUMAN.format('action_name')},
      CASE WHEN action_name <> 'switch_to_' || application THEN 'in ' || {_HUMAN.format('application')} END, '(' || where_ || ')'), ' > ' ORDER BY idx) AS steps
      FROM st2 WHERE prev IS NULL OR prev <> token GROUP BY 1""", _STEPS),
)
def g18(spark, sf_dir):
    a = I.assigned(spark, sf_dir)
    texts = C.representative_steps(a, I.described(spark, sf_dir))
    return texts.select("session_seq", F.array_join("representative_steps", " > ").alias("steps"))


@query(
    "g19_automation_hints",
    Q.upto("grouped", """SELECT cluster_seq, array_to_string(CASE WHEN len(h) > 0 THEN h[1:3] ELSE [CASE WHEN approach = 'Browser automation' THEN 'Playwright' ELSE 'Python script' END] END, ', ') AS hints
      FROM (SELECT *, list_filter([CASE WHEN browser_only THEN 'Playwright' END, CASE WHEN browser_only AND structured THEN 'Internal admin API integration' END,
        CASE WHEN list_contains(involved, 'excel') THEN 'Excel macro' END, CASE WHEN list_contains(involved, 'slack') THEN 'n8n workflow' END,
        CASE WHEN list_contains(involved, 'outlook') THEN 'PowerShell' END], lambda x: x IS NOT NULL) AS h FROM facts)""", _FACTS),
)
def g19(spark, sf_dir):
    names = F.transform("automation_hints", lambda h: h["suggested_approach"])
    return _summary(spark, sf_dir).select("cluster_seq", F.array_join(names, ", ").alias("hints"))


@query(
    "g20_cluster_table",
    Q.upto("grouped", """SELECT cluster_seq, workflow_signature, sha1('workflow_cluster:' || workflow_signature) AS cluster_id, n AS frequency, round(secs, 3) AS total_duration_seconds,
      round(secs / n, 6) AS average_duration_seconds, array_to_string(actions, '>') AS sequence, array_to_string(involved, ',') AS involved_apps FROM facts""", _FACTS),
)
def g20(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "cluster_seq", "workflow_signature", "cluster_id", "frequency",
        F.round("total_duration_seconds", 3).alias("total_duration_seconds"),
        F.round("average_duration_seconds", 6).alias("average_duration_seconds"),
        F.array_join("representative_sequence", ">").alias("sequence"), F.array_join("involved_apps", ",").alias("involved_apps"),
    )


def _lane(n: str, source: str, threshold: float, frequency: int) -> str:
    """Statements that end in flow{n}: the confirmed workflows of one lane, founded, led and graded by the rules above."""
    return f"""{_led(source, threshold, n)},
ok{n} AS (SELECT DISTINCT stream_id, cluster_seq FROM (SELECT *, lead(start_ts, {frequency - 1})
      OVER (PARTITION BY stream_id, cluster_seq ORDER BY start_ts, session_seq) AS reach FROM clustered{n})
  WHERE epoch_ms(reach) - epoch_ms(start_ts) <= 7 * 86400000),
mem{n} AS (SELECT * FROM clustered{n} JOIN ok{n} USING (stream_id, cluster_seq)),
var{n} AS (SELECT stream_id, cluster_seq, array_to_string(actions, '>') AS sequence, COUNT(*) AS often,
    SUM(round(duration_seconds * 1000)::BIGINT) / 1000 / COUNT(*) AS mean, MIN(struct_pack(t := start_time, s := session_seq)) AS first
  FROM mem{n} GROUP BY ALL),
top{n} AS (SELECT stream_id, cluster_seq, often, first.s AS lead_seq FROM var{n}
  QUALIFY row_number() OVER (PARTITION BY stream_id, cluster_seq ORDER BY often DESC, mean DESC, first) = 1),
rep{n} AS (SELECT t.*, e.k AS rk, e.actions AS steps, e.workflow_signature AS signature
  FROM top{n} t JOIN el{n} e ON e.stream_id = t.stream_id AND e.session_seq = t.lead_seq),
kin{n} AS (SELECT m.stream_id, m.cluster_seq, avg(coalesce(w.total, 1.0)) AS mean_total, COUNT(*) AS size,
    SUM(round(m.duration_seconds * 1000)::BIGINT) / 1000 AS secs
  FROM mem{n} m JOIN rep{n} r USING (stream_id, cluster_seq)
  LEFT JOIN scored{n} w ON w.stream_id = m.stream_id AND w.j = least(m.k, r.rk) AND w.k = greatest(m.k, r.rk) GROUP BY ALL),
flow{n} AS (SELECT stream_id, cluster_seq, signature, size, secs,
    coalesce(list_filter(steps, lambda a: a <> 'unknown_action' AND NOT starts_with(a, 'open_') AND NOT starts_with(a, 'switch_to_'))[1], steps[1]) AS main,
    floor((mean_total * 0.55 + often / size * 0.25 + least(1, size / 5) * 0.2) * 100 + 0.5) / 100 AS confidence
  FROM rep{n} JOIN kin{n} USING (stream_id, cluster_seq))"""


# Both lanes: what no standard workflow has and is short enough goes to the second one.
_LANES = f"""{_lane('', 'grp0', 0.74, 3)},
rest AS (SELECT d.* FROM described d ANTI JOIN mem m ON m.stream_id = d.stream_id AND m.session_seq = d.session_seq
  WHERE d.duration_seconds BETWEEN 0 AND {20 * I.STRETCH} AND len(d.actions) BETWEEN 1 AND 3
    AND len(list_filter(d.actions, lambda a: a <> 'unknown_action' AND NOT starts_with(a, 'switch_to_'))) >= 1),
{_lane('_s', 'rest', 0.86, 3)},
flows AS (SELECT *, 'standard' AS detection_mode, sha1('workflow_cluster:' || signature) AS cluster_id FROM flow
  UNION ALL SELECT *, 'short_form', sha1('workflow_cluster:' || sha1('workflow_signature:short_form:' || signature)) FROM flow_s)"""

# Provisional workflows: every cluster counts, whatever its length and size.
_EMERGING = f"""{_lane('_e', 'described', 0.74, 1)},
hints AS (SELECT *, sha1('workflow_cluster:' || signature) AS cluster_id FROM flow_e)"""


@query("g21_two_lanes", Q.upto("grouped", f"""SELECT stream_id, cluster_id, detection_mode, {_HUMAN.format('main')} || ' workflow' AS name,
  size AS frequency, confidence AS confidence_score FROM flows""", _LANES))
def g21(spark, sf_dir):
    clusters, _ = find_workflows(I.described(spark, sf_dir), I.assigned(spark, sf_dir), I.OPTIONS)
    return clusters.select("stream_id", "cluster_id", "detection_mode", "name", "frequency", "confidence_score")


@query(
    "a6_stored_workflows",
    Q.upto("grouped", """SELECT m.stream_id, sha1('workflow_cluster:' || signature) AS cluster_id, m.session_seq, m.step_count, size AS frequency, round(secs, 3) AS total_duration_seconds
      FROM mem m JOIN flow USING (stream_id, cluster_seq)""", _lane("", "grp0", 0.6, 2)),
)
def a6_workflows(spark, sf_dir):
    """A run is stored with its workflows, and they are read back with their sessions and steps."""
    path = f"{scratch_dir(spark)}/runs-{uuid.uuid4().hex}"
    described, assigned = I.described(spark, sf_dir), I.assigned(spark, sf_dir)
    clusters, bridge = C.cluster_lane(described, assigned, WIDE)
    events = I.labelled(spark, sf_dir)
    run = SimpleNamespace(events=events, assigned=assigned, sessions=described, clusters=clusters, bridge=bridge)
    store.write_analysis(run, path)
    kept = store.read_analysis(spark, path)
    steps = kept["steps"].groupBy("stream_id", "session_seq").agg(F.count("*").alias("step_count"))
    members = kept["bridge"].join(kept["sessions"].select("stream_id", "session_seq"), ["stream_id", "session_seq"])
    named = kept["clusters"].select(
        "stream_id", "cluster_seq", "cluster_id", "frequency",
        F.round("total_duration_seconds", 3).alias("total_duration_seconds"),
    )
    return members.join(steps, ["stream_id", "session_seq"]).join(named, ["stream_id", "cluster_seq"]).select(
        "stream_id", "cluster_id", "session_seq", "step_count", "frequency", "total_duration_seconds"
    )


def _merge_rules(clusters):
    """Send every workflow to the first one of its applications."""
    target = clusters.groupBy("involved_apps").agg(F.min_by("workflow_signature", "cluster_seq").alias("target"))
    rows = clusters.join(target, "involved_apps")
    return rows.select(
        c("workflow_signature").alias("key"),
        F.struct(c("target").alias("merge_into_workflow_signature")).alias("feedback"),
    )


@query(
    "g22_merged_clusters",
    Q.upto("grouped", """SELECT workflow_signature, SUM(n)::BIGINT AS frequency, round(SUM(secs), 3) AS total_duration_seconds, round(SUM(confidence * n) / SUM(n), 9) AS confidence_score
      FROM (SELECT n, secs, confidence, first_value(workflow_signature) OVER (PARTITION BY array_to_string(involved, ',') ORDER BY cluster_seq) AS workflow_signature FROM facts) GROUP BY 1""", _FACTS),
)
def g22(spark, sf_dir):
    clusters = _summary(spark, sf_dir)
    bridge = I.signature_groups(spark, sf_dir).select(
        "stream_id", "cluster_seq", "session_seq", "session_id", F.lit("standard").alias("detection_mode")
    )
    merged, _ = H.merge_clusters(clusters, bridge, _merge_rules(clusters))
    return merged.select(
        "workflow_signature", "frequency", F.round("total_duration_seconds", 3).alias("total_duration_seconds"),
        F.round("confidence_score", 9).alias("confidence_score"),
    )


def _membership_sql(strategy: str) -> str:
    total = "w.total" if strategy == "hybrid_v2" else "sequence"
    others = ["action_set", "context", "time_of_day"] if strategy == "hybrid_v2" else ["0", "0", "0"]
    shown = " || '/' || ".join(f"floor({x} * 100 + 0.5)::INT" for x in ["score", "sequence", *others])
    return f"""
both_ways AS (SELECT stream_id, k, j, *  EXCLUDE (stream_id, k, j) FROM scored UNION ALL
  SELECT stream_id, j, k, * EXCLUDE (stream_id, k, j) FROM scored),
peer0 AS (SELECT a.stream_id, a.session_seq, b.session_seq AS peer, b.start_time, b.actions, b.contexts, {total} AS score,
    sequence, w.action_set, w.context, w.time_of_day
  FROM both_ways w JOIN clustered a ON a.stream_id = w.stream_id AND a.k = w.k
  JOIN clustered b ON b.stream_id = w.stream_id AND b.k = w.j WHERE a.cluster_seq = b.cluster_seq),
peer1 AS (SELECT *, floor(score * 100 + 0.5) / 100 AS rounded, row_number() OVER (PARTITION BY stream_id, session_seq
  ORDER BY floor(score * 100 + 0.5) DESC, start_time, peer) AS n FROM peer0),
peer2 AS (SELECT stream_id, session_seq, count(*) FILTER (n <= 2)::INT AS comparison_window,
    floor(avg(rounded) FILTER (n <= 2) * 100 + 0.5) / 100 AS membership_score,
    string_agg(peer || '=' || {shown} || ':' || array_to_string(actions, '>') || '@' || array_to_string(contexts, '+'), ' ' ORDER BY n)
      FILTER (n <= 3) AS peers FROM peer1 GROUP BY ALL),
explained AS (SELECT c.stream_id, c.cluster_seq, c.session_seq, '{strategy}' AS scoring_strategy, coalesce(comparison_window, 0) AS comparison_window,
    coalesce(membership_score, 0.0) AS membership_score, array_to_string(c.actions, '>') AS actions,
    array_to_string(c.contexts, '+') AS contexts, coalesce(p.peers, '') AS peers
  FROM clustered c LEFT JOIN peer2 p USING (stream_id, session_seq))"""


def _peer_texts():
    def percent(x):
        return F.floor(x * 100 + 0.5).cast("int").cast("string")

    def shown(p):
        parts = [p[f"{n}_similarity"] for n in ("composite", "sequence", "action_set", "context", "time_of_day")]
        sequence = F.array_join(p["peer_actions"], ">"), F.lit("@"), F.array_join(p["peer_contexts"], "+")
        return F.concat(p["peer_seq"], F.lit("="), F.concat_ws("/", *map(percent, parts)), F.lit(":"), *sequence)

    return F.array_join(F.transform("peers", shown), " ").alias("peers")


def _explained(members, strategy):
    return J.explain_membership(members, strategy=strategy).select(
        "stream_id", "cluster_seq", "session_seq", "scoring_strategy", "comparison_window", "membership_score",
        F.array_join("actions", ">").alias("actions"), F.array_join("contexts", "+").alias("contexts"), _peer_texts(),
    )


@query("g23_membership", Q.upto("grouped", "SELECT * FROM explained", _led("grp0", 0.74) + "," + _membership_sql("hybrid_v2")))
def g23(spark, sf_dir):
    d = C.eligible(I.described(spark, sf_dir), I.OPTIONS.clusters)
    return _explained(C.assign_clusters(d, I.OPTIONS.clusters), "hybrid_v2")


@query("g23_sequence_membership", Q.upto("grouped", "SELECT * FROM explained", _led("grp0", 0.74) + "," + _membership_sql("legacy")))
def g23_sequence(spark, sf_dir):
    d = C.eligible(I.described(spark, sf_dir), I.OPTIONS.clusters)
    return _explained(C.assign_clusters(d, I.OPTIONS.clusters), "legacy")


@query(
    "g24_benchmark",
    Q.upto("grouped", """SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT cluster_seq FROM grouped)) AS cluster_count,
      (SELECT SUM(x - 1) FROM (SELECT COUNT(DISTINCT primary_application) AS x FROM grouped GROUP BY cluster_seq))::BIGINT AS false_merges,
      (SELECT SUM(x - 1) FROM (SELECT COUNT(DISTINCT cluster_seq) AS x FROM grouped GROUP BY primary_application))::BIGINT AS false_splits"""),
)
def g24(spark, sf_dir):
    g = I.signature_groups(spark, sf_dir)
    out = J.benchmark_clusters(
        g.select("session_id", c("cluster_seq").alias("cluster_id")),
        g.select("session_id", c("primary_application").alias("expected")),
    )
    return out.select("cluster_count", "false_merges", "false_splits")


def _errors(n: str, name: str) -> str:
    return f"""e{n} AS (SELECT DISTINCT stream_id || ':' || cluster_seq AS cluster_id, primary_application FROM clustered{n}),
m{n} AS (SELECT COUNT(*) AS {name}_cluster_count, SUM(x - 1)::BIGINT AS {name}_false_merges FROM (SELECT COUNT(*) AS x FROM e{n} GROUP BY cluster_id)),
s{n} AS (SELECT SUM(x - 1)::BIGINT AS {name}_false_splits FROM (SELECT COUNT(*) AS x FROM e{n} GROUP BY primary_application)),
b{n} AS (SELECT *, {name}_false_merges + {name}_false_splits AS {name}_total_errors FROM m{n}, s{n})"""


@query(
    "g24_strategies",
    Q.upto("grouped", """SELECT *, floor(greatest(0, (legacy_total_errors - hybrid_v2_total_errors) / legacy_total_errors) * 100 + 0.5) / 100 AS improvement_rate FROM b_l, b_h""",
        ",".join([_led("grp0", 0.6, "_l", "sequence"), _errors("_l", "legacy"), _led("grp0", 0.6, "_h"), _errors("_h", "hybrid_v2")])),
)
def g24_strategies(spark, sf_dir):
    """A session's application stands in for the workflow expected of it."""
    d = C.eligible(I.described(spark, sf_dir), I.OPTIONS.clusters)
    labels = d.select("session_id", c("primary_application").alias("expected"))
    return J.compare_strategies(d, labels, WIDE)


# --- feedback ---------------------------------------------------------------------


def _log(spark, sf_dir):
    """A feedback log derived from the events: who touched which signature when."""
    e = I.raw(spark, sf_dir)
    k = F.pmod("seq", F.lit(7))
    none = F.lit(None)
    return e.select(
        F.lpad(c("seq").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("id-"), "stream_id").alias("workflow_cluster_id"),
        F.concat(F.lit("sig-"), "stream_id").alias("workflow_signature"),
        F.when(k == 0, F.concat(F.lit("Name "), c("seq").cast("string"))).alias("rename_to"),
        F.when(k == 1, F.lit("purpose")).alias("business_purpose"),
        F.when(k == 2, c("seq") % 2 == 0).alias("excluded"),
        F.when(k == 3, c("seq") % 2 == 0).alias("hidden"),
        F.when(k == 4, F.lit(True)).alias("repetitive"),
        none.cast("boolean").alias("automation_candidate"),
        none.cast("string").alias("automation_difficulty"),
        F.when(k == 5, c("seq") % 3 == 0).alias("approved_automation_candidate"),
        none.cast("string").alias("merge_into_workflow_id"),
        none.cast("string").alias("merge_into_workflow_signature"),
        F.when(k == 6, F.lit("search_order")).alias("split_after_action_name"),
        c("ts_text").alias("created_at"),
    )


_LOG = f"""lg AS (SELECT stream_id, seq, ts, CASE WHEN seq % 7 = 0 THEN 'Name ' || seq END AS rename_to, CASE WHEN seq % 7 = 1 THEN 'purpose' END AS business_purpose,
    CASE WHEN seq % 7 = 2 THEN seq % 2 = 0 END AS excluded, CASE WHEN seq % 7 = 3 THEN seq % 2 = 0 END AS hidden,
    CASE WHEN seq % 7 = 5 THEN seq % 3 = 0 END AS approved, CASE WHEN seq % 7 = 6 THEN 'search_order' END AS split_after,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || lpad(seq::VARCHAR, 12, '0') AS o FROM activity),
fold AS (SELECT stream_id, arg_max(rename_to, o) FILTER (WHERE rename_to IS NOT NULL) AS rename_to, MAX(business_purpose) AS business_purpose,
    arg_max(excluded, o) FILTER (WHERE excluded IS NOT NULL) AS excluded, arg_max(hidden, o) FILTER (WHERE hidden IS NOT NULL) AS hidden,
    arg_max(approved, o) FILTER (WHERE approved IS NOT NULL) AS approved, MAX(split_after) AS split_after FROM lg GROUP BY 1)"""


@query(
    "h1_folded_feedback",
    Q.upto("activity", """SELECT p || stream_id AS key, rename_to, business_purpose, excluded, hidden, approved, split_after FROM fold CROSS JOIN (VALUES ('sig-'), ('id-')) v(p)""", _LOG),
)
def h1(spark, sf_dir):
    f = c("feedback")
    return H.fold_feedback(_log(spark, sf_dir)).select(
        "key", f["rename_to"].alias("rename_to"), f["business_purpose"].alias("business_purpose"),
        f["excluded"].alias("excluded"), f["hidden"].alias("hidden"),
        f["approved_automation_candidate"].alias("approved"), f["split_after_action_name"].alias("split_after"),
    )


def _stream_clusters(spark, sf_dir):
    """One stand-in workflow per stream, with the ids the feedback log refers to."""
    return I.raw(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("frequency")).select(
        "stream_id",
        F.concat(F.lit("id-"), "stream_id").alias("cluster_id"),
        F.concat(F.lit("sig-"), "stream_id").alias("workflow_signature"),
        F.concat(F.lit("Workflow "), "stream_id").alias("name"),
        "frequency",
    )


@query(
    "h2_record_feedback",
    Q.upto("activity", """SELECT CASE WHEN seq % 7 IN (0, 2) AND stream_id::INT % 2 = 0 THEN 'accepted' WHEN stream_id::INT % 2 = 1 AND seq % 7 IN (0, 2) THEN 'workflow not found' ELSE 'at least one field is required' END AS outcome,
      COUNT(*) AS entries FROM activity GROUP BY 1"""),
)
def h2(spark, sf_dir):
    entries = _log(spark, sf_dir)
    for f in ("business_purpose", "hidden", "repetitive", "approved_automation_candidate", "split_after_action_name"):
        entries = entries.withColumn(f, F.lit(None).cast(entries.schema[f].dataType))
    known = _stream_clusters(spark, sf_dir).filter(c("stream_id").cast("int") % 2 == 0)
    accepted, rejected = H.record_feedback(entries, known)
    return (
        accepted.select(F.lit("accepted").alias("outcome"))
        .unionByName(rejected.select(c("error").alias("outcome")))
        .groupBy("outcome")
        .agg(F.count("*").alias("entries"))
    )


@query(
    "h3_applied_feedback",
    Q.upto("activity", """SELECT stream_id, coalesce(rename_to, 'Workflow ' || stream_id) AS name, coalesce(excluded, false) AS excluded, coalesce(hidden, false) AS hidden,
      coalesce(rename_to <> '', business_purpose <> '', excluded, hidden, approved, split_after <> '', false) AS user_labeled FROM fold""", _LOG),
)
def h3(spark, sf_dir):
    folded = H.fold_feedback(_log(spark, sf_dir).filter("repetitive IS NULL"))
    return H.apply_feedback(_stream_clusters(spark, sf_dir), folded).select(
        "stream_id", "name", "excluded", "hidden", "user_labeled"
    )


@query(
    "h4_resolved_feedback",
    Q.upto("described", """SELECT session_seq, CASE WHEN first_char IN ('0', '1', '2', '3') THEN 'standard' WHEN legacy_char IN ('0', '1', '2', '3') THEN 'legacy' END AS found
      FROM (SELECT session_seq, left(workflow_signature, 1) AS first_char, left(sha1('workflow_signature:' || array_to_string(actions, '>')), 1) AS legacy_char FROM described)"""),
)
def h4(spark, sf_dir):
    d = I.described(spark, sf_dir).select("session_seq", "workflow_signature", "legacy_signature")

    def rules(column, name):
        return (
            d.filter(c(column).rlike("^[0-3]"))
            .select(c(column).alias("key"), F.struct(F.lit(name).alias("found")).alias("feedback"))
            .distinct()
        )

    folded = rules("workflow_signature", "standard").unionByName(rules("legacy_signature", "legacy"))
    out = H.resolve_feedback(d, folded, ["workflow_signature", "legacy_signature"])
    return out.select("session_seq", c("feedback")["found"].alias("found"))


@query(
    "h5_affected_workflows",
    Q.upto("grouped", """SELECT DISTINCT a.workflow_signature AS reviewed, b.workflow_signature AS affected FROM facts a JOIN facts b
      ON a.cluster_seq = b.cluster_seq
        OR b.actions = a.actions[1:list_position(a.actions, 'search_order')] AND list_position(a.actions, 'search_order') > 0
        OR (b.actions = a.actions[list_position(a.actions, 'search_order') + 1:] AND list_position(a.actions, 'search_order') > 0)""", _FACTS),
)
def h5(spark, sf_dir):
    clusters = _summary(spark, sf_dir)
    events = (
        I.signature_groups(spark, sf_dir)
        .join(clusters.select("cluster_seq", "cluster_id"), "cluster_seq")
        .select("session_seq", "cluster_id")
        .join(I.assigned(spark, sf_dir).select("session_seq", c("id").alias("normalized_event_id")), "session_seq")
        .select("cluster_id", "normalized_event_id")
    )
    reviews = clusters.select(
        c("cluster_id").alias("workflow_cluster_id"),
        F.lit(None).cast("string").alias("merge_into_workflow_id"),
        F.lit("search_order").alias("split_after_action_name"),
    )
    out = H.affected_workflows(clusters, events, clusters, events, reviews)
    sign = clusters.select(c("cluster_id").alias("workflow_cluster_id"), c("workflow_signature").alias("reviewed"))
    return out.join(sign, "workflow_cluster_id").select("reviewed", c("workflow_signature").alias("affected"))
