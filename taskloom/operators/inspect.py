"""Coverage, data quality and lineage."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, stable_id
from ..options import ClusterOptions, SimilarityWeights
from .clusters import CLUSTER
from .leaders import Members, assign_clusters, strategy_weights
from .sessions import SESSION

UNKNOWN = "unknown_action"
BROWSER_NAMES = ["chrome", "google chrome", "chrome browser", "firefox", "safari"]
LAYERS = ["domain_pack", "page_type", "generic", "unknown"]


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


# --- coverage ---------------------------------------------------------------------


def domain_pack_coverage(events: DataFrame) -> DataFrame:
    """Matched browser events per domain, and overall in the row without a domain."""
    browser = (
        (F.col("source") == "chrome_extension")
        | F.coalesce(F.col("browser_schema_version") > 0, F.lit(False))
        | has_text(F.col("domain"))
    )
    matched = F.count(F.when(has_text(F.col("route_family")), 1))
    total = F.count("*")
    return (
        events.filter(browser)
        .select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "route_family")
        .rollup("domain")
        .agg(
            total.alias("total_browser_events"),
            matched.alias("matched_events"),
            (total - matched).alias("unmatched_events"),
            rate(matched, total).alias("match_rate"),
        )
        .orderBy(F.desc("unmatched_events"), F.desc("total_browser_events"), "domain")
    )


def domain_pack_listing(events: DataFrame) -> DataFrame:
    """What each event was recognised as."""
    return events.select(
        "stream_id", "raw_event_id", F.col("ts_text").alias("timestamp"), "domain", "route_template", "route_family",
        "page_type", "resource_hint", "domain_pack_id", "domain_pack_version",
    )


def layer_of(events: DataFrame) -> Column:
    return F.coalesce(
        F.col("action_match.layer"),
        F.when(F.col("action_name") == UNKNOWN, F.lit("unknown")).otherwise(F.lit("generic")),
    )


def layer_coverage(events: DataFrame) -> DataFrame:
    """Events and share per matching layer; every layer has a row."""
    found = events.groupBy(layer_of(events).alias("layer")).agg(F.count("*").alias("n"))
    zero = F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(0).cast("long").alias("n")) for x in LAYERS])
    pinned = events.agg(F.count("*").alias("total")).select(F.explode(zero).alias("z")).select("z.*")
    counts = pinned.unionByName(found).groupBy("layer").agg(F.sum("n").alias("event_count"))
    total = F.sum("event_count").over(Window.partitionBy())
    return counts.withColumn("rate", rate(F.col("event_count"), total))


def pack_coverage(events: DataFrame) -> DataFrame:
    """Events per action pack."""
    unknown = F.count(F.when(F.col("action_name") == UNKNOWN, 1))
    return (
        events.filter(has_text(F.col("action_match.pack_id")))
        .groupBy(F.col("action_match.pack_id").alias("pack_id"))
        .agg(
            F.count("*").alias("event_count"),
            unknown.alias("unknown_event_count"),
            rate(unknown, F.count("*")).alias("unknown_rate"),
        )
        .orderBy(F.desc("event_count"), "pack_id")
    )


def top_actions(events: DataFrame, limit: int = 10) -> DataFrame:
    """J2, J5."""
    return (
        events.groupBy("action_name")
        .agg(F.count("*").alias("event_count"))
        .orderBy(F.desc("event_count"), "action_name")
        .limit(limit)
    )


def action_totals(events: DataFrame) -> DataFrame:
    unknown = F.count(F.when(F.col("action_name") == UNKNOWN, 1))
    return events.agg(
        F.count("*").alias("total_events"),
        unknown.alias("unknown_event_count"),
        rate(unknown, F.count("*")).alias("unknown_rate"),
    )


def workflow_unknown_rate(clusters: DataFrame, members: DataFrame, limit: int = 20) -> DataFrame:
    """Share of unlabelled steps in the most frequent workflows.

    ``members``: one row per session of a cluster with step_count and unknown_count.
    """
    top = clusters.orderBy(
        F.desc("frequency"), F.desc("total_duration_seconds"), "name"
    ).limit(limit)
    sums = members.groupBy(*CLUSTER).agg(
        F.sum("unknown_count").alias("unknown_action_count"),
        F.sum("step_count").alias("total_action_count"),
    )
    return (
        top.join(sums, CLUSTER, "left")
        .na.fill(0, ["unknown_action_count", "total_action_count"])
        .withColumn("unknown_rate", rate(F.col("unknown_action_count"), F.col("total_action_count")))
    )


def unknown_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*SESSION).agg(
        F.count("*").alias("step_count"),
        F.count(F.when(F.col("action_name") == UNKNOWN, 1)).alias("unknown_count"),
    )


REVIEW_KEY = ["application", "action", "domain_pack_id", "route_family", "page_type"]


def review_queue(events: DataFrame, samples: int = 3) -> DataFrame:
    """Unlabelled events grouped for review, with the first few distinct samples.

    Each sample kind is reduced to its distinct values before ranking, so a group that
    holds most of the events never gathers in one place.
    """
    unknown = events.filter(F.col("action_name") == UNKNOWN).select(
        *REVIEW_KEY,
        F.struct("ts", "ts_text", "stream_id", "seq").alias("at"),
        F.col("raw.domain").alias("raw_domain"),
        "target",
        "title_pattern",
        "raw_event_id",
    )
    groups = unknown.groupBy(*REVIEW_KEY).agg(
        F.count("*").alias("occurrences"), F.min_by("raw_domain", "at").alias("_domain")
    )
    rank = Window.partitionBy(*REVIEW_KEY, "kind").orderBy("first")
    kinds = {"target": "sample_targets", "title_pattern": "sample_titles", "raw_event_id": "sample_raw_event_ids"}
    kind_of = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    )
    picked = (
        unknown.withColumn("s", kind_of)
        .filter(has_text(F.col("s.value")))
        .groupBy(*REVIEW_KEY, "s.kind", "s.value")
        .agg(F.min("at").alias("first"))
        .withColumn("_n", F.row_number().over(rank))
        .filter(F.col("_n") <= samples)
    )
    lists = picked.groupBy(*REVIEW_KEY).agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("kind") == k, F.struct("_n", "value")))
                ),
                lambda s: s["value"],
            ).alias(name)
            for k, name in kinds.items()
        ]
    )
    g, l = groups.alias("g"), lists.alias("l")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"l.{k}")) for k in REVIEW_KEY]
    key = F.concat_ws(
        "|",
        "g.application",
        "g.action",
        F.coalesce("g.domain_pack_id", F.lit("no-pack")),
        F.coalesce("g.route_family", F.lit("no-route-family")),
        F.coalesce("g.page_type", F.lit("no-page-type")),
    )
    return g.join(l, same, "left").select(
        stable_id("unknown_action_queue", key).alias("queue_id"),
        "occurrences",
        "g.application",
        F.col("g.action").alias("event_type"),
        F.when(F.col("g.domain_pack_id").isNull(), F.col("_domain")).alias("domain"),
        "g.domain_pack_id",
        "g.route_family",
        "g.page_type",
        *[f"l.{name}" for name in kinds.values()],
    ).orderBy(F.desc("occurrences"), "queue_id")


# --- quality ----------------------------------------------------------------------


def count_by(rows: DataFrame, column: Column | str, limit: int | None = None) -> DataFrame:
    key = F.col(column) if isinstance(column, str) else column
    counted = (
        rows.groupBy(key.alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
    )
    return counted if limit is None else counted.limit(limit)


def raw_quality(raw: DataFrame) -> DataFrame:
    """One row of facts about the raw events."""
    n = lambda test: F.count(F.when(test, 1))
    app = F.lower(F.trim("application"))
    stamped = F.col("browser_schema_version").isNotNull()
    return raw.agg(
        F.count("*").alias("raw_events"),
        F.max("ts").alias("latest_raw_event"),
        n(F.col("source_event_type").isin("app.switch", "application.switch") & app.isin(BROWSER_NAMES)).alias("browser_app_switch_events"),
        n(F.col("source") == "chrome_extension").alias("chrome_extension_events"),
        n(F.col("source_event_type").rlike(r"^(?:browser|chrome|dom|form|tab)\.")).alias("browser_navigation_events"),
        n(stamped).alias("raw_with_browser_schema"),
        n(F.col("canonical_url").isNotNull()).alias("raw_with_canonical_url"),
        n(F.col("route_template").isNotNull()).alias("raw_with_route_template"),
        n(stamped & ~has_text(F.col("canonical_url")) & ~has_text(F.col("route_template"))).alias("raw_schema_without_route_context"),
    )


def event_quality(events: DataFrame) -> DataFrame:
    """One row of facts about the normalised events."""
    n = lambda test: F.count(F.when(test, 1))
    switches = n(F.col("action_name").startswith("switch_to_"))
    total = F.count("*")
    return events.agg(
        total.alias("normalized_events"),
        F.max("ts").alias("latest_normalized_event"),
        n(F.col("application") == "chrome").alias("normalized_chrome_events"),
        n(F.col("domain").isNotNull()).alias("normalized_with_domain"),
        n(F.col("route_family").isNotNull()).alias("normalized_with_route_family"),
        n(F.col("domain_pack_id").isNotNull()).alias("normalized_with_domain_pack"),
        switches.alias("switch_actions"),
        (total - switches).alias("non_switch_actions"),
        n(F.col("action_name") == "switch_to_").alias("empty_switch_actions"),
        F.coalesce(
            F.floor(F.try_divide(switches, total) * 1000 + 0.5) / F.lit(10.0), F.lit(0.0)
        ).alias("switch_action_pct"),
    )


def session_quality(sessions: DataFrame) -> DataFrame:
    """One row of facts about the sessions (J5); durations may be negative here."""
    n = lambda test: F.count(F.when(test, 1))
    seconds = (F.unix_millis("end_ts") - F.unix_millis("start_ts")) / F.lit(1000)
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.max("end_ts").alias("latest_end"),
        n(seconds < 0).alias("negative_duration_sessions"),
        n(F.abs(seconds) < 1).alias("zero_or_subsecond_sessions"),
        n(seconds <= 5).alias("lte_5_second_sessions"),
        n(seconds.between(0, 20) & (F.col("step_count") <= 3)).alias("short_form_eligible_sessions"),
    )


def is_generic(sequence: Column) -> Column:
    return (F.size(sequence) > 0) & F.forall(
        sequence, lambda a: (a == UNKNOWN) | a.startswith("switch_to_")
    )


def cluster_quality(clusters: DataFrame) -> DataFrame:
    """One row of facts about the workflows."""
    n = lambda test: F.count(F.when(test, 1))
    generic = is_generic(F.col("representative_sequence"))
    return clusters.agg(
        F.count("*").alias("total_clusters"),
        n(F.col("detection_mode") == "short_form").alias("short_form_clusters"),
        n(generic).alias("generic_clusters"),
        n(generic & (F.col("detection_mode") == "short_form")).alias("generic_short_form_clusters"),
        n(F.col("user_labeled")).alias("user_labeled_clusters"),
    )


def unanalyzed(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Raw events without a normalised counterpart: count, first, last."""
    missing = raw.join(events.select(F.col("raw_event_id").alias("id")), "id", "left_anti")
    return missing.agg(
        F.count("*").alias("unanalyzed_count"),
        F.min("ts").alias("first_unanalyzed"),
        F.max("ts").alias("last_unanalyzed"),
    )


def quality_report(raw, events, sessions, clusters) -> DataFrame:
    """All facts in one row; each part is a single pass, and one row is all that meets."""
    out = None
    for part in (
        raw_quality(raw),
        unanalyzed(raw, events),
        event_quality(events),
        session_quality(sessions),
        cluster_quality(clusters),
    ):
        keyed = part.withColumn("_one", F.lit(1))
        out = keyed if out is None else out.join(keyed, "_one")
    return out.drop("_one")


def quality_issues(report: DataFrame) -> DataFrame:
    """The report's findings as rows (J6). Messages are fixed values."""
    c = F.col

    def issue(test, code, severity, message, field) -> Column:
        return F.when(
            test,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                F.lit(message).alias("message"),
                c(field).cast("double").alias("detail"),
            ),
        )

    rules = [
        issue((c("browser_app_switch_events") > 0) & (c("chrome_extension_events") == 0) & (c("browser_navigation_events") == 0),
              "browser_context_missing", "error",
              "Browser app-switch activity exists, but no browser extension context events were stored.",
              "browser_app_switch_events"),
        issue(c("raw_schema_without_route_context") > 0, "browser_schema_without_route_context", "warn",
              "Browser schema version was stamped on events that still have no canonical URL or route template.",
              "raw_schema_without_route_context"),
        issue(c("unanalyzed_count") > 0, "analysis_artifacts_stale", "warn",
              "Raw events exist that have not been normalized into stored analysis artifacts yet.",
              "unanalyzed_count"),
        issue(c("switch_action_pct") >= 80, "action_abstraction_switch_heavy", "warn",
              "Most normalized events still collapse to switch_to_* actions.", "switch_action_pct"),
        issue(c("empty_switch_actions") > 0, "broken_application_identifier_actions", "error",
              "One or more inferred switch_to_* actions lost the application identifier entirely.",
              "empty_switch_actions"),
        issue(c("negative_duration_sessions") > 0, "negative_session_durations", "error",
              "One or more sessions ended before they started after timestamp parsing.",
              "negative_duration_sessions"),
        issue(c("generic_short_form_clusters") > 0, "generic_short_form_clusters", "warn",
              "Short-form workflow detection is promoting generic switch-only clusters.",
              "generic_short_form_clusters"),
    ]
    return report.select(F.explode(F.array_compact(F.array(*rules))).alias("i")).select("i.*")


def analysis_readiness(
    raw: DataFrame, events: DataFrame, sessions: DataFrame | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """empty / needs_analysis / stale / ready, with the counts behind it (J8). What is not given counts as none."""

    def facts(df, name, latest=None):
        cells = [F.count("*").alias(f"{name}_count")]
        if latest:
            cells.append(F.max("ts").alias(latest))
        return df.agg(*cells).withColumn("_one", F.lit(1))

    joined = facts(raw, "raw_event", "latest_raw_event_at").join(
        facts(events, "normalized_event", "latest_normalized_event_at"), "_one"
    )
    for df, name in ((sessions, "session"), (clusters, "workflow")):
        if df is None:
            joined = joined.withColumn(f"{name}_count", F.lit(0).cast("long"))
        else:
            joined = joined.join(facts(df, name), "_one")
    kind = (
        F.when(F.col("raw_event_count") == 0, F.lit("empty"))
        .when(F.col("normalized_event_count") == 0, F.lit("needs_analysis"))
        .when(
            (F.col("raw_event_count") != F.col("normalized_event_count"))
            | F.coalesce(F.col("latest_raw_event_at") > F.col("latest_normalized_event_at"), F.lit(False)),
            F.lit("stale"),
        )
        .otherwise(F.lit("ready"))
    )
    return joined.drop("_one").withColumn("readiness", kind)


# --- lineage ----------------------------------------------------------------------


def event_lineage(raw: DataFrame, events: DataFrame, steps: DataFrame, bridge: DataFrame, clusters: DataFrame) -> DataFrame:
    """Raw event -> label -> session step -> workflow, for every raw event."""
    labelled = events.select(
        F.col("raw_event_id").alias("id"),
        F.col("id").alias("normalized_event_id"),
        "action_name",
        "action_confidence",
        "action_source",
    )
    placed = steps.select("normalized_event_id", "session_seq", "step_order")
    homes = bridge.select("stream_id", "session_seq", "cluster_seq", "detection_mode")
    named = clusters.select(*CLUSTER, "detection_mode", "cluster_id", "name")
    return (
        raw.select("id", "stream_id", "seq", "ts_text")
        .join(labelled, "id", "left")
        .join(placed, "normalized_event_id", "left")
        .join(homes, ["stream_id", "session_seq"], "left")
        .join(named, [*CLUSTER, "detection_mode"], "left")
    )


def session_lineage(
    steps: DataFrame, sessions: DataFrame, raw: DataFrame, bridge: DataFrame | None = None, clusters: DataFrame | None = None
) -> DataFrame:
    """Session -> its raw events, and with a bridge its workflow."""
    rows = (
        steps.join(sessions.select(*SESSION, "session_id"), SESSION)
        .join(raw.select(F.col("id").alias("raw_event_id"), "source_event_type"), "raw_event_id")
        .select(*SESSION, "session_id", "step_order", "raw_event_id", "source_event_type", "action_name")
    )
    if bridge is None:
        return rows.drop("session_seq")
    homes = bridge.select(*SESSION, "cluster_seq", "detection_mode")
    named = clusters.select(*CLUSTER, "detection_mode", "cluster_id", "name")
    return rows.join(homes, SESSION, "left").join(named, [*CLUSTER, "detection_mode"], "left").drop("session_seq")


def workflow_lineage(
    clusters: DataFrame,
    bridge: DataFrame,
    described: DataFrame,
    weights: SimilarityWeights = SimilarityWeights(),
    strategy: str = "hybrid_v2",
) -> DataFrame:
    """Workflow -> its sessions, each with why it belongs there (J10): one row for each member."""
    named = clusters.select(*CLUSTER, "detection_mode", "cluster_id", "name", "frequency")
    placed = bridge.select(*CLUSTER, "session_seq", "detection_mode")
    members = described.join(placed, SESSION)
    # A session is in one workflow only, so both lanes are explained at once.
    why = explain_membership(members, weights, strategy=strategy)
    facts = members.select(
        *SESSION, "detection_mode", "session_id", "start_time", "end_time", "primary_application", "primary_domain", "step_count"
    )
    return why.join(facts, SESSION).join(named, [*CLUSTER, "detection_mode"])


PEERS = 4
_PEER = (
    "peer_seq long, peer_start string, peer_actions array<string>, peer_contexts array<string>, "
    "sequence_similarity double, action_set_similarity double, context_similarity double, "
    "time_of_day_similarity double, composite_similarity double"
)


def _rounded(x: float) -> float:
    return float(np.floor(x * 100 + 0.5) / 100)


def best_peers(asked: list, peers: list, weights, all_parts: bool = True) -> tuple[list[tuple], int]:
    """For each asked descriptor its PEERS best sessions among those of the peers, and how many pairs were scored.

    Peers are taken by falling upper bound; once the last one kept beats the bound, no other can enter.
    """
    index = Members(peers, weights)
    out = []
    for row in asked:
        most, shared, rest = index.parts(row)
        bound = index.total(most, rest)
        tokens, best = tuple(row.tokens), []
        for i in np.argsort(-bound, kind="stable").tolist():
            if len(best) == PEERS and _rounded(bound[i] + 1e-9) < -best[-1][0]:
                break
            sequence = index.sequence(i, tokens, shared[i])
            parts = sequence, *(float(x[i]) for x in rest)
            score = _rounded(index.total(sequence, parts[1:]))
            best += [(-score, s["start_time"], s["session_seq"], i, parts) for s in peers[i].sessions]
            best = sorted(best)[:PEERS]
        for score, start, seq, i, parts in best:
            shown = parts if all_parts else (parts[0], 0.0, 0.0, 0.0)
            out.append((
                row.stream_id, row.cluster_seq, row.descriptor, seq, start, list(peers[i].actions),
                list(peers[i].contexts), *(_rounded(x) for x in shown), -score,
            ))
    return out, index.scored


def explain_membership(
    members: DataFrame,
    weights: SimilarityWeights = SimilarityWeights(),
    block: int = 500,
    strategy: str = "hybrid_v2",
) -> DataFrame:
    """Per session: the three most similar peers of its workflow, with their sequences, and its score.

    Sessions with equal descriptors have equal similarities, so only distinct descriptors are compared, and of each only
    its first four sessions can be anyone's best peers. A large workflow meets itself block by block, and in a
    pair of blocks only as many pairs are scored as upper bounds leave open. Workflows within a block share lots of
    about a block of descriptors each, so that many tiny ones are few groups; one of a single session has no peers.
    """
    keys = [*CLUSTER, "descriptor"]
    order = Window.partitionBy(*keys).orderBy("start_time", "session_seq")
    few = members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= PEERS)
    distinct = few.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start_time", "session_seq"))).alias("sessions"),
        *[F.first(c).alias(c) for c in ("tokens", "actions", "action_set", "contexts", "start_minute")],
    )
    sizes = distinct.groupBy(*CLUSTER).agg(F.count("*").alias("_size"), F.sum(F.size("sessions")).alias("_sessions"))
    sizes = sizes.filter(F.col("_sessions") > 1).withColumn("blocks", F.ceil(F.col("_size") / block).cast("int"))
    # One row: how many lots the workflows of one block fill.
    lots = sizes.filter("blocks = 1").agg(F.ceil(F.sum("_size") / block).alias("_lots"), F.lit(1).alias("_one"))
    small = F.col("blocks") == 1
    sizes = sizes.withColumn("_one", F.lit(1)).join(lots, "_one").select(
        *CLUSTER, "blocks",
        F.when(small, F.lit("")).otherwise(F.col("stream_id")).alias("home"),
        F.when(small, F.pmod(F.xxhash64(*CLUSTER), "_lots")).otherwise(F.col("cluster_seq")).alias("lot"),
    )
    placed = distinct.join(sizes, CLUSTER).withColumn("block", F.pmod(F.xxhash64("descriptor"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
    facts = ["tokens", "actions", "action_set", "contexts", "start_minute", "sessions"]
    asked = placed.select(
        *keys, "tokens", "action_set", "contexts", "start_minute", "blocks", "home", "lot", F.col("block").alias("own"), every.alias("other")
    )
    # Named anew, as both sides come from the same rows.
    shared = [*CLUSTER, "blocks", "home", "lot"]
    peers = placed.select(
        *[F.col(k).alias(f"peer_{k}") for k in shared], *[F.col(f).alias(f) for f in facts],
        F.col("block").alias("peer_other"), every.alias("peer_own"),
    )
    of_parts = strategy_weights(strategy, weights)
    columns = [*keys, *[c.split()[0] for c in _PEER.split(", ")]]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for row in right.itertuples(index=False):
            near.setdefault((row.peer_stream_id, row.peer_cluster_seq), []).append(row)
        here: dict = {}
        for row in left.itertuples(index=False):
            here.setdefault((row.stream_id, row.cluster_seq), []).append(row)
        found = [best_peers(rows, near.get(flow, []), of_parts, strategy != "legacy")[0] for flow, rows in here.items()]
        return pd.DataFrame([row for rows in found for row in rows], columns=columns)

    # ``blocks`` keeps lots apart from large workflows.
    met = asked.groupBy("blocks", "home", "lot", "own", "other").cogroup(
        peers.groupBy("peer_blocks", "peer_home", "peer_lot", "peer_own", "peer_other")
    )
    met = met.applyInPandas(compare, f"stream_id string, cluster_seq long, descriptor string, {_PEER}")
    rank = [F.desc("composite_similarity"), F.col("peer_start"), F.col("peer_seq")]
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).filter(F.col("_n") <= PEERS)
    ranked = F.array_sort(F.collect_list(F.struct("_n", F.struct(*columns[3:]).alias("peer"))))
    listed = met.groupBy(*keys).agg(F.transform(ranked, lambda r: r["peer"]).alias("peers"))
    listed = members.join(listed, keys, "left")
    others = F.coalesce(F.filter("peers", lambda p: p["peer_seq"] != F.col("session_seq")), F.array())
    top = F.slice(others, 1, 2)
    mean = F.aggregate(top, F.lit(0.0), lambda a, p: a + p["composite_similarity"]) / F.greatest(F.size(top), F.lit(1))
    return listed.select(
        *CLUSTER,
        "session_seq",
        F.lit(strategy).alias("scoring_strategy"),
        F.size(top).alias("comparison_window"),
        (F.floor(mean * 100 + 0.5) / F.lit(100.0)).alias("membership_score"),
        "actions",
        "contexts",
        F.slice(others, 1, 3).alias("peers"),
    )


def benchmark_clusters(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """False merges and splits against expected workflows.

    ``assignments``: (session_id, cluster_id); ``labels``: (session_id, expected).
    """
    joined = assignments.join(labels, "session_id").select("cluster_id", "expected").distinct()
    extra = lambda c: F.coalesce(F.sum(F.greatest(F.col(c) - 1, F.lit(0))), F.lit(0))
    merges = joined.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("cluster_count"), extra("n").alias("false_merges"), F.lit(1).alias("_one")
    )
    splits = joined.groupBy("expected").agg(F.count("*").alias("n")).agg(
        extra("n").alias("false_splits"), F.lit(1).alias("_one")
    )
    return (
        merges.join(splits, "_one")
        .drop("_one")
        .withColumn("total_errors", F.col("false_merges") + F.col("false_splits"))
    )


def compare_strategies(described: DataFrame, labels: DataFrame, options: ClusterOptions) -> DataFrame:
    """False merges and splits of both scoring strategies, and the share of errors the second saves."""
    found = None
    for strategy in ("legacy", "hybrid_v2"):
        members = assign_clusters(described, replace(options, strategy=strategy))
        home = F.concat_ws(":", "stream_id", F.col("cluster_seq").cast("string"))
        one = benchmark_clusters(members.select("session_id", home.alias("cluster_id")), labels)
        one = one.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{strategy}_{c}") for c in one.columns])
        found = one if found is None else found.join(one, "_one")
    rate_of = improvement_rate(F.col("legacy_total_errors"), F.col("hybrid_v2_total_errors"))
    return found.drop("_one").withColumn("improvement_rate", rate_of)


def improvement_rate(baseline_errors: Column, errors: Column) -> Column:
    """Share of the baseline's errors that are gone."""
    raw = F.when(
        baseline_errors == 0, F.when(errors == 0, 1.0).otherwise(0.0)
    ).otherwise(F.greatest(F.lit(0.0), (baseline_errors - errors) / baseline_errors))
    return F.floor(raw * 100 + 0.5) / F.lit(100.0)
