"""Workflow discovery: descriptors, greedy clustering, cluster facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import (
    composite,
    sequence_score,
    similarity_parts,
)
from ..functions.text import (
    capitalize_words,
    compact_runs,
    has_text,
    humanize,
    round_score,
    savings_text,
    stable_id,
)
from ..options import ClusterOptions, ShortFormOptions
from ..plans.materialize import materialize
from ..plans.slices import in_stream_order
from ..rules import vocabulary as V
from .leaders import assign_clusters
from .sessions import SESSION

CLUSTER = ["stream_id", "cluster_seq"]


# --- descriptors ------------------------------------------------------------------


def signature(actions: Column, contexts: Column) -> Column:
    """What a workflow is, independent of when it ran."""
    text = F.concat(F.array_join(actions, ">"), F.lit("||"), F.array_join(contexts, ">"))
    return stable_id("workflow_signature", text)


def short_form_signature(standard: Column) -> Column:
    return stable_id("workflow_signature", F.concat(F.lit("short_form:"), standard))


def legacy_signature(actions: Column) -> Column:
    return stable_id("workflow_signature", F.array_join(actions, ">"))


def describe_sessions(assigned: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with the facts similarity looks at.

    Only the first event of each run of equal steps is shuffled.
    """
    runs = (
        assigned.filter("token_start")
        .groupBy(*SESSION)
        .agg(
            F.array_sort(F.collect_list(F.struct("ord", "application", "action_name"))).alias("runs")
        )
    )
    step = F.col("runs")
    tokens = compact_runs(
        F.transform(step, lambda r: F.concat(r["application"], F.lit("|"), r["action_name"]))
    )
    actions = compact_runs(F.transform(step, lambda r: r["action_name"]))
    prefixed = F.when(
        F.size("domains") > 0,
        F.transform("domains", lambda d: F.concat(F.lit("domain:"), d)),
    ).otherwise(F.transform("applications", lambda a: F.concat(F.lit("app:"), a)))
    seconds = F.greatest(
        F.lit(0.0), (F.unix_millis("end_ts") - F.unix_millis("start_ts")) / F.lit(1000)
    )
    known = F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()
    return (
        sessions.join(runs, SESSION)
        .withColumns(
            {
                "tokens": tokens,
                "actions": actions,
                "contexts": F.array_sort(prefixed),
                "duration_seconds": F.when(known, seconds),
                "start_minute": F.hour("start_ts") * 60 + F.minute("start_ts"),
            }
        )
        .withColumn("action_set", F.array_sort(F.array_distinct("actions")))
        .withColumns(
            {
                "workflow_signature": signature(F.col("actions"), F.col("contexts")),
                "legacy_signature": legacy_signature(F.col("actions")),
                "descriptor": F.md5(
                    F.concat_ws(
                        "\u0002",
                        F.array_join("tokens", "\u0001"),
                        F.array_join("contexts", "\u0001"),
                        F.col("start_minute").cast("string"),
                    )
                ),
            }
        )
        .withColumn("short_form_signature", short_form_signature(F.col("workflow_signature")))
        .drop("runs")
    )


def eligible(described: DataFrame, options: ClusterOptions) -> DataFrame:
    """Duration and length limits."""
    kept = described.filter(
        (F.col("duration_seconds") >= options.min_duration_seconds) & (F.size("actions") > 0)
    )
    if options.max_duration_seconds is not None:
        kept = kept.filter(F.col("duration_seconds") <= options.max_duration_seconds)
    if options.max_actions is not None:
        kept = kept.filter(F.size("actions") <= options.max_actions)
    return kept


def is_short_form(options: ShortFormOptions = ShortFormOptions()) -> Column:
    """F11."""
    meaningful = F.filter(
        "actions", lambda a: (a != "unknown_action") & ~a.startswith("switch_to_")
    )
    raw_seconds = (F.unix_millis("end_ts") - F.unix_millis("start_ts")) / F.lit(1000)
    return (
        raw_seconds.between(0, options.max_duration_seconds)
        & F.size("actions").between(1, options.max_actions)
        & (F.size(meaningful) >= options.min_meaningful)
    )


# --- cluster facts ----------------------------------------------------------------


def confirmed_clusters(members: DataFrame, options: ClusterOptions) -> DataFrame:
    """Clusters with enough members within the confirmation window.

    Time is cut into buckets as wide as the window. A bucket's first N members decide
    alone if there are N of them; otherwise it has fewer, so a window, which spans at most
    two buckets, is looked at whole.
    """
    width = options.confirmation_days * 86_400_000
    n = options.min_frequency
    ms = F.unix_millis("start_ts")
    per_bucket = Window.partitionBy(*CLUSTER, "bucket").orderBy("at", "session_seq")
    few = (
        members.select(*CLUSTER, "session_seq", ms.alias("at"))
        .withColumn("bucket", F.floor(F.col("at") / width).cast("long"))
        .withColumn("_n", F.row_number().over(per_bucket))
        .filter(F.col("_n") <= n)
        .withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    )
    reach = F.lead("at", n - 1).over(per_bucket) if n > 1 else F.col("at")
    return (
        few.withColumn("_reach", reach)
        .filter(F.col("_reach") - F.col("at") <= width)
        .select(*CLUSTER)
        .distinct()
    )


def sequence_variants(members: DataFrame, keys=tuple(CLUSTER)) -> DataFrame:
    """Distinct action sequences per cluster, ranked."""
    first = F.struct("start_time", "start_order")
    variants = members.groupBy(*keys, "actions").agg(
        F.count("*").alias("occurrence_count"),
        F.sum(F.round(F.col("duration_seconds") * 1000).cast("long")).alias("_ms"),
        F.min(first).alias("first"),
        F.min_by("session_seq", first).alias("first_session"),
    )
    variants = variants.withColumn(
        "average_duration_seconds", F.col("_ms") / F.lit(1000) / F.col("occurrence_count")
    ).drop("_ms")
    rank = Window.partitionBy(*keys).orderBy(
        F.desc("occurrence_count"), F.desc("average_duration_seconds"), F.asc("first")
    )
    return variants.withColumn("rank", F.row_number().over(rank))


def workflow_name(sequence: Column, applications: Column) -> Column:
    """G17."""
    telling = F.filter(
        sequence,
        lambda a: (a != "unknown_action") & ~a.startswith("open_") & ~a.startswith("switch_to_"),
    )
    action = humanize(F.coalesce(F.get(telling, 0), F.get(sequence, 0)))
    return F.when(has_text(action), F.concat(action, F.lit(" workflow"))).otherwise(
        F.concat(F.coalesce(humanize(F.get(applications, 0)), F.lit("Workflow")), F.lit(" flow"))
    )


def suitability_score(size, similarity, browser_share, average_steps, applications) -> Column:
    """Points behind the suitability grade."""
    return (
        F.when(size >= 5, 2).when(size >= 3, 1).otherwise(0)
        + F.when(similarity >= 0.9, 2).when(similarity >= 0.75, 1).otherwise(0)
        + F.when(browser_share >= 0.7, 1).otherwise(0)
        + F.when(average_steps <= 8, 1).otherwise(0)
        - F.when(applications > 3, 1).otherwise(0)
    )


def suitability_grade(points: Column) -> Column:
    return (
        F.when(points >= 4, F.lit("high")).when(points >= 2, F.lit("medium")).otherwise(F.lit("low"))
    )


def general_approach(grade: Column, browser_share: Column, applications: Column) -> Column:
    return (
        F.when(grade == "low", F.lit("Manual review before automation"))
        .when(browser_share >= 0.75, F.lit("Browser automation"))
        .when(
            F.array_contains(applications, "chrome"),
            F.lit("Hybrid desktop and browser automation"),
        )
        .otherwise(F.lit("Desktop workflow automation"))
    )


def automation_hints(
    applications: Column, sequence: Column, grade: Column, approach: Column, weekly: Column
) -> Column:
    """Up to three suggestions, most specific first (G19). Texts are fixed values."""
    browser_only = (F.size(applications) > 0) & F.forall(
        applications, lambda a: a.isin(V.BROWSERS)
    )
    structured = F.exists(sequence, lambda a: a.rlike(V.STRUCTURED_UPDATE_PATTERN))
    excel, slack, outlook = (
        F.array_contains(applications, a) for a in ("excel", "slack", "outlook")
    )

    def level(easy: Column) -> Column:
        return F.when(easy, F.lit("low")).otherwise(F.lit("medium"))

    medium = F.lit("medium")

    def hint(name, why: str, difficulty: Column, needs: list[str], factor: float = 1.0) -> Column:
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("suggested_approach"),
            F.lit(why).alias("why_this_fits"),
            difficulty.alias("estimated_difficulty"),
            F.array(*[F.lit(n) for n in needs]).alias("prerequisites"),
            savings_text(weekly * F.lit(factor)).alias("expected_time_savings"),
        )

    specific = F.array_compact(
        F.array(
            F.when(browser_only, hint(
                "Playwright",
                "The workflow is mostly browser-based and the step sequence is stable enough for scripted navigation.",
                level(~structured),
                ["Stable page selectors or URLs", "A safe test account for the target workflow"],
            )),
            F.when(browser_only & structured, hint(
                "Internal admin API integration",
                "This workflow repeatedly updates structured records, which is often safer and faster through APIs than UI clicks.",
                medium,
                ["Access to the internal API", "Documented request/response contracts"],
                1.1,
            )),
            F.when(excel, hint(
                "Excel macro",
                "A meaningful part of the workflow happens in spreadsheets, so a macro can remove repetitive edits and saves.",
                level(~(slack | browser_only)),
                ["The workbook structure should be stable", "Known input and output columns"],
                0.8,
            )),
            F.when(slack, hint(
                "n8n workflow",
                "Slack notifications and follow-up steps map well to an orchestration tool that can coordinate multiple apps.",
                medium,
                ["Slack app or webhook access", "A trigger or polling source for the upstream step"],
                0.7,
            )),
            F.when(outlook, hint(
                "PowerShell",
                "Desktop email and office tooling often fit well with a small script that automates repetitive message handling.",
                medium,
                ["Local execution permissions", "A documented mail or file handling flow"],
                0.7,
            )),
        )
    )
    general = hint(
        F.when(approach == "Browser automation", F.lit("Playwright")).otherwise(
            F.lit("Python script")
        ),
        "The workflow is repetitive enough to justify a scripted MVP even before deeper integrations are available.",
        level(grade == "high"),
        ["A reproducible input/output example", "A safe place to test the automation"],
    )
    return F.when(F.size(specific) > 0, F.slice(specific, 1, 3)).otherwise(F.array(general))


def step_texts(steps: Column) -> Column:
    """Readable, run-compacted steps of a session."""

    def context(s: Column) -> Column:
        title, app = humanize(s["title_pattern"]), humanize(s["application"])
        same = F.lower(F.trim(title)) == F.coalesce(F.lower(F.trim(app)), F.lit(""))
        return F.when(has_text(title) & ~same, title).otherwise(
            F.nullif(humanize(s["domain"]), F.lit(""))
        )

    def shown(s: Column) -> Column:
        app = F.nullif(humanize(s["application"]), F.lit(""))
        named = s["action_name"] != F.concat(F.lit("switch_to_"), s["application"])
        where = context(s)
        return F.struct(
            F.concat_ws(
                "|", s["application"], s["action_name"], F.coalesce(where, F.lit(""))
            ).alias("token"),
            F.concat_ws(
                " ",
                F.coalesce(F.nullif(humanize(s["action_name"]), F.lit("")), s["action_name"]),
                F.when(named, F.concat(F.lit("in "), app)),
                F.concat(F.lit("("), where, F.lit(")")),
            ).alias("text"),
        )

    texts = F.transform(steps, shown)
    kept = F.filter(texts, lambda t, i: (i == 0) | (t["token"] != F.get(texts, i - 1)["token"]))
    return F.transform(kept, lambda t: t["text"])


def representative_steps(assigned: DataFrame, chosen: DataFrame) -> DataFrame:
    """Step texts of the chosen sessions (stream_id, session_seq)."""
    return (
        assigned.filter("detail_start")
        .select(*SESSION, "ord", "application", "action_name", "title_pattern", "domain")
        .join(chosen.select(*SESSION), SESSION, "left_semi")
        .groupBy(*SESSION)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("ord", "application", "action_name", "title_pattern", "domain")
                )
            ).alias("steps")
        )
        .select(*SESSION, step_texts(F.col("steps")).alias("representative_steps"))
    )


def cluster_similarity(members: DataFrame, chosen: DataFrame, options: ClusterOptions) -> DataFrame:
    """Mean similarity of members to the representative (G15), once per descriptor."""
    facts = ["tokens", "action_set", "contexts", "start_minute"]
    distinct = members.groupBy(*CLUSTER, "descriptor").agg(
        F.count("*").alias("n"), *[F.first(f).alias(f) for f in facts]
    )
    named = chosen.select(*CLUSTER, *[F.col(f).alias(f"rep_{f}") for f in facts])
    pairs = distinct.join(named, CLUSTER)
    parts = similarity_parts("rep_", "", options.strategy)
    scored = pairs.select(*CLUSTER, "n", *[c.alias(k) for k, c in parts.items()])
    columns = {k: F.col(k) for k in parts}
    total = composite(columns, options.similarity_weights, options.strategy)
    n = F.col("n")
    return (
        scored.withColumn("composite", total)
        .groupBy(*CLUSTER)
        .agg(
            *[
                (F.sum(F.col(k) * n) / F.sum(n)).alias(f"mean_{k}")
                for k in ("sequence", "action_set", "context", "time_of_day", "composite")
            ]
        )
    )


# What is looked at of a confirmed member; the rest of a session stays where it is.
MEMBER_FACTS = [
    *CLUSTER, "session_seq", "start_time", "start_order", "duration_seconds", "applications", "descriptor", "tokens",
    "actions", "action_set", "contexts", "start_minute", "workflow_signature", "short_form_signature",
]


def summarize_clusters(
    members: DataFrame, assigned: DataFrame, options: ClusterOptions
) -> DataFrame:
    """One row per confirmed workflow."""
    confirmed = materialize(
        members.join(confirmed_clusters(members, options), CLUSTER, "left_semi").select(*MEMBER_FACTS), "members"
    )
    browser = F.filter("applications", lambda a: a.isin(V.BROWSERS))
    sizes = confirmed.groupBy(*CLUSTER).agg(
        F.count("*").alias("frequency"),
        F.sum(F.round(F.col("duration_seconds") * 1000).cast("long")).alias("_ms"),
        F.sum(F.size("actions")).alias("_steps"),
        F.sum(F.size("applications")).alias("_apps"),
        F.sum(F.size(browser)).alias("_browser"),
        F.min(F.struct("start_time", "start_order")).alias("first_member"),
    )
    place = F.struct("start_time", "start_order", F.col("place"))
    apps = (
        confirmed.select(*CLUSTER, "start_time", "start_order", F.posexplode("applications").alias("place", "app"))
        .groupBy(*CLUSTER, "app")
        .agg(F.min(place).alias("seen"))
        .groupBy(*CLUSTER)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seen", "app"))), lambda s: s["app"]
            ).alias("involved_apps")
        )
    )
    ranked = sequence_variants(confirmed).filter(F.col("rank") <= 3)
    variants = ranked.groupBy(*CLUSTER).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank",
                        F.col("actions").alias("sequence"),
                        "occurrence_count",
                        "average_duration_seconds",
                    )
                )
            ),
            lambda v: F.struct(v["sequence"], v["occurrence_count"], v["average_duration_seconds"]),
        ).alias("top_variants"),
        F.min_by("first_session", "rank").alias("session_seq"),
    )
    chosen = materialize(
        variants.join(
            confirmed.select(
                *SESSION, "tokens", "actions", "action_set", "contexts", "start_minute",
                "workflow_signature", "short_form_signature",
            ),
            SESSION,
        ),
        "representatives",
    )
    texts = representative_steps(assigned, chosen)
    likeness = cluster_similarity(confirmed, chosen, options)
    joined = (
        sizes.join(apps, CLUSTER)
        .join(chosen.join(texts, SESSION), CLUSTER)
        .join(likeness, CLUSTER)
    )
    size = F.col("frequency")
    seconds = F.col("_ms") / F.lit(1000)
    cw = options.confidence_weights.normalized()
    sw = options.similarity_weights.normalized()
    concentration = F.get("top_variants", 0)["occurrence_count"] / F.greatest(F.lit(1), size)
    repetition = F.least(F.lit(1.0), size / F.lit(5))
    confidence = (
        F.col("mean_composite") * F.lit(cw.composite)
        + concentration * F.lit(cw.top_variant)
        + repetition * F.lit(cw.repetition)
    )

    def fixed(value: float) -> Column:
        return round_score(F.lit(value))

    details = F.struct(
        F.struct(
            fixed(sw.sequence).alias("sequence"),
            fixed(sw.action_set).alias("action_set"),
            fixed(sw.context).alias("context"),
            fixed(sw.time_of_day).alias("time_of_day"),
        ).alias("similarity_weights"),
        F.struct(
            fixed(cw.composite).alias("composite"),
            fixed(cw.top_variant).alias("top_variant"),
            fixed(cw.repetition).alias("repetition"),
        ).alias("confidence_weights"),
        *[
            round_score(F.col(f"mean_{k}")).alias(f"average_{k}_similarity")
            for k in ("sequence", "action_set", "context", "time_of_day", "composite")
        ],
        round_score(concentration).alias("top_variant_concentration"),
        round_score(repetition).alias("repetition_score"),
    )
    share = F.coalesce(F.try_divide("_browser", "_apps"), F.lit(0.0))
    mode = options.detection_mode
    sign = F.col("workflow_signature" if mode == "standard" else "short_form_signature")
    graded = (
        joined.withColumn("confidence_details", details)
        .withColumns(
            {
                "confidence_score": round_score(confidence),
                "automation_suitability": suitability_grade(
                    suitability_score(
                        size,
                        F.col("confidence_details")["average_composite_similarity"],
                        share,
                        F.col("_steps") / size,
                        F.size("involved_apps"),
                    )
                ),
            }
        )
        .withColumn(
            "_approach",
            general_approach(F.col("automation_suitability"), share, F.col("involved_apps")),
        )
        .withColumn(
            "automation_hints",
            automation_hints(
                F.col("involved_apps"),
                F.col("actions"),
                F.col("automation_suitability"),
                F.col("_approach"),
                seconds * 0.6,
            ),
        )
    )
    return graded.select(
        *CLUSTER,
        stable_id("workflow_cluster", sign).alias("cluster_id"),
        sign.alias("workflow_signature"),
        F.lit(mode).alias("detection_mode"),
        workflow_name(F.col("actions"), F.col("involved_apps")).alias("name"),
        size.alias("occurrence_count"),
        "frequency",
        (seconds / size).alias("average_duration_seconds"),
        seconds.alias("total_duration_seconds"),
        F.col("actions").alias("representative_sequence"),
        F.col("session_seq").alias("representative_session_seq"),
        "representative_steps",
        "involved_apps",
        "confidence_score",
        "confidence_details",
        "top_variants",
        "automation_suitability",
        F.get("automation_hints", 0)["suggested_approach"].alias("recommended_approach"),
        "automation_hints",
        "first_member",
    )


def cluster_lane(described: DataFrame, assigned: DataFrame, options: ClusterOptions):
    """(clusters, bridge): workflows of one lane and the sessions they consist of.

    Only the cluster of each session is written; ``described`` is read again for the members' facts.
    """
    members = assign_clusters(eligible(described, options), options)
    clusters = materialize(summarize_clusters(members, assigned, options), "clusters")
    bridge = members.join(clusters.select(*CLUSTER), CLUSTER, "left_semi").select(
        *CLUSTER, "session_seq", "session_id", F.lit(options.detection_mode).alias("detection_mode")
    )
    return clusters, bridge
