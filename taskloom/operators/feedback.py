"""Reviewer feedback: folding the log, applying it, merging workflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, stable_id
from ..schema import FEEDBACK_FIELDS


def latest_values() -> list[Column]:
    """The latest non-null value of every field."""
    return [
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct("created_at", "id"))).alias(f)
        for f in FEEDBACK_FIELDS
    ]


def fold_feedback(log: DataFrame) -> DataFrame:
    """(key, feedback): the folded log, reachable by signature and by cluster id (H1)."""
    summary = F.struct(*FEEDBACK_FIELDS)
    by_signature = log.groupBy("workflow_signature").agg(*latest_values())
    by_signature = by_signature.select(
        F.col("workflow_signature").alias("key"), summary.alias("feedback")
    )
    # An id shows the summary of the signature it was last recorded under.
    owners = log.groupBy(F.col("workflow_cluster_id").alias("id")).agg(
        F.max_by("workflow_signature", F.struct("created_at", "id")).alias("key")
    )
    by_id = owners.join(by_signature, "key").select(F.col("id").alias("key"), "feedback")
    return by_signature.unionByName(
        by_id.join(by_signature.select("key"), "key", "left_anti")
    )


def resolve_feedback(rows: DataFrame, folded: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``feedback`` by the first of ``keys`` that has any (H4)."""
    out = rows
    for i, key in enumerate(keys):
        side = folded.select(F.col("key").alias(key), F.col("feedback").alias(f"_f{i}"))
        out = out.join(side, key, "left")
    found = F.coalesce(*[F.col(f"_f{i}") for i in range(len(keys))])
    return out.withColumn("feedback", found).drop(*[f"_f{i}" for i in range(len(keys))])


def user_labelled(feedback: Column) -> Column:
    """Truth of the *first* field that is set, whatever the later ones say."""
    texts = {"rename_to", "business_purpose", "automation_difficulty",
             "merge_into_workflow_id", "merge_into_workflow_signature",
             "split_after_action_name"}
    truths = [
        (feedback[f] != "") if f in texts else feedback[f] for f in FEEDBACK_FIELDS
    ]
    return F.coalesce(*truths, F.lit(False))


def apply_feedback(clusters: DataFrame, folded: DataFrame) -> DataFrame:
    """Overlay names, flags and decisions on clusters; the id wins over the signature (H3)."""
    known = resolve_feedback(clusters, folded, ["cluster_id", "workflow_signature"])
    f = F.col("feedback")
    flags = ["excluded", "hidden"]
    values = {"name": F.coalesce(f["rename_to"], F.col("name"))}
    values |= {x: F.coalesce(f[x], F.lit(False)) for x in flags}
    values |= {x: f[x] for x in FEEDBACK_FIELDS if x not in flags and x != "rename_to"}
    values["user_labeled"] = user_labelled(f)
    return known.withColumn("baseline_name", F.col("name")).withColumns(values).drop("feedback")


def record_feedback(entries: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) feedback entries, signatures resolved (H2)."""
    known = clusters.select("cluster_id", "workflow_signature").dropDuplicates(["cluster_id"])
    target = known.select(
        F.col("cluster_id").alias("merge_into_workflow_id"),
        F.col("workflow_signature").alias("merge_into_workflow_signature"),
    )
    given = [f for f in FEEDBACK_FIELDS if f != "merge_into_workflow_signature"]
    some = F.coalesce(*[F.when(F.col(f).isNotNull(), F.lit(True)) for f in given], F.lit(False))
    checked = (
        entries.drop("workflow_signature", "merge_into_workflow_signature")
        .join(known.withColumnRenamed("cluster_id", "workflow_cluster_id"), "workflow_cluster_id", "left")
        .join(target, "merge_into_workflow_id", "left")
        .withColumn(
            "error",
            F.when(~some, F.lit("at least one field is required"))
            .when(F.col("workflow_signature").isNull(), F.lit("workflow not found"))
            .when(
                has_text(F.col("merge_into_workflow_id"))
                & F.col("merge_into_workflow_signature").isNull(),
                F.lit("merge target not found"),
            ),
        )
    )
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def merge_clusters(
    clusters: DataFrame, bridge: DataFrame, folded: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Unite clusters that feedback sends to one target, per detection mode."""
    legacy = stable_id("workflow_signature", F.array_join("representative_sequence", ">"))
    resolved = resolve_feedback(
        clusters.withColumn("_legacy", legacy), folded, ["workflow_signature", "_legacy"]
    )
    placed = resolved.withColumn(
        "target",
        F.coalesce(F.col("feedback")["merge_into_workflow_signature"], F.col("workflow_signature")),
    ).drop("feedback", "_legacy")
    group = ["stream_id", "detection_mode", "target"]
    order = F.struct("detection_mode", -F.col("frequency"), -F.col("confidence_score"),
                     -F.col("total_duration_seconds"), "first_member")
    n = F.col("occurrence_count")

    def weighted(c: Column) -> Column:
        return F.sum(c * n) / F.greatest(F.lit(1), F.sum(n))

    d = F.col("confidence_details")
    scores = [
        "average_sequence_similarity", "average_action_set_similarity",
        "average_context_similarity", "average_time_of_day_similarity",
        "average_composite_similarity", "top_variant_concentration", "repetition_score",
    ]
    best = F.struct(-n, -F.col("confidence_score"), order)
    kept = [
        "cluster_seq", "name", "representative_sequence", "representative_session_seq",
        "representative_steps", "automation_suitability", "recommended_approach",
        "automation_hints", "confidence_details", "first_member",
    ]
    totals = placed.groupBy(*group).agg(
        F.count("*").alias("parts"),
        F.sum("occurrence_count").alias("occurrence_count"),
        F.sum("frequency").alias("frequency"),
        F.sum("total_duration_seconds").alias("total_duration_seconds"),
        F.first("average_duration_seconds").alias("_average"),
        F.first("confidence_score").alias("_confidence"),
        weighted(F.col("confidence_score")).alias("_weighted"),
        F.min_by(F.struct(*kept), best).alias("r"),
        *[weighted(d[s]).alias(f"_{s}") for s in scores],
    )
    single = F.col("parts") == 1
    rd = F.col("r")["confidence_details"]
    details = F.when(single, rd).otherwise(
        F.struct(
            rd["similarity_weights"].alias("similarity_weights"),
            rd["confidence_weights"].alias("confidence_weights"),
            *[F.col(f"_{s}").alias(s) for s in scores],
        )
    )
    apps = _united(placed, group, order, "involved_apps")
    variants = _merged_variants(placed, group, order)
    merged = (
        totals.join(apps, group)
        .join(variants, group)
        .select(
            "stream_id",
            F.col("r")["cluster_seq"].alias("cluster_seq"),
            stable_id("workflow_cluster", F.col("target")).alias("cluster_id"),
            F.col("target").alias("workflow_signature"),
            "detection_mode",
            F.col("r")["name"].alias("name"),
            "occurrence_count",
            "frequency",
            F.when(single, F.col("_average"))
            .otherwise(F.coalesce(F.try_divide("total_duration_seconds", "occurrence_count"), F.lit(0.0)))
            .alias("average_duration_seconds"),
            "total_duration_seconds",
            F.col("r")["representative_sequence"].alias("representative_sequence"),
            F.col("r")["representative_session_seq"].alias("representative_session_seq"),
            F.col("r")["representative_steps"].alias("representative_steps"),
            "involved_apps",
            F.when(single, F.col("_confidence")).otherwise(F.col("_weighted")).alias("confidence_score"),
            details.alias("confidence_details"),
            "top_variants",
            F.col("r")["automation_suitability"].alias("automation_suitability"),
            F.col("r")["recommended_approach"].alias("recommended_approach"),
            F.col("r")["automation_hints"].alias("automation_hints"),
            F.col("r")["first_member"].alias("first_member"),
        )
    )
    moved = placed.select("stream_id", "detection_mode", "cluster_seq", "target").join(
        merged.select("stream_id", "detection_mode", F.col("workflow_signature").alias("target"),
                      F.col("cluster_seq").alias("new_seq")),
        group,
    )
    new_bridge = (
        bridge.join(moved.drop("target"), ["stream_id", "detection_mode", "cluster_seq"])
        .drop("cluster_seq")
        .withColumnRenamed("new_seq", "cluster_seq")
        .dropDuplicates(["stream_id", "detection_mode", "cluster_seq", "session_seq"])
    )
    return merged, new_bridge


def _united(placed: DataFrame, group: list[str], order: Column, column: str) -> DataFrame:
    seen = placed.select(*group, order.alias("o"), F.posexplode(column).alias("p", "v"))
    return (
        seen.groupBy(*group, "v")
        .agg(F.min(F.struct("o", "p")).alias("at"))
        .groupBy(*group)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]
            ).alias(column)
        )
    )


def _merged_variants(placed: DataFrame, group: list[str], order: Column) -> DataFrame:
    one = placed.select(*group, order.alias("o"), F.posexplode("top_variants").alias("p", "v"))
    v = F.col("v")
    summed = one.groupBy(*group, v["sequence"].alias("sequence")).agg(
        F.sum(v["occurrence_count"]).alias("occurrence_count"),
        F.sum(v["average_duration_seconds"] * v["occurrence_count"]).alias("_total"),
        F.min(F.struct("o", "p")).alias("at"),
    )
    average = F.coalesce(F.try_divide("_total", "occurrence_count"), F.lit(0.0))
    ranked = summed.withColumn("average_duration_seconds", average).withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy(*group).orderBy(
                F.desc("occurrence_count"), F.desc("average_duration_seconds"), "at"
            )
        ),
    )
    entry = F.struct("rank", "sequence", "occurrence_count", "average_duration_seconds")
    return (
        ranked.filter("rank <= 3")
        .groupBy(*group)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(entry)),
                lambda e: F.struct(e["sequence"], e["occurrence_count"], e["average_duration_seconds"]),
            ).alias("top_variants")
        )
    )


def affected_workflows(
    before: DataFrame,
    before_events: DataFrame,
    after: DataFrame,
    after_events: DataFrame,
    reviews: DataFrame,
) -> DataFrame:
    """Workflows a review touches, per reviewed workflow (H5).

    ``*_events`` are (cluster_id, normalized_event_id); ``reviews`` holds
    workflow_cluster_id, merge_into_workflow_id and split_after_action_name.
    """
    source = reviews.join(
        before.select(
            F.col("cluster_id").alias("workflow_cluster_id"),
            F.col("workflow_signature").alias("source_signature"),
            F.col("representative_sequence").alias("source_sequence"),
        ),
        "workflow_cluster_id",
    )
    by_id = source.select(
        "workflow_cluster_id",
        F.explode(F.array_compact(F.array("workflow_cluster_id", "merge_into_workflow_id"))).alias("cluster_id"),
    ).join(after.select("cluster_id"), "cluster_id", "left_semi")
    by_signature = source.join(
        after.select("cluster_id", F.col("workflow_signature").alias("source_signature")),
        "source_signature",
    ).select("workflow_cluster_id", "cluster_id")
    at = F.array_position("source_sequence", F.col("split_after_action_name"))
    pieces = F.filter(
        F.array(
            F.slice("source_sequence", F.lit(1), at.cast("int")),
            F.slice("source_sequence", (at + 1).cast("int"), F.size("source_sequence")),
        ),
        lambda p: F.size(p) > 0,
    )
    by_piece = (
        source.filter(at > 0)
        .select("workflow_cluster_id", F.explode(pieces).alias("representative_sequence"))
        .join(after.select("cluster_id", "representative_sequence"), "representative_sequence")
        .select("workflow_cluster_id", "cluster_id")
    )
    by_event = (
        source.select("workflow_cluster_id")
        .join(before_events.withColumnRenamed("cluster_id", "workflow_cluster_id"), "workflow_cluster_id")
        .join(after_events, "normalized_event_id")
        .select("workflow_cluster_id", "cluster_id")
    )
    touched = by_id.select("workflow_cluster_id", "cluster_id")
    for more in (by_signature, by_piece, by_event):
        touched = touched.unionByName(more)
    return (
        touched.distinct()
        .join(after, "cluster_id")
        .orderBy(F.desc("frequency"), F.desc("total_duration_seconds"), "name")
    )
