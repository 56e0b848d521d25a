"""Privacy-safe workflow summaries and external labels (K1-K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from .clusters import CLUSTER
from .feedback import record_feedback
from .report import latest_labels, visible
from .sessions import SESSION

GRADES = ["high", "medium", "low"]
LABEL_FIELDS = ["workflow_name", "workflow_summary", "automation_suitability",
                "recommended_approach", "rationale"]
LABEL_SCHEMA = ", ".join(f"{f} STRING" for f in LABEL_FIELDS) + ", _corrupt_record STRING"


def payload_candidates(
    clusters: DataFrame, include_excluded=False, include_hidden=False, include_short_form=False
) -> DataFrame:
    """K1."""
    kept = visible(clusters, include_excluded, include_hidden)
    return kept if include_short_form else kept.filter(F.col("detection_mode") != "short_form")


def payload_records(clusters: DataFrame, bridge: DataFrame, sessions: DataFrame) -> DataFrame:
    """Steps, frequency, duration, applications and domains per workflow (K2).

    Names are unique per session already, so what is gathered per workflow is distinct
    names, first seen first.
    """
    members = bridge.drop("session_id").join(
        sessions.select(*SESSION, "start_order", "applications", "domains"), SESSION
    )
    mode = [*CLUSTER, "detection_mode"]

    def names(column: str) -> DataFrame:
        return (
            members.select(*mode, "start_order", F.posexplode(column).alias("place", "value"))
            .filter(has_text(F.col("value")))
            .groupBy(*mode, "value")
            .agg(F.min(F.struct("start_order", "place")).alias("seen"))
            .groupBy(*mode)
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("seen", "value"))), lambda s: s["value"]
                ).alias(f"all_{column}")
            )
        )

    joined = clusters.join(names("applications"), mode, "left").join(names("domains"), mode, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "stream_id",
        "cluster_id",
        F.col("name").alias("workflow_name"),
        "detection_mode",
        F.struct(
            F.col("representative_steps").alias("workflow_steps"),
            "frequency",
            "average_duration_seconds",
            F.coalesce("all_applications", none).alias("applications"),
            F.coalesce("all_domains", none).alias("domains"),
        ).alias("payload"),
    )


def preparation_summary(clusters: DataFrame, entries: DataFrame, include_short_form=False) -> DataFrame:
    """How many reported workflows would be sent, and how many short forms are left out (K3)."""
    keys = ["stream_id", "cluster_id"]
    shown = clusters.join(entries.select(*keys), keys, "left_semi")
    short = F.col("detection_mode") == "short_form"
    left_out = F.lit(0).cast("long") if include_short_form else F.count(F.when(short, 1))
    return shown.agg(
        F.count("*").alias("workflow_count"),
        left_out.alias("short_form_excluded_count"),
        (F.count("*") - left_out).alias("payload_count"),
    )


def parse_labels(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, rejected) from returned JSON texts (K4).

    ``answers``: cluster_id, provider, model, answer, created_at.
    """
    parsed = answers.withColumn("_a", F.from_json("answer", LABEL_SCHEMA))
    a = F.col("_a")
    complete = F.lit(True)
    for f in LABEL_FIELDS:
        complete = complete & has_text(a[f])
    good = complete & a["automation_suitability"].isin(GRADES)
    labels = parsed.filter(good).select(
        F.col("cluster_id").alias("workflow_cluster_id"),
        "provider",
        "model",
        *[a[f].alias(f) for f in LABEL_FIELDS],
        "created_at",
    )
    return labels, parsed.filter(~F.coalesce(good, F.lit(False))).drop("_a")


def list_labels(labels: DataFrame) -> DataFrame:
    return labels.orderBy(F.desc("created_at"), "workflow_cluster_id")


def overlay_names(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Suggested names beside baseline and feedback names (K5). ``clusters`` carry feedback."""
    newest = latest_labels(labels).select(
        F.col("workflow_cluster_id").alias("cluster_id"), F.col("workflow_name").alias("suggested_name")
    )
    joined = clusters.join(newest, "cluster_id", "left")
    source = (
        F.when(F.col("name") == F.col("baseline_name"), F.lit("baseline"))
        .when(F.col("name") == F.col("suggested_name"), F.lit("llm_overlay"))
        .otherwise(F.lit("feedback"))
    )
    return joined.withColumn("workflow_name_source", source)


def labels_as_feedback(labels: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write suggested names back as rename feedback (K5)."""
    entries = labels.select(
        F.sha1(F.concat_ws(":", F.lit("feedback"), "workflow_cluster_id", "created_at")).alias("id"),
        "workflow_cluster_id",
        F.col("workflow_name").alias("rename_to"),
        *[F.lit(None).cast("string").alias(c) for c in (
            "business_purpose", "automation_difficulty", "merge_into_workflow_id", "split_after_action_name")],
        *[F.lit(None).cast("boolean").alias(c) for c in (
            "excluded", "hidden", "repetitive", "automation_candidate", "approved_automation_candidate")],
        "created_at",
    )
    return record_feedback(entries, clusters)
