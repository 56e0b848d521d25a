"""Record shapes."""

from __future__ import annotations

from pyspark.sql import types as T

ROUTE_TAXONOMY = (
    "STRUCT<source: STRING, signature: STRING, routeTemplate: STRING, depth: DOUBLE, "
    "primarySection: STRING, secondarySection: STRING, leafSection: STRING, "
    "dynamicSegmentCount: DOUBLE>"
)
TAB_ORDER = (
    "STRUCT<globalSequence: DOUBLE, windowSequence: DOUBLE, tabIndex: DOUBLE, "
    "previousTabId: DOUBLE, windowId: DOUBLE>"
)
DWELL = "STRUCT<durationMs: DOUBLE, startedAt: STRING, endedAt: STRING, reason: STRING>"

# The parts of the open metadata bag that have a meaning.
METADATA = (
    "STRUCT<"
    f"browserContext: STRUCT<routeTaxonomy: {ROUTE_TAXONOMY}, documentTypeHash: STRING, "
    f"tabOrder: {TAB_ORDER}, dwell: {DWELL}, signalOnly: BOOLEAN>, "
    "calendarSignal: STRUCT<signalType: STRING, eventIdHash: STRING, summaryHash: STRING, "
    "startAt: STRING, endAt: STRING, attendeesCount: DOUBLE, signalOnly: BOOLEAN>, "
    "workspaceContext: STRUCT<provider: STRING, app: STRING, itemType: STRING, "
    "itemHash: STRING, activityType: STRING, modifiedAt: STRING, viewedAt: STRING, "
    "sheetCount: DOUBLE, gridSheetCount: DOUBLE>, "
    "gitContext: STRUCT<repoHash: STRING, remoteHost: STRING, dirtyFileCount: DOUBLE, "
    "lastCommitAt: STRING>>"
)

# One event as it arrives. Metadata is kept as JSON text.
INCOMING = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("sourceEventType", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("application", T.StringType()),
        T.StructField("windowTitle", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("browserSchemaVersion", T.IntegerType()),
        T.StructField("canonicalUrl", T.StringType()),
        T.StructField("routeTemplate", T.StringType()),
        T.StructField("routeKey", T.StringType()),
        T.StructField("resourceHash", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

RAW_COLUMNS = [
    "id",
    "stream_id",
    "seq",
    "ts",
    "ts_text",
    "source",
    "source_event_type",
    "application",
    "window_title",
    "domain",
    "url",
    "browser_schema_version",
    "canonical_url",
    "route_template",
    "route_key",
    "resource_hash",
    "action",
    "target",
    "metadata",
]

FEEDBACK = (
    "id STRING, workflow_cluster_id STRING, workflow_signature STRING, rename_to STRING, "
    "business_purpose STRING, excluded BOOLEAN, hidden BOOLEAN, repetitive BOOLEAN, "
    "automation_candidate BOOLEAN, automation_difficulty STRING, "
    "approved_automation_candidate BOOLEAN, merge_into_workflow_id STRING, "
    "merge_into_workflow_signature STRING, split_after_action_name STRING, created_at STRING"
)

# Folded fields, in the order in which "was labelled by the user" looks at them.
FEEDBACK_FIELDS = [
    "rename_to",
    "business_purpose",
    "excluded",
    "hidden",
    "repetitive",
    "automation_candidate",
    "automation_difficulty",
    "approved_automation_candidate",
    "merge_into_workflow_id",
    "merge_into_workflow_signature",
    "split_after_action_name",
]
