"""Privacy: redaction, allow-listed contexts and canonical browser fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, canonical_timestamp, iso_utc
from ..functions.urls import canonical_fields
from ..options import UrlOptions
from ..rules.vocabulary import REDACTED, SENSITIVE_PATTERN
from ..schema import METADATA

CONTEXTS = {
    "browser_context": "browserContext",
    "calendar_signal": "calendarSignal",
    "workspace_context": "workspaceContext",
    "git_context": "gitContext",
}
DWELL_REASONS = ["navigation", "route_change", "tab_switch", "tab_closed", "window_blur"]
ITEM_TYPES = ["spreadsheet", "document", "presentation", "pdf", "folder", "file"]
_SENSITIVE = re.compile(SENSITIVE_PATTERN)


def _redact(value):
    if isinstance(value, list):
        return [_redact(v) for v in value]
    if isinstance(value, dict):
        return {
            k: REDACTED if _SENSITIVE.search(k) else _redact(v) for k, v in value.items()
        }
    return value


def _redacted_text(text: str) -> str:
    try:
        value = json.loads(text)
    except ValueError:
        return "{}"
    if not isinstance(value, dict):
        return "{}"
    free = {k: v for k, v in value.items() if k not in CONTEXTS.values()}
    return json.dumps(_redact(free), separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def _redact_json(texts: pd.Series) -> pd.Series:
    return texts.map(_redacted_text, na_action="ignore")


def redact_metadata(metadata: Column) -> Column:
    """Redact values under sensitive keys at any depth; typed contexts are taken out.

    Only texts that could be affected reach Python, the others pass through as NULL.
    """
    suspect = metadata.rlike(SENSITIVE_PATTERN + "|" + "|".join(CONTEXTS.values()))
    cleaned = _redact_json(F.when(suspect, metadata))
    return F.coalesce(cleaned, metadata, F.lit("{}"))


def redact_text(c: Column) -> Column:
    return F.when(c.rlike(SENSITIVE_PATTERN), F.lit(REDACTED)).otherwise(c)


def _one_of(c: Column, values) -> Column:
    text = blank_to_null(c)
    return F.when(text.isin(values), text)


def _matching(c: Column, pattern: str) -> Column:
    text = blank_to_null(c)
    return F.when(text.rlike(pattern), text)


def _hash(c: Column) -> Column:
    return _matching(F.lower(c), "^[0-9a-f]{8,64}$")


def _count(c: Column) -> Column:
    return F.when((c >= 0) & (c == F.floor(c)), c.cast("long"))


def _instant(c: Column) -> Column:
    return iso_utc(F.try_to_timestamp(blank_to_null(c)))


def _any_present(fields: dict[str, Column]) -> Column:
    """A struct of the fields, or NULL if all of them are NULL."""

    def checked(row: Column) -> Column:
        some = F.lit(False)
        for name in fields:
            some = some | row[name].isNotNull()
        return F.when(some, row)

    row = F.struct(*[c.alias(name) for name, c in fields.items()])
    # The one-element array names the row, so each field is worked out once.
    return F.get(F.transform(F.array(row), checked), 0)


def clean_browser_context(c: Column) -> Column:
    route, tab, dwell = c["routeTaxonomy"], c["tabOrder"], c["dwell"]
    section = "^[a-z0-9_{}-]{1,64}$"
    duration = dwell["durationMs"]
    return _any_present(
        {
            "routeTaxonomy": _any_present(
                {
                    "source": _one_of(route["source"], ["pathname", "hash"]),
                    "signature": _matching(
                        route["signature"], r"^(?:pathname|hash):/[a-z0-9_/{}-]*$"
                    ),
                    "routeTemplate": _matching(route["routeTemplate"], r"^/[a-z0-9_/{}-]*$"),
                    "depth": _count(route["depth"]),
                    "primarySection": _matching(route["primarySection"], section),
                    "secondarySection": _matching(route["secondarySection"], section),
                    "leafSection": _matching(route["leafSection"], section),
                    "dynamicSegmentCount": _count(route["dynamicSegmentCount"]),
                }
            ),
            "documentTypeHash": _hash(c["documentTypeHash"]),
            "tabOrder": _any_present(
                {
                    name: _count(tab[name])
                    for name in (
                        "globalSequence",
                        "windowSequence",
                        "tabIndex",
                        "previousTabId",
                        "windowId",
                    )
                }
            ),
            "dwell": _any_present(
                {
                    "durationMs": F.when(
                        duration >= 0, F.floor(duration + 0.5).cast("long")
                    ),
                    "startedAt": _instant(dwell["startedAt"]),
                    "endedAt": _instant(dwell["endedAt"]),
                    "reason": _one_of(dwell["reason"], DWELL_REASONS),
                }
            ),
            "signalOnly": F.when(c["signalOnly"], F.lit(True)),
        }
    )


def clean_calendar_signal(c: Column) -> Column:
    kind = _one_of(c["signalType"], ["meeting_start", "meeting_end"])

    def stated(field: str) -> Column:
        text = blank_to_null(c[field])
        return F.when(F.try_to_timestamp(text).isNotNull(), text)

    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("signalType"),
            _hash(c["eventIdHash"]).alias("eventIdHash"),
            _hash(c["summaryHash"]).alias("summaryHash"),
            stated("startAt").alias("startAt"),
            stated("endAt").alias("endAt"),
            _count(c["attendeesCount"]).alias("attendeesCount"),
            F.when(c["signalOnly"], F.lit(True)).alias("signalOnly"),
        ),
    )


def clean_workspace_context(c: Column) -> Column:
    return _any_present(
        {
            "provider": blank_to_null(c["provider"]),
            "app": _one_of(c["app"], ["drive", "sheets"]),
            "itemType": _one_of(c["itemType"], ITEM_TYPES),
            "itemHash": _hash(c["itemHash"]),
            "activityType": _one_of(c["activityType"], ["modified", "viewed"]),
            "modifiedAt": _instant(c["modifiedAt"]),
            "viewedAt": _instant(c["viewedAt"]),
            "sheetCount": _count(c["sheetCount"]),
            "gridSheetCount": _count(c["gridSheetCount"]),
        }
    )


def clean_git_context(c: Column) -> Column:
    return _any_present(
        {
            "repoHash": _hash(c["repoHash"]),
            "remoteHost": _matching(F.lower(c["remoteHost"]), "^[a-z0-9.-]{1,128}$"),
            "dirtyFileCount": _count(c["dirtyFileCount"]),
            "lastCommitAt": _instant(c["lastCommitAt"]),
        }
    )


_CLEANERS = {
    "browser_context": clean_browser_context,
    "calendar_signal": clean_calendar_signal,
    "workspace_context": clean_workspace_context,
    "git_context": clean_git_context,
}


def with_contexts(events: DataFrame, recheck: bool = False) -> DataFrame:
    """Typed, allow-listed contexts. Rows of a sanitised table already carry them."""
    stored = set(CONTEXTS) <= set(events.columns)
    if stored and not recheck:
        return events
    if stored:
        parsed, source = events, {name: F.col(name) for name in CONTEXTS}
    else:
        present = F.col("metadata").rlike("|".join(CONTEXTS.values()))
        parsed = events.withColumn(
            "_meta", F.when(present, F.from_json("metadata", METADATA))
        )
        source = {name: F.col("_meta")[key] for name, key in CONTEXTS.items()}
    return parsed.withColumns(
        {n: F.when(c.isNotNull(), _CLEANERS[n](c)) for n, c in source.items()}
    ).drop("_meta")


def without_signal_only(events: DataFrame) -> DataFrame:
    """Drop browser events that only carry a signal, such as dwell times."""
    if "browser_context" in events.columns:
        signal = F.col("browser_context")["signalOnly"]
    else:
        # A test on the text that is cheap enough to be pushed below everything else.
        signal = F.col("metadata").contains("signalOnly") & (
            F.from_json("metadata", "browserContext STRUCT<signalOnly: BOOLEAN>")[
                "browserContext"
            ]["signalOnly"]
        )
    return events.filter(~F.coalesce(signal, F.lit(False)))


def sanitize_events(events: DataFrame, options: UrlOptions = UrlOptions()) -> DataFrame:
    """The stored form of raw events (C1-C10). Idempotent, so it also serves backfills."""
    typed = with_contexts(events, recheck=True)
    text = canonical_timestamp(F.col("ts_text"))
    cleaned = typed.withColumns(
        {
            "ts_text": text,
            "ts": F.try_to_timestamp(text),
            "window_title": redact_text(F.col("window_title")),
            "target": redact_text(F.col("target")),
            "metadata": redact_metadata(F.col("metadata")),
        }
    )
    derived = canonical_fields(cleaned, options, F.col("browser_context").isNotNull())
    c = F.col("canonical")
    return derived.withColumns(
        {
            "domain": F.coalesce(c["domain"], F.col("domain")),
            "url": c["url"],
            "browser_schema_version": c["browser_schema_version"],
            "canonical_url": c["canonical_url"],
            "route_template": c["route_template"],
            "route_key": c["route_key"],
            "resource_hash": c["resource_hash"],
        }
    ).drop("canonical")
