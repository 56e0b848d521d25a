"""Activity events derived from snapshots and browser tab events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, canonical_timestamp, has_text, opaque_hash, short_hash
from ..functions.urls import segment_slot
from ..options import DAY, HOUR, MINUTE
from ..plans.slices import (
    ORDER,
    order_key,
    with_next_row,
    with_previous_row,
    with_running_max,
    with_running_number,
)


def _time(text: Column) -> Column:
    return F.try_to_timestamp(text)


# --- meetings ---------------------------------------------------------------------


def calendar_signals(meetings: DataFrame) -> DataFrame:
    """A start and an end signal per meeting, ids and titles hashed (B1).

    ``meetings``: stream_id, id, summary, start_at, end_at, attendees_count.
    """
    start, end = canonical_timestamp(F.col("start_at")), canonical_timestamp(F.col("end_at"))
    side = F.explode(
        F.array(
            F.struct(F.lit("meeting_start").alias("type"), start.alias("at")),
            F.struct(F.lit("meeting_end").alias("type"), end.alias("at")),
        )
    )
    s = F.col("side")
    return meetings.withColumn("side", side).select(
        "stream_id",
        F.lit("calendar").alias("source"),
        F.when(s["type"] == "meeting_start", F.lit("calendar.meeting.start"))
        .otherwise(F.lit("calendar.meeting.end"))
        .alias("source_event_type"),
        s["at"].alias("ts_text"),
        F.lit("gws-calendar").alias("application"),
        F.lit("calendar_signal").alias("action"),
        s["type"].alias("target"),
        F.struct(
            s["type"].alias("signalType"),
            short_hash(F.col("id")).alias("eventIdHash"),
            short_hash(F.col("summary")).alias("summaryHash"),
            start.alias("startAt"),
            end.alias("endAt"),
            F.col("attendees_count").cast("long").alias("attendeesCount"),
            F.lit(True).alias("signalOnly"),
        ).alias("calendar_signal"),
    )


def active_meetings(polls: DataFrame, meetings: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Meetings running at each poll: start <= at < end (B2).

    An interval join on time buckets; a meeting appears in every bucket it touches.
    ``polls``: stream_id, at; ``meetings``: stream_id, id, start_at, end_at (timestamps).
    """
    first = F.floor(F.unix_millis("start_at") / bucket_ms)
    last = F.floor((F.unix_millis("end_at") - 1) / bucket_ms)
    spread = meetings.filter("end_at > start_at").withColumn(
        "bucket", F.explode(F.sequence(first, last))
    )
    timed = polls.withColumn("bucket", F.floor(F.unix_millis("at") / bucket_ms))
    return (
        timed.join(spread, ["stream_id", "bucket"])
        .filter((F.col("start_at") <= F.col("at")) & (F.col("at") < F.col("end_at")))
        .drop("bucket")
    )


def meeting_changes(polls: DataFrame, meetings: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Meetings that started or ended between consecutive polls; the first poll seeds."""
    times = polls.select("stream_id", "at").distinct()
    times = times.withColumns(
        {"ts": F.col("at"), "ts_text": F.lit(None).cast("string"), "seq": F.lit(0).cast("long")}
    )
    numbered = with_running_number(times, ["stream_id"], "poll", bucket_ms).select("stream_id", "at", "poll")
    active = active_meetings(numbered, meetings, bucket_ms).select("stream_id", "id", "poll", "at")
    key = ["stream_id", "id", "poll"]
    started = (
        active.filter("poll > 1")
        .join(active.select("stream_id", "id", (F.col("poll") + 1).alias("poll")), key, "left_anti")
        .select("stream_id", "id", "poll", "at", F.lit("meeting_start").alias("signal_type"))
    )
    ended = (
        active.select("stream_id", "id", (F.col("poll") + 1).alias("poll"))
        .join(active.select(*key), key, "left_anti")
        .join(numbered, ["stream_id", "poll"])
        .select("stream_id", "id", "poll", "at", F.lit("meeting_end").alias("signal_type"))
    )
    return started.unionByName(ended)


# --- snapshots --------------------------------------------------------------------


def _changed(rows: DataFrame, keys: list[str], slice_ms: int) -> DataFrame:
    """Rows whose ``fingerprint`` differs from the one before."""
    return (
        with_previous_row(rows, keys, "before", ["fingerprint"], slice_ms)
        .filter(F.col("before").isNull() | ~F.col("before.fingerprint").eqNullSafe(F.col("fingerprint")))
        .drop("before")
    )


def window_changes(snapshots: DataFrame, slice_ms: int = HOUR) -> DataFrame:
    """Active-window polls -> rows where application or title changed."""
    mark = F.concat(F.coalesce("application", F.lit("")), F.lit("|"), F.coalesce("window_title", F.lit("")))
    return _changed(snapshots.withColumn("fingerprint", mark), ["stream_id"], slice_ms)


# Item type by MIME type.
ITEM_TYPE_BY_MIME = {
    "application/vnd.google-apps.spreadsheet": "spreadsheet",
    "application/vnd.google-apps.document": "document",
    "application/vnd.google-apps.presentation": "presentation",
    "application/vnd.google-apps.folder": "folder",
    "application/pdf": "pdf",
}


def item_type(mime: Column) -> Column:
    pairs = [F.lit(x) for kv in ITEM_TYPE_BY_MIME.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), mime), F.lit("file"))


def _with_activity(files: DataFrame, lookback_ms: int) -> DataFrame:
    """What last happened to a file, if it is recent enough at the time of the poll."""
    modified, viewed = _time(F.col("modified_time")), _time(F.col("viewed_time"))
    seen = viewed.isNotNull() & (modified.isNull() | (viewed >= modified))
    activity = F.when(seen, F.lit("viewed")).when(modified.isNotNull(), F.lit("modified"))
    observed = F.when(seen, viewed).otherwise(modified)
    recent = F.unix_millis(observed) >= F.unix_millis("ts") - lookback_ms
    return files.withColumn("activity_type", activity).withColumn("observed_at", observed).filter(
        activity.isNotNull() & recent
    )


def _file_mark() -> Column:
    return F.concat_ws(
        ":",
        opaque_hash(F.col("file_id")),
        F.coalesce("modified_time", F.lit("")),
        F.coalesce("viewed_time", F.lit("")),
    )


def file_activity(files: DataFrame, lookback_ms: int = 15 * MINUTE, slice_ms: int = DAY) -> DataFrame:
    """File polls -> events for recent, changed files.

    ``files``: stream_id, seq, ts and ts_text of the poll, file_id, mime_type,
    modified_time, viewed_time.
    """
    rows = _with_activity(files, lookback_ms).withColumn("fingerprint", _file_mark())
    kind = item_type(F.col("mime_type"))
    changed = _changed(rows, ["stream_id", "file_id"], slice_ms)
    viewed = F.col("activity_type") == "viewed"
    return changed.select(
        "stream_id",
        "seq",
        F.lit("workspace").alias("source"),
        F.concat(F.lit("workspace.drive."), F.col("activity_type")).alias("source_event_type"),
        F.col("observed_at").alias("ts"),
        F.lit("gws-drive").alias("application"),
        F.lit("drive.google.com").alias("domain"),
        opaque_hash(F.col("file_id")).alias("resource_hash"),
        F.lit("workspace_activity").alias("action"),
        F.concat(F.when(viewed, F.lit("review_")).otherwise(F.lit("update_")), kind).alias("target"),
        kind.alias("item_type"),
        "activity_type",
    )


def spreadsheet_activity(files: DataFrame, lookback_ms: int = 15 * MINUTE, slice_ms: int = DAY) -> DataFrame:
    """Spreadsheet polls: as files, with the sheet counts in the fingerprint."""
    mark = F.concat_ws(
        ":",
        _file_mark(),
        F.coalesce(F.col("sheet_count"), F.lit(0)).cast("string"),
        F.coalesce(F.col("grid_sheet_count"), F.lit(0)).cast("string"),
    )
    rows = _with_activity(files, lookback_ms).withColumn("fingerprint", mark)
    viewed = F.col("activity_type") == "viewed"
    opens = viewed & (item_type(F.col("mime_type")) == "spreadsheet")
    return _changed(rows, ["stream_id", "file_id"], slice_ms).select(
        "stream_id",
        "seq",
        F.lit("workspace").alias("source"),
        F.concat(F.lit("workspace.sheets."), F.col("activity_type")).alias("source_event_type"),
        F.col("observed_at").alias("ts"),
        F.lit("gws-sheets").alias("application"),
        F.lit("docs.google.com").alias("domain"),
        opaque_hash(F.col("file_id")).alias("resource_hash"),
        F.lit("workspace_activity").alias("action"),
        F.when(opens, F.lit("open_sheet")).otherwise(F.lit("update_sheet")).alias("target"),
        "activity_type",
        "sheet_count",
        "grid_sheet_count",
    )


def repository_activity(repos: DataFrame, slice_ms: int = HOUR) -> DataFrame:
    """Repository polls -> commit and status events.

    ``repos``: stream_id, seq, ts, ts_text, repo_hash, remote_host, dirty_file_count,
    last_commit_at.
    """
    before = F.col("before")
    facts = ["last_commit_at", "dirty_file_count"]
    rows = with_previous_row(repos, ["stream_id", "repo_hash"], "before", facts, slice_ms)
    new_commit = before.isNull() | ~before["last_commit_at"].eqNullSafe(F.col("last_commit_at"))
    new_status = ~before["dirty_file_count"].eqNullSafe(F.col("dirty_file_count"))
    change = F.when(new_commit, F.lit("commit")).when(new_status, F.lit("status"))
    target = (
        F.when(F.col("change_type") == "commit", F.lit("record_git_commit"))
        .when(F.col("dirty_file_count") > 0, F.lit("review_git_changes"))
        .otherwise(F.lit("sync_git_repo"))
    )
    return (
        rows.withColumn("change_type", change)
        .filter("change_type IS NOT NULL")
        .select(
            "stream_id",
            "seq",
            F.lit("git").alias("source"),
            F.concat(F.lit("git.repo."), F.col("change_type")).alias("source_event_type"),
            "ts",
            F.lit("git").alias("application"),
            F.col("remote_host").alias("domain"),
            F.col("repo_hash").alias("resource_hash"),
            F.lit("git_activity").alias("action"),
            target.alias("target"),
            "dirty_file_count",
            "last_commit_at",
        )
    )


# --- browser tabs -----------------------------------------------------------------


def _with_active_tab(tab_events: DataFrame, slice_ms: int) -> DataFrame:
    """Add ``act``, the last activation of the window up to each row, and ``gone``, when such a tab was closed.

    ``act`` is (at, tab_id) and ``gone`` an order key; the active tab is still there if ``act.at`` is later.
    """
    window = ["stream_id", "window_id"]
    activated = F.when(
        F.col("kind") == "tab_activated", F.struct(order_key().alias("at"), F.col("tab_id").alias("tab_id"))
    )
    rows = with_running_max(tab_events, window, {"act": activated}, slice_ms)
    closed = (F.col("kind") == "tab_removed") & (F.col("act.tab_id") == F.col("tab_id"))
    return with_running_max(rows, window, {"gone": F.when(closed, order_key())}, slice_ms)


def tab_order(tab_events: DataFrame, slice_ms: int = HOUR) -> DataFrame:
    """Activation numbers per stream and per window, and the tab that was active before.

    ``tab_events`` holds all kinds: a window whose active tab was closed has none until the next activation.
    """
    stream, window = ["stream_id"], ["stream_id", "window_id"]
    rows = _with_active_tab(tab_events, slice_ms).filter("kind = 'tab_activated'").drop("act")
    rows = with_running_number(rows, stream, "global_sequence", slice_ms)
    rows = with_running_number(rows, window, "window_sequence", slice_ms)
    rows = with_previous_row(rows, window, "before", ["tab_id", *ORDER], slice_ms)
    since = F.struct(*[F.col(f"before.{k}").alias(k) for k in ORDER])
    there = F.col("gone").isNull() | (since > F.col("gone"))
    return rows.withColumn("previous_tab_id", F.when(there, F.col("before.tab_id"))).drop("before", "gone")


STARTS = ["tab_activated", "navigation", "route_change", "window_focus"]


def dwell_segments(tab_events: DataFrame, slice_ms: int = HOUR) -> DataFrame:
    """Time the active tab of a window stayed in front, with what ended it.

    ``tab_events``: stream_id, seq, ts, ts_text, window_id, tab_id, kind. Navigation and closing concern the active tab
    only; those of other tabs neither end nor start a segment. Activating the active tab again, or a focus without a
    blur before it, starts anew without a segment.
    """
    window = ["stream_id", "window_id"]
    act = F.col("act")
    rows = _with_active_tab(tab_events, slice_ms).filter(act.isNotNull())
    there = F.col("gone").isNull() | (act["at"] > F.col("gone"))
    own = act["tab_id"] == F.col("tab_id")
    counts = (
        (F.col("kind") == "tab_activated")
        | (F.col("kind").isin("window_focus", "window_blur") & there)
        | (F.col("kind").isin("navigation", "route_change") & own & there)
        | ((F.col("kind") == "tab_removed") & own)
    )
    rows = rows.filter(counts).withColumn("active_tab_id", act["tab_id"]).drop("act", "gone")
    rows = with_next_row(rows, window, "after", ["ts", "kind", "tab_id"], slice_ms)
    after = F.col("after")
    reason = (
        F.when(
            (after["kind"] == "tab_activated") & (after["tab_id"] != F.col("active_tab_id")), F.lit("tab_switch")
        )
        .when(after["kind"].isin("navigation", "route_change", "window_blur"), after["kind"])
        .when(after["kind"] == "tab_removed", F.lit("tab_closed"))
    )
    duration = F.unix_millis(after["ts"]) - F.unix_millis("ts")
    return (
        rows.filter(F.col("kind").isin(STARTS) & after.isNotNull())
        .select(
            "stream_id",
            "seq",
            "window_id",
            F.col("active_tab_id").alias("tab_id"),
            F.col("ts").alias("started_at"),
            after["ts"].alias("ended_at"),
            duration.alias("duration_ms"),
            reason.alias("reason"),
        )
        .filter((F.col("duration_ms") > 0) & F.col("reason").isNotNull())
    )


def carried_context(pages: DataFrame, columns: list[str], slice_ms: int = HOUR) -> DataFrame:
    """Last known page facts of a tab while its URL stays the same."""
    tab = ["stream_id", "tab_id"]
    rows = with_previous_row(pages, tab, "before", ["url"], slice_ms)
    moved = F.col("before").isNull() | ~F.col("before.url").eqNullSafe(F.col("url"))
    values = {"_run": F.when(moved, order_key())}
    for c in columns:
        values[f"_last_{c}"] = F.when(
            F.col(c).isNotNull(), F.struct(order_key().alias("at"), F.col(c).alias("value"))
        )
    running = with_running_max(rows, tab, values, slice_ms)
    known = {
        c: F.when(F.col(f"_last_{c}")["at"] >= F.col("_run"), F.col(f"_last_{c}")["value"])
        for c in columns
    }
    return running.withColumns(known).drop("before", "_run", *[f"_last_{c}" for c in columns])


# --- page structure ---------------------------------------------------------------

HIDDEN_MARKUP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LANDMARKS = ["article", "aside", "dialog", "main", "nav", "section"]
INPUT_TAG = r"(?i)<input\b[^>]*>"
INPUT_TYPE = r"""(?i)\stype\s*=\s*["']?([^"'\s>]+)"""


def bucket(n: Column) -> Column:
    return (
        F.when(n <= 0, F.lit("0"))
        .when(n == 1, F.lit("1"))
        .when(n <= 4, F.lit("2_4"))
        .when(n <= 9, F.lit("5_9"))
        .otherwise(F.lit("10_plus"))
    )


def page_structure(pages: DataFrame) -> DataFrame:
    """Structure descriptor and fingerprint of each page's markup, all its inputs included."""
    html = F.col("_markup")

    def tags(pattern: str) -> Column:
        return bucket(F.regexp_count(html, F.lit(pattern)))

    def word(raw: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_"))
        return F.coalesce(segment_slot(raw), F.nullif(plain, F.lit("")), F.lit("segment"))

    inputs = F.regexp_extract_all(html, F.lit(INPUT_TAG), F.lit(0))
    kinds = F.array_sort(
        F.array_distinct(
            F.transform(
                inputs,
                lambda t: word(
                    F.coalesce(F.nullif(F.regexp_extract(t, INPUT_TYPE, 1), F.lit("")), F.lit("text"))
                ),
            )
        )
    )
    doctype = F.lower(F.regexp_extract("html", r"(?i)^\s*<!doctype\s+([a-z]+)", 1))
    landmarks = F.array_compact(
        F.array(*[F.when(html.rlike(rf"(?i)<{n}\b"), F.lit(n)) for n in LANDMARKS])
    )
    facts = F.struct(
        F.lit("text/html").alias("contentType"),
        F.when(doctype == "html", F.lit("CSS1Compat")).otherwise(F.lit("BackCompat")).alias("compatMode"),
        F.coalesce(F.nullif(doctype, F.lit("")), F.lit("unknown")).alias("doctype"),
        landmarks.alias("landmarks"),
        F.struct(
            tags(r"(?i)<form\b").alias("forms"),
            tags(r"(?i)<table\b").alias("tables"),
            tags(r"""(?i)<button\b|<[a-z0-9]+\b[^>]*\srole\s*=\s*["']?button\b""").alias("buttons"),
            tags(r"(?i)<a\b[^>]*\shref\b").alias("links"),
            tags(r"(?i)<(?:input|textarea|select)\b").alias("inputs"),
            tags(r"(?i)<h[123]\b").alias("headings"),
        ).alias("counts"),
        kinds.alias("inputKinds"),
        html.rlike(r"""(?i)<input\b[^>]*\stype\s*=\s*["']?file\b""").alias("hasFileInput"),
        html.rlike(r"""(?i)\scontenteditable\s*=\s*["']?true\b|\srole\s*=\s*["']?textbox\b""").alias(
            "hasRichText"
        ),
    )
    return (
        pages.withColumn("_markup", F.regexp_replace("html", HIDDEN_MARKUP, " "))
        .withColumn("descriptor", F.to_json(facts))
        .withColumn("structure_hash", F.substring(F.sha2("descriptor", 256), 1, 24))
        .drop("_markup")
    )


def pages_by_structure(pages: DataFrame) -> DataFrame:
    return page_structure(pages).groupBy("structure_hash", "descriptor").agg(
        F.count("*").alias("pages")
    )
