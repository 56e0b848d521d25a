"""Cutting streams into sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, iso_utc, stable_id
from ..options import SessionOptions
from ..plans.materialize import materialize
from ..plans.slices import NO_TIME, ORDER, home_slice, in_stream_order, order_key, with_order
from ..rules import vocabulary as V
from .label import is_calendar_signal

SLICE = ["stream_id", "slice"]
SESSION = ["stream_id", "session_seq"]
COMPARED = ["application", "domain", "route_family", "page_type", "resource_hint", "action_name"]


def context_shift(previous: Column, current) -> tuple[Column, Column]:
    """(score, changed fields) between two neighbours (F2)."""

    def differs(field: str) -> Column:
        return has_text(previous[field]) & has_text(current(field)) & (
            previous[field] != current(field)
        )

    tests = {
        "application": ~previous["application"].eqNullSafe(current("application")),
        "domain": differs("domain"),
        "route_family": differs("route_family"),
        "page_type": differs("page_type"),
        "resource_hint": differs("resource_hint"),
        "action_reset": (previous["action_name"] != current("action_name"))
        & current("action_name").rlike(V.SHIFT_ACTION_PATTERN),
    }
    changed = F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    )
    return F.size(changed), changed


def with_previous(events: DataFrame, options: SessionOptions) -> DataFrame:
    """Real events with their real predecessor and the signals in between.

    One shuffle by (stream, slice). The table of slices carries the last real event and
    the running signal count over slice edges.
    """
    if "slice" not in events.columns:
        events = events.withColumn("slice", home_slice(options.slice_ms))
    w = Window.partitionBy(*SLICE).orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    signal = F.col("is_signal")
    keyed = (
        with_order(events)
        .withColumns({"ord": order_key(), "is_signal": is_calendar_signal(F.col("calendar_signal"))})
        .withColumn("_signals", F.sum(signal.cast("long")).over(w))
    )
    here = F.struct("ord", *COMPARED, "title_pattern", F.col("_signals").alias("signals"))
    in_slice = keyed.withColumn("_near", F.last(F.when(~signal, here), True).over(before))

    per_slice = keyed.groupBy(*SLICE).agg(
        F.sum(signal.cast("long")).alias("n"),
        F.max(F.when(~signal, here)).alias("tail"),
    )
    order = Window.partitionBy("stream_id").orderBy("slice")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    shifted = F.col("tail").withField("signals", F.col("tail")["signals"] + F.col("offset"))
    carry = (
        per_slice.withColumn("offset", offset)
        .withColumn("far", F.last(F.when(F.col("tail").isNotNull(), shifted), True).over(earlier))
        .select(*SLICE, "offset", "far")
    )
    joined = in_slice.filter(~signal).join(carry, SLICE, "left")
    near = F.col("_near")
    previous = F.when(
        near.isNotNull(), near.withField("signals", near["signals"] + F.col("offset"))
    ).otherwise(F.col("far"))
    return (
        joined.withColumn("previous", previous)
        .withColumn(
            "signal_count",
            F.when(
                F.col("previous").isNotNull(),
                F.col("_signals") + F.col("offset") - F.col("previous")["signals"],
            ).otherwise(F.lit(0)),
        )
        .withColumn("signals_so_far", F.col("_signals") + F.col("offset"))
        .drop("_signals", "_near", "offset", "far", "is_signal")
    )


def mark_boundaries(events: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """Every real event with its boundary verdict before suppression.

    ``hard_reason`` boundaries stand; a ``soft_reason`` may be suppressed by F7.
    """
    previous = F.col("previous")
    score, changed = context_shift(previous, F.col)
    p_ms, ms = previous["ord"]["ms"], F.col("ord")["ms"]
    gap = F.when((p_ms < NO_TIME) & (ms < NO_TIME), ms - p_ms)
    known = with_previous(events, options).withColumns(
        {"gap_ms": gap, "changed_fields": F.when(previous.isNotNull(), changed)}
    )
    score = F.coalesce(F.size("changed_fields"), F.lit(0))
    significant = score >= options.significant_context_score
    gap = F.col("gap_ms")
    hard = (
        F.when(previous.isNull(), F.lit("stream_start"))
        .when(F.col("signal_count") > 0, F.lit("calendar_signal"))
        .when(
            gap > options.inactivity_ms,
            F.when(significant, F.lit("idle_and_context_shift")).otherwise(F.lit("idle_gap")),
        )
    )
    soft = F.when(
        (gap > options.context_shift_ms) & significant, F.lit("context_shift")
    ).when(
        (gap > options.interruption_reset_ms)
        & (score > 0)
        & F.col("action_name").rlike(V.RESET_ACTION_PATTERN)
        & (previous["action_name"] != F.col("action_name")),
        F.lit("reset_after_interruption"),
    )
    return (
        known.withColumn("context_shift_score", score)
        .withColumn("hard_reason", hard)
        .withColumn("soft_reason", F.when(F.col("hard_reason").isNull(), soft))
        .withColumn(
            "token_start",
            F.coalesce(
                (previous["application"] != F.col("application"))
                | (previous["action_name"] != F.col("action_name")),
                F.lit(True),
            ),
        )
        .withColumn(
            "detail_start",
            F.col("token_start")
            | ~previous["title_pattern"].eqNullSafe(F.col("title_pattern"))
            | ~previous["domain"].eqNullSafe(F.col("domain")),
        )
        .withColumn("previous_action_name", previous["action_name"])
        .drop("previous")
    )


def rolling_counts(marked: DataFrame, options: SessionOptions) -> DataFrame:
    """Per soft candidate: what the rolling window before it holds, block by block.

    A block runs from one possible boundary to the next. Candidates follow a quiet gap,
    so each event meets only the few candidates of its own and the next time bucket.
    """
    width = options.rolling_window_ms
    ms = F.col("ord")["ms"]
    bucket = F.floor(ms / width).cast("long")
    w = Window.partitionBy(*SLICE).orderBy("ord")
    mark = F.col("hard_reason").isNotNull() | F.col("soft_reason").isNotNull()
    # A block is named by its first event; blocks cut by a slice edge count as two, which
    # is harmless because blocks are only added up.
    events = marked.select(
        "stream_id",
        "slice",
        F.max(F.when(mark, F.col("ord"))).over(w).alias("block"),
        "ord",
        "application",
        "domain",
        "route_family",
        bucket.alias("bucket"),
    ).filter(F.col("ord")["ms"] < NO_TIME)
    candidates = marked.filter(
        F.col("soft_reason").isNotNull() & (F.col("gap_ms") >= options.rolling_minimum_gap_ms)
    ).select(
        "stream_id",
        F.col("ord").alias("at"),
        F.col("application").alias("c_application"),
        F.col("domain").alias("c_domain"),
        F.col("route_family").alias("c_route_family"),
        F.explode(F.array(bucket, bucket - 1)).alias("bucket"),
    )
    pairs = events.join(candidates, ["stream_id", "bucket"]).filter(
        (F.col("ord") < F.col("at")) & (F.col("at")["ms"] - F.col("ord")["ms"] <= width)
    )

    def same(field: str) -> Column:
        hit = has_text(F.col(field)) & (F.col(field) == F.col(f"c_{field}"))
        return F.sum(F.when(hit, 1).otherwise(0))

    per_block = pairs.groupBy("stream_id", "at", "slice", "block").agg(
        F.min("ord").alias("first"),
        F.max("ord").alias("last"),
        F.count("*").alias("n"),
        F.sum(F.when(F.col("application") == F.col("c_application"), 1).otherwise(0)).alias("same_application"),
        same("domain").alias("same_domain"),
        same("route_family").alias("same_route"),
    )
    return per_block


def _decide(options: SessionOptions):
    """Walk the candidates behind each hard boundary in order; keep only those that split.

    Rows come sorted by stream, hard boundary and candidate, one per block of a candidate's
    window. All that is carried along is where the current session began.
    """

    def walk(frames):
        stream = segment = candidate = start = None
        totals = [0, 0, 0, 0]

        def splits() -> bool:
            n, app, dom, route = totals
            return not (
                n >= options.rolling_minimum_events
                and app / n >= options.rolling_dominance
                and max(dom, route) / n >= options.rolling_dominance
            )

        for frame in frames:
            kept = []
            for r in frame.itertuples(index=False):
                here = (r.at_ms, r.at_text, r.at_seq)
                hard = (r.hard_ms, r.hard_text, r.hard_seq)
                own = (r.stream_id, r.has_hard, *hard)
                if own != segment or here != candidate:
                    if candidate is not None and splits():
                        kept.append((stream, candidate[2]))
                        start = candidate
                    if own != segment:
                        stream, segment = r.stream_id, own
                        start = hard if r.has_hard else None
                    candidate, totals = here, [0, 0, 0, 0]
                if r.n and (start is None or (r.first_ms, r.first_text, r.first_seq) >= start):
                    totals[0] += r.n
                    totals[1] += r.same_application
                    totals[2] += r.same_domain
                    totals[3] += r.same_route
            yield pd.DataFrame(kept, columns=["stream_id", "seq"])
        if candidate is not None and splits():
            yield pd.DataFrame([(stream, candidate[2])], columns=["stream_id", "seq"])

    return walk


def surviving_soft_boundaries(marked: DataFrame, options: SessionOptions) -> DataFrame:
    """(stream_id, seq) of the soft candidates that do split."""
    candidates = marked.filter(F.col("soft_reason").isNotNull()).select(
        "stream_id", "slice", F.col("ord").alias("at"), "gap_ms"
    )
    # The last hard boundary before a candidate, over slice edges.
    hard = marked.filter(F.col("hard_reason").isNotNull()).select(
        "stream_id", "slice", F.col("ord").alias("at"), F.lit(True).alias("hard")
    )
    w = Window.partitionBy(*SLICE).orderBy("at")
    marks = candidates.select("stream_id", "slice", "at", F.lit(False).alias("hard")).unionByName(hard)
    near = marks.withColumn("near", F.max(F.when(F.col("hard"), F.col("at"))).over(w)).filter(
        ~F.col("hard")
    )
    earlier = (
        Window.partitionBy("stream_id")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    far = (
        marks.groupBy(*SLICE)
        .agg(F.max(F.when(F.col("hard"), F.col("at"))).alias("tail"))
        .select(*SLICE, F.max("tail").over(earlier).alias("far"))
    )
    placed = near.join(far, SLICE, "left").select(
        "stream_id", "at", F.coalesce("near", "far").alias("hard_at")
    )
    blocks = rolling_counts(marked, options).select(
        "stream_id", "at", "first", "n", "same_application", "same_domain", "same_route"
    )

    def flat(name: str, prefix: str) -> list[Column]:
        key = F.col(name)
        return [
            F.coalesce(key["ms"], F.lit(0)).alias(f"{prefix}_ms"),
            F.coalesce(key["tie"], F.lit("")).alias(f"{prefix}_text"),
            F.coalesce(key["seq"], F.lit(0)).alias(f"{prefix}_seq"),
        ]

    rows = placed.join(blocks, ["stream_id", "at"], "left").select(
        "stream_id",
        *flat("at", "at"),
        F.col("hard_at").isNotNull().alias("has_hard"),
        *flat("hard_at", "hard"),
        *flat("first", "first"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "same_application", "same_domain", "same_route")],
    )
    # A hard boundary starts a session whatever came before, so what lies between two is independent.
    segment = ["stream_id", "has_hard", "hard_ms", "hard_text", "hard_seq"]
    return in_stream_order(rows, segment, ["at_ms", "at_text", "at_seq"]).mapInPandas(
        _decide(options), "stream_id string, seq long"
    )


MARKS = ["stream_id", "slice", "seq", "ord", "application", "domain", "route_family", "gap_ms", "hard_reason", "soft_reason"]


def assign_sessions(
    events: DataFrame,
    options: SessionOptions = SessionOptions(),
    reuse: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Real events with ``session_seq``, the input number of the session's first event (F8).

    ``reuse`` writes what the search for boundaries looks at once instead of deriving it three times. Whole events are
    marked once more where they get their session, as they are many times as wide. ``tasks`` is the number of buckets if
    the events are kept by stream and slice.
    """
    placed_events = marked = mark_boundaries(events, options)
    if reuse:
        marked = materialize(marked.select(*MARKS), "marked", SLICE, tasks)
    survivors = surviving_soft_boundaries(marked, options)
    soft = (
        marked.filter(F.col("soft_reason").isNotNull())
        .select("stream_id", "slice", "seq", "ord")
        .join(survivors, ["stream_id", "seq"], "left_semi")
    )
    hard = marked.filter(F.col("hard_reason").isNotNull()).select("stream_id", "slice", "ord")
    earlier = (
        Window.partitionBy("stream_id")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per slice: its surviving soft boundaries (few: each follows a quiet gap),
    # its own hard-boundary tail, and the session that is open when it begins.
    starts = hard.withColumn("soft", F.lit(False)).unionByName(
        soft.select("stream_id", "slice", "ord").withColumn("soft", F.lit(True))
    )
    by_slice = starts.groupBy(*SLICE).agg(
        F.max("ord").alias("tail"),
        F.collect_list(F.when(F.col("soft"), F.col("ord"))).alias("splits"),
    )
    all_slices = marked.select(*SLICE).distinct()
    open_session = all_slices.join(by_slice, SLICE, "left").select(
        *SLICE, "splits", F.max("tail").over(earlier).alias("open")
    )
    if reuse:
        # The shuffles of the search are gone before whole events are written.
        open_session = materialize(open_session, "open")
    w = Window.partitionBy(*SLICE).orderBy(*ORDER)
    last_hard = F.max(F.when(F.col("hard_reason").isNotNull(), F.col("ord"))).over(w)
    last_soft = F.array_max(F.filter("splits", lambda s: s <= F.col("ord")))
    placed = (
        placed_events.withColumn("_hard", last_hard)
        .join(open_session, SLICE, "left")
        .withColumn("_start", F.greatest(F.col("_hard"), last_soft, F.col("open")))
    )
    first = F.col("_start")["seq"] == F.col("seq")
    return (
        placed.withColumn("session_seq", F.col("_start")["seq"])
        .withColumn(
            "boundary_reason",
            F.when(first, F.coalesce("hard_reason", "soft_reason")),
        )
        .withColumns(
            {
                "token_start": F.col("token_start") | first,
                "detail_start": F.col("detail_start") | first,
                "fragment": F.lit(None).cast("int"),
                "original_session_id": F.lit(None).cast("string"),
                "split_after": F.lit(None).cast("string"),
            }
        )
        .drop("_hard", "_start", "splits", "open", "hard_reason", "soft_reason")
    )


def roll_up_sessions(assigned: DataFrame) -> DataFrame:
    """One row per session (F9). Pre-aggregated per application and domain.

    A session's rows meet once: what is left of them after a first sum, which needs no shuffle where events are kept
    by stream and slice, is dealt by session, and all later sums are made there. The id is a digest of the first and last event, the count and a sum over the event
    ids, so it can be built from partial aggregates however long a session is.
    """
    id_part = F.conv(F.substring("id", 1, 10), 16, 10).cast("decimal(38,0)")
    boundary = F.when(
        F.col("boundary_reason").isNotNull(),
        F.struct(
            F.col("boundary_reason").alias("reason"),
            F.when(F.col("boundary_reason") != "stream_start", F.col("gap_ms")).alias("gap_ms"),
            F.col("context_shift_score").alias("context_shift_score"),
            F.col("changed_fields").alias("changed_fields"),
            F.col("previous_action_name").alias("previous_action_name"),
            F.col("action_name").alias("current_action_name"),
            F.col("signal_count").alias("signal_count"),
            F.col("split_after").alias("split_after"),
        ),
    )
    part = F.when(F.col("fragment").isNotNull(), F.struct("fragment", "original_session_id"))
    finest = (
        assigned.groupBy(*SLICE, "session_seq", "application", "domain")
        .agg(
            F.count("*").alias("n"),
            F.min("ord").alias("first"),
            F.max("ord").alias("last"),
            F.sum(id_part).alias("digest"),
            F.max(boundary).alias("boundary"),
            F.max(part).alias("part"),
        )
        .drop("slice")
        .repartition(*SESSION)
    )
    sides = finest.withColumn(
        "side",
        F.explode(
            F.array(
                F.struct(F.lit("app").alias("kind"), F.col("application").alias("value")),
                F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")),
            )
        ),
    )
    values = sides.groupBy(*SESSION, F.col("side.kind").alias("kind"), F.col("side.value").alias("value")).agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("digest").alias("digest"),
        F.max("boundary").alias("boundary"),
        F.max("part").alias("part"),
    )
    app = F.col("kind") == "app"
    domain = (F.col("kind") == "domain") & has_text(F.col("value"))
    rank = F.struct(-F.col("n"), F.col("first"))
    seen = F.struct("first", "value")

    def in_order(test: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(test, seen))), lambda s: s["value"])

    rolled = values.groupBy(*SESSION).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("value", F.when(app, rank)).alias("primary_application"),
        F.min_by("value", F.when(domain, rank)).alias("primary_domain"),
        F.sum(F.when(app, F.col("n"))).alias("step_count"),
        F.sum(F.when(app, F.col("digest"))).alias("digest"),
        F.max("boundary").alias("boundary"),
        F.max("part").alias("part"),
        in_order(app).alias("applications"),
        in_order(domain).alias("domains"),
    )
    first, last = F.col("first"), F.col("last")

    def instant(key: Column) -> Column:
        return F.when(key["ms"] < NO_TIME, F.timestamp_millis(key["ms"]))

    def text(key: Column) -> Column:
        return F.coalesce(iso_utc(instant(key)), key["tie"])

    whole = stable_id(
        "session",
        first["seq"].cast("string"),
        last["seq"].cast("string"),
        F.col("step_count").cast("string"),
        F.col("digest").cast("string"),
    )
    fragment = stable_id(
        "session_fragment",
        F.col("part")["original_session_id"],
        F.col("part")["fragment"].cast("string"),
        text(first),
        text(last),
    )
    return rolled.select(
        "stream_id",
        "session_seq",
        F.when(F.col("part").isNull(), whole).otherwise(fragment).alias("session_id"),
        first.alias("start_order"),
        instant(first).alias("start_ts"),
        instant(last).alias("end_ts"),
        text(first).alias("start_time"),
        text(last).alias("end_time"),
        "primary_application",
        "primary_domain",
        F.col("boundary")["reason"].alias("boundary_reason"),
        F.col("boundary").alias("boundary_details"),
        "step_count",
        "applications",
        "domains",
    )


def session_steps(assigned: DataFrame) -> DataFrame:
    """The ordered steps of every session as rows, numbered from 1."""
    in_slice = Window.partitionBy(*SLICE, "session_seq").orderBy(*ORDER)
    earlier = (
        Window.partitionBy(*SESSION)
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        assigned.groupBy(*SESSION, "slice")
        .agg(F.count("*").alias("n"))
        .select(*SESSION, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    return (
        assigned.withColumn("_position", F.row_number().over(in_slice))
        .join(offsets, [*SLICE, "session_seq"])
        .select(
            *SESSION,
            (F.col("_position") + F.col("offset")).alias("step_order"),
            F.col("id").alias("normalized_event_id"),
            "raw_event_id",
            F.col("ts_text").alias("timestamp"),
            "action",
            "action_name",
            "action_confidence",
            "action_source",
            "application",
            "domain",
            "title_pattern",
            "target",
        )
    )


def session_signals(events: DataFrame, options: SessionOptions = SessionOptions()) -> DataFrame:
    """The calendar signals behind each calendar boundary, one row per signal."""
    if "slice" not in events.columns:
        events = events.withColumn("slice", home_slice(options.slice_ms))
    w = Window.partitionBy(*SLICE).orderBy(*ORDER)
    earlier = (
        Window.partitionBy("stream_id")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    signals = with_order(events.filter(is_calendar_signal(F.col("calendar_signal"))))
    offsets = (
        signals.groupBy(*SLICE)
        .agg(F.count("*").alias("n"))
        .select(*SLICE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    numbered = (
        signals.withColumn("_n", F.row_number().over(w))
        .join(offsets, SLICE)
        .select(
            "stream_id",
            (F.col("_n") + F.col("offset")).alias("number"),
            F.col("ts_text").alias("signal_time"),
            F.col("calendar_signal").alias("signal"),
        )
    )
    owners = (
        with_previous(events, options)
        .filter(F.col("signal_count") > 0)
        .select(
            "stream_id",
            F.col("seq").alias("session_seq"),
            F.explode(
                F.sequence(
                    F.col("signals_so_far") - F.col("signal_count") + 1, F.col("signals_so_far")
                )
            ).alias("number"),
        )
    )
    s = F.col("signal")
    return owners.join(numbered, ["stream_id", "number"]).select(
        *SESSION,
        "signal_time",
        s["signalType"].alias("signal_type"),
        s["eventIdHash"].alias("event_id_hash"),
        s["summaryHash"].alias("summary_hash"),
        s["startAt"].alias("start_at"),
        s["endAt"].alias("end_at"),
    )


def split_sessions(assigned: DataFrame, described: DataFrame, feedback: DataFrame) -> DataFrame:
    """Apply split rules from feedback (F10): steps after the first occurrence of the
    action move to a session of their own."""
    from .feedback import resolve_feedback

    ruled = resolve_feedback(
        described.select(*SESSION, "session_id", "workflow_signature", "short_form_signature", "legacy_signature"),
        feedback,
        ["workflow_signature", "short_form_signature", "legacy_signature"],
    ).select(*SESSION, "session_id", F.col("feedback")["split_after_action_name"].alias("rule"))
    ruled = ruled.filter(has_text(F.col("rule")))
    # Only the few ruled sessions take part in the search for their cut.
    cuts = (
        assigned.select(*SESSION, "ord", "action_name")
        .join(ruled, SESSION)
        .groupBy(*SESSION, "session_id", "rule")
        .agg(
            F.min("ord").alias("first"),
            F.max("ord").alias("last"),
            F.min(F.when(F.col("action_name") == F.col("rule"), F.col("ord"))).alias("cut"),
        )
        .filter((F.col("cut") > F.col("first")) & (F.col("cut") < F.col("last")))
        .select(*SESSION, F.col("session_id").alias("_whole"), "rule", "cut")
    )
    placed = assigned.join(cuts, SESSION, "left")
    second = F.col("ord") > F.col("cut")
    starts = (
        placed.filter(second).groupBy(*SESSION).agg(F.min("ord").alias("second_start"))
    )
    head = second & (F.col("ord") == F.col("second_start"))
    return (
        placed.join(starts, SESSION, "left")
        .withColumns(
            {
                "fragment": F.when(F.col("cut").isNotNull(), F.when(second, 2).otherwise(1)),
                "original_session_id": F.col("_whole"),
                "boundary_reason": F.when(head, F.lit("context_shift")).otherwise(F.col("boundary_reason")),
                "split_after": F.when(head, F.col("rule")),
                "token_start": F.col("token_start") | F.coalesce(head, F.lit(False)),
                "detail_start": F.col("detail_start") | F.coalesce(head, F.lit(False)),
                "session_seq": F.when(second, F.col("second_start")["seq"]).otherwise(F.col("session_seq")),
            }
        )
        .drop("_whole", "rule", "cut", "second_start")
    )


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Session summaries, latest first."""
    return sessions.select(
        "stream_id",
        "session_id",
        "start_time",
        "end_time",
        "primary_application",
        "primary_domain",
        "boundary_reason",
        "step_count",
    ).orderBy(F.col("start_time").desc(), "session_id")


def sessions_of_events(steps: DataFrame, sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted ``normalized_event_id`` the session that holds it, and its place there."""
    return (
        wanted.select("normalized_event_id")
        .distinct()
        .join(steps.select("normalized_event_id", *SESSION, "step_order"), "normalized_event_id")
        .join(sessions, SESSION)
    )


def session_details(steps: DataFrame, sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The steps, in order, of each wanted ``session_id``, beside the session."""
    some = sessions.join(wanted.select("session_id").distinct(), "session_id", "left_semi")
    return steps.join(some, SESSION).orderBy("session_id", "step_order")
