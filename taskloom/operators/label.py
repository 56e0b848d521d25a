"""Semantic action labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, identifier, lookup
from ..options import LabelOptions, UrlOptions
from ..plans.slices import home_slice
from ..rules import vocabulary as V
from ..rules.action_packs import ACTION_PACKS, REGISTRY_VERSION, ActionRule, ranked_rules
from .normalize import normalize_events

CONTEXT_FIELDS = ["target", "page_type", "resource_hint"]


def spread_over_slices(
    events: DataFrame, options: LabelOptions = LabelOptions(), tasks: int | None = None
) -> DataFrame:
    """Cut streams into time slices, so one busy stream spreads over many tasks.

    Rows near an edge are copied into the neighbouring slice; the copies only lend
    context. Raw rows are narrower than normalised ones, so this is best done first.
    ``tasks`` states the number of tasks; else adaptive execution finds one.
    """
    reach = options.nearby_ms
    slice_ms = max(options.slice_ms, reach)
    offset = F.pmod(F.unix_millis("ts"), F.lit(slice_ms))
    home = F.col("_home")
    slices = F.array_compact(
        F.array(
            home,
            F.when(offset < reach, home - 1),
            F.when(offset >= slice_ms - reach, home + 1),
        )
    )
    return (
        events.withColumn("_home", home_slice(slice_ms))
        .withColumn("slice", F.explode(slices))
        .repartition(*([] if tasks is None else [tasks]), "stream_id", "slice")
    )


def with_nearby_context(events: DataFrame, options: LabelOptions = LabelOptions()) -> DataFrame:
    """Nearest earlier and later event of the same application and domain."""
    sliced = events if "_home" in events.columns else spread_over_slices(events, options)
    ms = F.unix_millis("ts")
    w = Window.partitionBy("stream_id", "slice", "application", "domain").orderBy(
        "ts", "ts_text", "seq"
    )
    here = F.struct("ts", *CONTEXT_FIELDS)

    def within_reach(other: Column) -> Column:
        gap = F.abs(F.unix_millis(other["ts"]) - ms)
        return F.when(
            gap <= options.nearby_ms, F.struct(*[other[f].alias(f) for f in CONTEXT_FIELDS])
        )

    return (
        sliced.withColumns({"_before": F.lag(here).over(w), "_after": F.lead(here).over(w)})
        .filter(F.col("slice") == F.col("_home"))
        .withColumns(
            {
                "previous_nearby": within_reach(F.col("_before")),
                "next_nearby": within_reach(F.col("_after")),
            }
        )
        .drop("_home", "_before", "_after")
    )


def without_nearby_context(events: DataFrame) -> DataFrame:
    """The same shape with empty neighbours, for unbounded input."""
    empty = F.lit(None).cast("struct<target: string, page_type: string, resource_hint: string>")
    return events.withColumns({"previous_nearby": empty, "next_nearby": empty})


def _contextual(field: str) -> Column:
    return F.coalesce(
        F.col(field), F.col("previous_nearby")[field], F.col("next_nearby")[field]
    )


def _with_rule_inputs(events: DataFrame) -> DataFrame:
    """Texts the rules look at, derived once per event."""
    own = F.lower(F.coalesce(F.col("target"), F.lit("")))
    nearby = F.lower(
        F.concat_ws(
            " ",
            F.nullif(F.col("previous_nearby.target"), F.lit("")),
            F.nullif(F.col("next_nearby.target"), F.lit("")),
        )
    )
    return events.withColumns(
        {
            "_own_target": own,
            "_any_target": F.when(own != "", own).otherwise(nearby),
            "_site": F.lower(F.coalesce(F.col("domain"), F.lit(""))),
            "_app": F.lower("application"),
            "_page_type": _contextual("page_type"),
            "_hint": _contextual("resource_hint"),
            "_target_key": identifier(_contextual("target")),
        }
    )


RULE_INPUTS = [
    "_own_target", "_any_target", "_site", "_app", "_page_type", "_hint", "_target_key",
]


def _rule_test(rule: ActionRule) -> Column:
    target = F.col("_own_target" if rule.explicit_target else "_any_target")

    def contains_any(text: Column, tokens) -> Column:
        return reduce(Column.__or__, [text.contains(t.lower()) for t in tokens])

    tests = []
    if rule.applications:
        tests.append(F.col("_app").isin(list(rule.applications)))
    if rule.packs:
        tests.append(F.col("domain_pack_id").isin(list(rule.packs)))
    if rule.routes:
        tests.append(F.col("route_family").isin(list(rule.routes)))
    if rule.events:
        tests.append(F.col("action").isin(list(rule.events)))
    if rule.page_types:
        tests.append(F.col("_page_type").isin(list(rule.page_types)))
    if rule.hints:
        tests.append(F.col("_hint").isin(list(rule.hints)))
    if rule.domains:
        tests.append(contains_any(F.col("_site"), rule.domains))
    if rule.targets:
        tests.append(contains_any(target, rule.targets))
    return reduce(Column.__and__, tests)


def matched_rule_number(packs=ACTION_PACKS) -> Column:
    """1-based rank of the best matching rule, NULL if none."""
    chain = F.lit(None).cast("int") if not packs else None
    for number, (_, rule) in enumerate(ranked_rules(packs), start=1):
        test, value = _rule_test(rule), F.lit(number)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def rule_table(packs=ACTION_PACKS) -> Column:
    """All rules as an array of structs, indexed by rank."""
    return F.array(
        *[
            F.struct(
                F.lit(rule.action).alias("action_name"),
                F.lit(float(rule.confidence)).alias("action_confidence"),
                F.lit("rule").alias("action_source"),
                F.lit(rule.layer).alias("layer"),
                F.lit(pack.id).alias("pack_id"),
                F.lit(pack.version).alias("pack_version"),
                F.lit(rule.id).alias("rule_id"),
                F.lit(None).cast("string").alias("strategy"),
                F.lit(None).cast("string").alias("reason"),
            )
            for pack, rule in ranked_rules(packs)
        ]
    )


def is_meaningful(target_key: Column) -> Column:
    """A verb on its own, or several words that are not all generic."""
    verb = f"(?:^|_)(?:{'|'.join(V.TARGET_VERBS)})(?:_|$)"
    all_generic = f"^(?:(?:{'|'.join(V.GENERIC_TARGET_WORDS)})(?:_|$))*$"
    several = target_key.contains("_") & ~target_key.rlike(all_generic)
    return F.coalesce(target_key.rlike(verb) | several, F.lit(False))


def action_from_page_type(page_type: Column, hint: Column) -> Column:
    """E6."""
    return F.coalesce(
        lookup(V.ACTION_BY_PAGE_TYPE, page_type, F.lit(None)),
        F.when(page_type.endswith("_edit"), F.concat(F.lit("edit_"), hint)),
        F.when(page_type.endswith("_detail"), F.concat(F.lit("review_"), hint)),
        F.when(page_type.endswith("_list"), F.concat(F.lit("open_"), hint, F.lit("_list"))),
        F.concat(F.lit("open_"), page_type),
    )


def _guess(name, confidence, layer, strategy=None, reason=None, source="inferred") -> Column:
    def text(value):
        return (F.lit(value) if value else F.lit(None)).cast("string")

    return F.struct(
        name.alias("action_name"),
        F.lit(float(confidence)).alias("action_confidence"),
        F.lit(source).alias("action_source"),
        F.lit(layer).alias("layer"),
        text(None).alias("pack_id"),
        F.lit(None).cast("int").alias("pack_version"),
        text(None).alias("rule_id"),
        text(strategy).alias("strategy"),
        text(reason).alias("reason"),
    )


def structured_action(workspace: Column, git: Column) -> Column:
    """Action from a file or repository context (E5)."""
    app, activity = workspace["app"], workspace["activityType"]
    item = F.when(workspace["itemType"] == "spreadsheet", F.lit("sheet")).otherwise(
        workspace["itemType"]
    )
    modified = activity == "modified"
    sheet = F.when(modified, F.lit("update_sheet")).otherwise(F.lit("open_sheet"))
    other = F.concat(
        F.when(modified, F.lit("update_"))
        .when(item == "folder", F.lit("open_"))
        .otherwise(F.lit("review_")),
        item,
    )
    commits = F.when(F.coalesce(git["dirtyFileCount"], F.lit(0)) > 0, F.lit("review_git_changes"))
    return F.coalesce(
        F.when(app == "sheets", _guess(sheet, 0.93, "generic", "workspace_context", source="rule")),
        F.when(
            has_text(item) & has_text(activity),
            _guess(other, 0.9, "generic", "workspace_context", source="rule"),
        ),
        F.when(
            git.isNotNull(),
            _guess(
                F.coalesce(commits, F.lit("sync_git_repo")),
                0.92,
                "generic",
                "git_context",
                source="rule",
            ),
        ),
    )


def fallback_action() -> Column:
    """The ladder for events no rule matched."""
    target_key = F.col("_target_key")
    page, hint = F.col("_page_type"), F.col("_hint")
    action = F.col("action")
    return F.coalesce(
        F.when(is_meaningful(target_key), _guess(target_key, 0.74, "generic", "target_inference")),
        structured_action(F.col("workspace_context"), F.col("git_context")),
        F.when(
            has_text(page),
            _guess(action_from_page_type(page, hint), 0.69, "page_type", "page_type_inference"),
        ),
        F.when(
            action == "application_switch",
            _guess(
                F.concat(F.lit("switch_to_"), identifier(F.col("application"))),
                0.62,
                "generic",
                "application_switch_inference",
            ),
        ),
        F.when(
            action == "file_download",
            _guess(F.lit("export_file"), 0.67, "generic", "file_download_inference"),
        ),
        F.when(
            has_text(hint),
            _guess(
                F.concat(identifier(action), F.lit("_"), identifier(hint)),
                0.58,
                "generic",
                "resource_hint_inference",
            ),
        ),
        _guess(
            F.lit("unknown_action"),
            0.2,
            "unknown",
            reason="missing_pack_rule_and_low_signal_fallback",
        ),
    )


def is_calendar_signal(calendar_signal: Column) -> Column:
    return F.coalesce(calendar_signal["signalOnly"], F.lit(False))


def label_in_context(events: DataFrame, packs=ACTION_PACKS) -> DataFrame:
    """Label events that already carry their neighbours."""
    signal = _guess(F.lit("calendar_signal"), 1.0, "generic", "calendar_signal", source="rule")
    numbered = _with_rule_inputs(events).withColumn("_rule", matched_rule_number(packs))
    ruled = [F.try_element_at(rule_table(packs), F.col("_rule"))] if packs else []
    chosen = F.coalesce(
        *ruled,
        F.when(is_calendar_signal(F.col("calendar_signal")), signal),
        fallback_action(),
    )
    match = F.col("_match")
    return (
        numbered.withColumn("_match", chosen)
        .withColumns(
            {
                "action_name": match["action_name"],
                "action_confidence": match["action_confidence"],
                "action_source": match["action_source"],
                "action_match": F.struct(
                    F.lit(REGISTRY_VERSION).alias("registry_version"),
                    *[
                        match[f].alias(f)
                        for f in ("layer", "pack_id", "pack_version", "rule_id", "strategy", "reason")
                    ],
                ),
            }
        )
        .drop("_rule", "_match", "previous_nearby", "next_nearby", *RULE_INPUTS)
    )


def label_raw_events(
    raw: DataFrame,
    options: LabelOptions = LabelOptions(),
    urls: UrlOptions = UrlOptions(),
    tasks: int | None = None,
) -> DataFrame:
    """Raw events -> labelled events over one shuffle of the raw rows."""
    return label_events(normalize_events(spread_over_slices(raw, options, tasks), urls), options)


def label_events(
    normalized: DataFrame, options: LabelOptions = LabelOptions(), packs=ACTION_PACKS
) -> DataFrame:
    return label_in_context(with_nearby_context(normalized, options), packs)
