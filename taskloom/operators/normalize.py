"""Normalisation of raw events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    WHITESPACE,
    blank_to_null,
    has_text,
    lookup,
    stable_id,
    title_pattern,
)
from ..functions.urls import canonical_fields
from ..options import UrlOptions
from ..rules import vocabulary as V
from ..rules.domain_packs import DOMAIN_PACKS, REGISTRY_VERSION, DomainPack, Route
from .privacy import with_contexts, without_signal_only


def action_kind(event_type: Column, action: Column) -> Column:
    return lookup(V.ACTION_BY_EVENT_TYPE, event_type, action)


def application_name(application: Column, aliases: dict = V.APPLICATION_ALIASES) -> Column:
    plain = F.lower(F.trim(application, F.lit(WHITESPACE)))
    return lookup(aliases, plain, F.regexp_replace(plain, r"\s+", "_"))


def singular(c: Column) -> Column:
    n = F.length(c)
    return (
        F.when(c.endswith("ies"), F.concat(F.substr(c, F.lit(1), n - 3), F.lit("y")))
        .when(c.endswith("ses"), F.substr(c, F.lit(1), n - 2))
        .when(c.endswith("s") & (n > 3), F.substr(c, F.lit(1), n - 1))
        .otherwise(c)
    )


def _first_word(text: Column, words: list[str]) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.contains(w), F.lit(w)) for w in words])


def resource_hint(target: Column, path: Column, title: Column) -> Column:
    skipped = "|".join(V.NON_RESOURCE_SEGMENTS)
    static = (
        rf"^(?:/(?:\{{[^/]*|{skipped})(?=/))*/(?!(?:{skipped})(?:/|$))([^/{{][^/]*)"
    )
    return F.coalesce(
        _first_word(target, V.TARGET_HINT_WORDS),
        singular(F.nullif(F.regexp_extract(path, static, 1), F.lit(""))),
        _first_word(title, V.TITLE_HINT_WORDS),
    )


def page_type(domain: Column, path: Column, title: Column, hint: Column) -> Column:
    site, route = F.coalesce(domain, F.lit("")), F.coalesce(path, F.lit(""))
    heading = F.coalesce(title, F.lit(""))
    rules = []
    for token, path_pattern, title_rule, result in V.PAGE_TYPE_RULES:
        tests = []
        if token:
            tests.append(site.contains(token))
        if path_pattern:
            tests.append(route.rlike(path_pattern))
        if title_rule:
            tests.append(heading.rlike(title_rule))
        rules.append(F.when(reduce(Column.__and__, tests), F.lit(result)))
    return F.coalesce(
        *rules,
        F.when(route.endswith("/edit"), F.concat(hint, F.lit("_edit"))),
        F.when(route.rlike(r"/\{(?:id|uuid)\}$"), F.concat(hint, F.lit("_detail"))),
        F.when(
            (route == F.concat(F.lit("/"), hint))
            | (route == F.concat(F.lit("/"), hint, F.lit("s"))),
            F.concat(hint, F.lit("_list")),
        ),
    )


def _route_test(pack: DomainPack, r: Route, template, section, signature, dynamic) -> Column:
    tests = []
    if r.route:
        tests.append(template.rlike(r.route))
    if r.not_route:
        tests.append(~template.rlike(r.not_route))
    if r.sections:
        tests.append(section.isin(list(r.sections)))
    if r.min_dynamic:
        tests.append(F.coalesce(dynamic, F.lit(0)) >= r.min_dynamic)
    if r.signature:
        tests.append(signature == r.signature)
    test = reduce(Column.__and__, tests)
    if r.or_template:
        test = test | (template == r.or_template)
    if pack.needs_section:
        test = test & has_text(template) & has_text(section)
    return test


def domain_pack_number(
    domain: Column,
    route_template: Column,
    taxonomy: Column,
    packs: tuple[DomainPack, ...] = DOMAIN_PACKS,
) -> Column:
    """1-based number of the first pack route that fits, NULL if none."""
    template = F.coalesce(blank_to_null(taxonomy["routeTemplate"]), route_template)
    section = blank_to_null(taxonomy["primarySection"])
    signature = blank_to_null(taxonomy["signature"])
    dynamic = taxonomy["dynamicSegmentCount"]
    site = F.lower(domain)
    chain, number = None, 0
    for pack in packs:
        on_site = reduce(Column.__or__, [site.contains(t) for t in pack.domains])
        inner = None
        for r in pack.routes:
            number += 1
            test = _route_test(pack, r, template, section, signature, dynamic)
            value = F.lit(number)
            inner = F.when(test, value) if inner is None else inner.when(test, value)
        hit = F.when(on_site, inner)
        chain = hit if chain is None else F.coalesce(chain, hit)
    return chain


def domain_pack_fields(
    number: Column, taxonomy: Column, packs: tuple[DomainPack, ...] = DOMAIN_PACKS
) -> dict[str, Column]:
    """What the numbered pack route says about a page."""
    rows = [(pack, r) for pack in packs for r in pack.routes]

    def pick(values) -> Column:
        return F.try_element_at(F.array(*[F.lit(v) for v in values]), number)

    either = F.when(
        blank_to_null(taxonomy["routeTemplate"]).isNotNull(), F.lit("route_taxonomy")
    ).otherwise(F.lit("route_template"))
    return {
        "domain_pack_id": pick(p.id for p, _ in rows),
        "domain_pack_version": pick(p.version for p, _ in rows),
        "route_family": pick(r.family for _, r in rows),
        "pack_page_type": pick(r.page_type for _, r in rows),
        "pack_resource_hint": pick(r.hint for _, r in rows),
        "domain_pack_source": F.when(
            number.isNotNull(),
            F.coalesce(F.nullif(pick(r.source or "" for _, r in rows), F.lit("")), either),
        ),
    }


def normalize_events(
    raw: DataFrame,
    options: UrlOptions = UrlOptions(),
    packs: tuple[DomainPack, ...] = DOMAIN_PACKS,
) -> DataFrame:
    """Raw events -> normalised events without action labels. One narrow stage."""
    kept = with_contexts(without_signal_only(raw))
    derived = canonical_fields(kept, options, F.col("browser_context").isNotNull())
    c = F.col("canonical")
    prepared = derived.select(
        "*",
        F.coalesce(c["domain"], F.lower("domain")).alias("_domain"),
        F.coalesce(c["route_template"], F.col("route_template")).alias("_route"),
        title_pattern(F.col("window_title")).alias("_title"),
    )
    taxonomy = F.col("browser_context")["routeTaxonomy"]
    number = F.col("_pack_number")
    matched = prepared.withColumns(
        {
            "_pack_number": domain_pack_number(
                F.col("_domain"), F.col("_route"), taxonomy, packs
            ),
            "_hint": resource_hint(F.col("target"), F.col("_route"), F.col("_title")),
        }
    )
    pack = domain_pack_fields(number, taxonomy, packs)
    placement = [x for x in ("slice", "_home") if x in raw.columns]
    return matched.select(
        *placement,
        stable_id("normalized_event", F.col("id")).alias("id"),
        F.col("id").alias("raw_event_id"),
        "stream_id",
        "seq",
        "ts",
        "ts_text",
        "source",
        "source_event_type",
        application_name(F.col("application")).alias("application"),
        F.col("_domain").alias("domain"),
        F.coalesce(c["stripped_url"], F.col("canonical_url")).alias("url"),
        c["browser_schema_version"].alias("browser_schema_version"),
        F.coalesce(c["canonical_url"], F.col("canonical_url")).alias("canonical_url"),
        F.col("_route").alias("route_template"),
        F.coalesce(c["route_key"], F.col("route_key")).alias("route_key"),
        F.coalesce(c["resource_hash"], F.col("resource_hash")).alias("resource_hash"),
        pack["route_family"].alias("route_family"),
        pack["domain_pack_id"].alias("domain_pack_id"),
        pack["domain_pack_version"].alias("domain_pack_version"),
        F.when(number.isNotNull(), F.lit(REGISTRY_VERSION)).alias("domain_pack_registry"),
        pack["domain_pack_source"].alias("domain_pack_source"),
        F.coalesce(
            pack["pack_page_type"],
            page_type(F.col("_domain"), F.col("_route"), F.col("_title"), F.col("_hint")),
        ).alias("page_type"),
        F.coalesce(pack["pack_resource_hint"], F.col("_hint")).alias("resource_hint"),
        F.col("_title").alias("title_pattern"),
        action_kind(F.col("source_event_type"), F.col("action")).alias("action"),
        "target",
        "calendar_signal",
        "workspace_context",
        "git_context",
        F.struct(
            F.col("application").alias("application"),
            F.col("domain").alias("domain"),
            F.col("url").alias("url"),
            F.col("canonical_url").alias("canonical_url"),
            F.col("route_template").alias("route_template"),
            F.col("window_title").alias("window_title"),
        ).alias("raw"),
    )
