"""The same inputs in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from ..rules import vocabulary as V
from ..rules.action_packs import ranked_rules
from ..rules.domain_packs import DOMAIN_PACKS

S = 240  # stretch factor of every duration


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def case_map(values: dict, x: str, default: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in values.items())
    return f"CASE {x} {whens} ELSE {default} END"


UUID = V.UUID_BODY


def opaque(x: str) -> str:
    return (
        f"(regexp_full_match({x}, '[A-Za-z0-9_-]{{16,}}') AND (regexp_matches({x}, '[0-9]') OR "
        f"(regexp_matches({x}, '[a-z]') AND regexp_matches({x}, '[A-Z]')) OR NOT regexp_matches({x}, '[-_]')))"
    )


def segment(x: str) -> str:
    suffix = f"coalesce(list_filter(regexp_split_to_array({x}, '[-_]'), lambda w: w <> '')[-1], '')"
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN '{{id}}' "
        f"WHEN regexp_full_match({x}, '(?i){UUID}') THEN '{{uuid}}' "
        f"WHEN regexp_full_match({x}, '(?i)[0-9a-f]{{12,}}') OR {opaque(x)} OR {opaque(suffix)} THEN '{{id}}' "
        f"ELSE lower({x}) END"
    )


def segments(path: str) -> str:
    return f"list_filter(string_split({path}, '/'), lambda s: s <> '')"


def template(path: str) -> str:
    return f"'/' || array_to_string(list_transform({segments(path)}, lambda s: {segment('s')}), '/')"


def scheme(url: str) -> str:
    return f"regexp_extract({url}, '^([a-z]+)://', 1)"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-z]+://([^/?#:]+)', 1))"


def path(url: str) -> str:
    p = f"regexp_extract({url}, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
    return f"CASE WHEN {p} = '' THEN '/' ELSE {p} END"


def query_of(url: str) -> str:
    return f"regexp_extract({url}, '\\?([^#]*)', 1)"


QUERY_KEYS = ["filter", "mode", "page", "section", "sort", "status", "tab", "type", "view"]


def kept_query(url: str) -> str:
    pairs = (
        f"list_transform(string_split({query_of(url)}, '&'), lambda p: "
        "struct_pack(k := lower(split_part(p, '=', 1)), v := substr(p, strpos(p, '=') + 1)))"
    )
    good = (
        f"list_filter({pairs}, lambda q: q.k IN {in_list(QUERY_KEYS)} AND "
        "regexp_full_match(q.v, '(?i)[a-z0-9._:-]{1,64}'))"
    )
    text = f"list_transform(list_sort({good}), lambda q: q.k || '=' || replace(q.v, ':', '%3A'))"
    return f"array_to_string({text}, '&')"


def sanitized(url: str) -> str:
    q = kept_query(url)
    return (
        f"{scheme(url)} || '://' || {host(url)} || {path(url)} || "
        f"CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"
    )


def canonical(url: str) -> str:
    two = f"list_transform({segments(path(url))}, lambda s: {segment('s')})[1:2]"
    return f"{scheme(url)} || '://' || {host(url)} || '/' || array_to_string({two}, '/')"


def title(x: str) -> str:
    out = f"trim({x})"
    out = f"regexp_replace({out}, '(?i)\\b{UUID}\\b', '{{uuid}}', 'g')"
    out = f"regexp_replace({out}, '#[0-9]+', '#{{id}}', 'g')"
    out = f"regexp_replace({out}, '\\b[0-9]{{2,}}\\b', '{{id}}', 'g')"
    return f"regexp_replace({out}, '\\s+', ' ', 'g')"


def app(x: str) -> str:
    low = f"lower(trim({x}))"
    return case_map(V.APPLICATION_ALIASES, low, f"regexp_replace({low}, '\\s+', '_', 'g')")


def action(t: str, a: str) -> str:
    return case_map(V.ACTION_BY_EVENT_TYPE, t, a)


def singular(x: str) -> str:
    return (
        f"CASE WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' "
        f"WHEN {x} LIKE '%ses' THEN left({x}, length({x}) - 2) "
        f"WHEN {x} LIKE '%s' AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def first_word(x: str, words) -> str:
    whens = " ".join(f"WHEN contains(lower({x}), {quote(w)}) THEN {quote(w)}" for w in words)
    return f"CASE {whens} END"


def hint(target: str, route: str, heading: str) -> str:
    first = (
        f"list_filter({segments(route)}, lambda s: NOT starts_with(s, '{{') AND "
        f"s NOT IN {in_list(V.NON_RESOURCE_SEGMENTS)})[1]"
    )
    return (
        f"coalesce({first_word(target, V.TARGET_HINT_WORDS)}, {singular(first)}, "
        f"{first_word(heading, V.TITLE_HINT_WORDS)})"
    )


def page_type(domain: str, route: str, heading: str, resource: str) -> str:
    d, r, t = (f"coalesce({x}, '')" for x in (domain, route, heading))
    whens = []
    for token, path_rule, title_rule, result in V.PAGE_TYPE_RULES:
        tests = []
        if token:
            tests.append(f"contains({d}, {quote(token)})")
        if path_rule:
            tests.append(f"regexp_matches({r}, {quote(path_rule)})")
        if title_rule:
            tests.append(f"regexp_matches({t}, '(?i)\\border\\b.*#\\{{id\\}}')")
        whens.append(f"WHEN {' AND '.join(tests)} THEN {quote(result)}")
    whens.append(f"WHEN {resource} IS NOT NULL AND {r} LIKE '%/edit' THEN {resource} || '_edit'")
    whens.append(
        f"WHEN {resource} IS NOT NULL AND regexp_matches({r}, '/\\{{(?:id|uuid)\\}}$') THEN {resource} || '_detail'"
    )
    whens.append(
        f"WHEN {resource} IS NOT NULL AND {r} IN ('/' || {resource}, '/' || {resource} || 's') THEN {resource} || '_list'"
    )
    return f"CASE {' '.join(whens)} END"


def pack_number(domain: str, route: str, section: str = "NULL::VARCHAR", signature: str = "NULL::VARCHAR", dynamic: str = "0") -> str:
    whens, n = [], 0
    for pack in DOMAIN_PACKS:
        site = "(" + " OR ".join(f"contains({domain}, {quote(d)})" for d in pack.domains) + ")"
        for r in pack.routes:
            n += 1
            tests = []
            if r.route:
                tests.append(f"regexp_matches({route}, {quote(r.route)})")
            if r.not_route:
                tests.append(f"NOT regexp_matches({route}, {quote(r.not_route)})")
            if r.sections:
                tests.append(f"{section} IN {in_list(r.sections)}")
            if r.min_dynamic:
                tests.append(f"{dynamic} >= {r.min_dynamic}")
            if r.signature:
                tests.append(f"{signature} = {quote(r.signature)}")
            test = " AND ".join(tests)
            if r.or_template:
                test = f"(({test}) OR {route} = {quote(r.or_template)})"
            if pack.needs_section:
                test = f"{test} AND {section} IS NOT NULL"
            whens.append(f"WHEN {site} AND ({test}) THEN {n}")
    return f"CASE {' '.join(whens)} END"


def pack_field(number: str, field: str) -> str:
    rows = [(p, r) for p in DOMAIN_PACKS for r in p.routes]
    pick = {
        "id": lambda p, r: p.id,
        "family": lambda p, r: r.family,
        "page_type": lambda p, r: r.page_type,
        "hint": lambda p, r: r.hint,
        "source": lambda p, r: r.source or "route_template",
    }[field]
    whens = " ".join(f"WHEN {i} THEN {quote(pick(p, r))}" for i, (p, r) in enumerate(rows, 1))
    return f"CASE {number} {whens} END"


def identifier(x: str) -> str:
    return f"trim(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"


def meaningful(x: str) -> str:
    words = f"list_filter(string_split({x}, '_'), lambda w: w <> '')"
    return (
        f"coalesce(len(list_filter({words}, lambda w: w IN {in_list(V.TARGET_VERBS)})) > 0 OR "
        f"(len({words}) >= 2 AND len(list_filter({words}, lambda w: w NOT IN {in_list(V.GENERIC_TARGET_WORDS)})) > 0), false)"
    )


def rule_number() -> str:
    whens = []
    for n, (_, r) in enumerate(ranked_rules(), 1):
        tests = []
        if r.applications:
            tests.append(f"application IN {in_list(r.applications)}")
        if r.domains:
            tests.append("(" + " OR ".join(f"contains(coalesce(domain, ''), {quote(d)})" for d in r.domains) + ")")
        if r.packs:
            tests.append(f"domain_pack_id IN {in_list(r.packs)}")
        if r.routes:
            tests.append(f"route_family IN {in_list(r.routes)}")
        if r.events:
            tests.append(f"action IN {in_list(r.events)}")
        if r.targets:
            x = "own_target" if r.explicit_target else "any_target"
            tests.append("(" + " OR ".join(f"contains({x}, {quote(t)})" for t in r.targets) + ")")
        whens.append(f"WHEN {' AND '.join(tests)} THEN {n}")
    return f"CASE {' '.join(whens)} END"


def rule_field(number: str, field: str) -> str:
    pick = {
        "action": lambda p, r: quote(r.action),
        "confidence": lambda p, r: str(r.confidence),
        "layer": lambda p, r: quote(r.layer),
        "pack": lambda p, r: quote(p.id),
        "rule": lambda p, r: quote(r.id),
    }[field]
    whens = " ".join(f"WHEN {i} THEN {pick(p, r)}" for i, (p, r) in enumerate(ranked_rules(), 1))
    return f"CASE {number} {whens} END"


def from_page_type(p: str, h: str) -> str:
    special = " ".join(f"WHEN {p} = {quote(k)} THEN {quote(v)}" for k, v in V.ACTION_BY_PAGE_TYPE.items())
    return (
        f"CASE {special} WHEN {p} LIKE '%\\_edit' ESCAPE '\\' AND {h} IS NOT NULL THEN 'edit_' || {h} "
        f"WHEN {p} LIKE '%\\_detail' ESCAPE '\\' AND {h} IS NOT NULL THEN 'review_' || {h} "
        f"WHEN {p} LIKE '%\\_list' ESCAPE '\\' AND {h} IS NOT NULL THEN 'open_' || {h} || '_list' "
        f"ELSE 'open_' || {p} END"
    )


ACTIVITY = """
e AS (SELECT event_id, user_id, ts, event_type, value,
             CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
n AS (SELECT COUNT(*) AS c FROM pages),
activity AS (
  SELECT CAST(e.user_id AS VARCHAR) AS stream_id, e.event_id AS seq,
    date_trunc('milliseconds', e.ts) AS ts, e.event_type, e.k,
    CASE e.event_type WHEN 'click' THEN 'browser.click' WHEN 'view' THEN 'chrome.navigation'
         WHEN 'purchase' THEN 'form.submit' WHEN 'signup' THEN 'app.switch' ELSE 'file.download' END AS source_event_type,
    CASE WHEN e.event_type IN ('click','view','purchase') THEN 'chrome_extension' ELSE 'desktop' END AS source,
    CASE WHEN e.event_type IN ('click','view','purchase') THEN 'Google Chrome'
         WHEN e.k % 3 = 0 THEN 'Slack' WHEN e.k % 3 = 1 THEN 'Microsoft Excel' ELSE 'Outlook' END AS raw_application,
    CASE WHEN e.k % 2 = 0 THEN 'Order #' || CAST(1000 + e.k AS VARCHAR) || ' - Admin' END AS window_title,
    CASE WHEN e.event_type NOT IN ('click','view','purchase') THEN NULL
         WHEN e.k % 4 = 0 THEN 'https://admin.example.com/orders/' || CAST(1000 + e.k AS VARCHAR)
         WHEN e.k % 4 = 1 THEN 'https://docs.google.com/spreadsheets/d/' || CAST(1000 + e.k AS VARCHAR) || '/edit'
         WHEN e.k % 4 = 2 THEN 'https://www.notion.so/' || CAST(1000 + e.k AS VARCHAR) || '?view=list&token=x'
         ELSE p.url END AS raw_url,
    CASE e.k % 5 WHEN 0 THEN 'search_order' WHEN 1 THEN 'status_dropdown'
                 WHEN 3 THEN 'toolbar_button' WHEN 4 THEN 'export_orders_csv' END AS target
  FROM e CROSS JOIN n JOIN pages p ON p.page_id = e.k % n.c)"""

MS = "epoch_ms(ts)"
TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"

NORMALIZED = f"""
norm0 AS (
  SELECT *, {app('raw_application')} AS application,
    CASE WHEN raw_url IS NOT NULL THEN {host('raw_url')} END AS domain,
    CASE WHEN raw_url IS NOT NULL THEN {template(path('raw_url'))} END AS route_template,
    {title('window_title')} AS title_pattern,
    {action('source_event_type', "split_part(source_event_type, '.', 2)")} AS action
  FROM activity),
norm1 AS (SELECT *, {pack_number('domain', 'route_template')} AS pack_no,
    {hint('target', 'route_template', 'title_pattern')} AS own_hint FROM norm0),
normalized AS (
  SELECT stream_id, seq, ts, {TEXT} AS ts_text, source, source_event_type, application, domain,
    CASE WHEN raw_url IS NOT NULL THEN {scheme('raw_url')} || '://' || {host('raw_url')} || {path('raw_url')} END AS url,
    CASE WHEN raw_url IS NOT NULL THEN {canonical('raw_url')} END AS canonical_url,
    route_template, {pack_field('pack_no', 'id')} AS domain_pack_id,
    {pack_field('pack_no', 'family')} AS route_family,
    {pack_field('pack_no', 'source')} AS domain_pack_source,
    coalesce({pack_field('pack_no', 'page_type')}, {page_type('domain', 'route_template', 'title_pattern', 'own_hint')}) AS page_type,
    coalesce({pack_field('pack_no', 'hint')}, own_hint) AS resource_hint,
    title_pattern, action, target
  FROM norm1)"""

NEARBY = f"""
near0 AS (
  SELECT *, lag(struct_pack(t := ts, target := target, page_type := page_type, hint := resource_hint)) OVER w AS b,
    lead(struct_pack(t := ts, target := target, page_type := page_type, hint := resource_hint)) OVER w AS a
  FROM normalized WINDOW w AS (PARTITION BY stream_id, application, domain ORDER BY ts, seq)),
nearby AS (
  SELECT *, epoch_ms(ts) - epoch_ms(b.t) <= {45000 * S} AS has_b, epoch_ms(a.t) - epoch_ms(ts) <= {45000 * S} AS has_a
  FROM near0),
ctx AS (
  SELECT *, CASE WHEN has_b THEN b.target END AS b_target, CASE WHEN has_a THEN a.target END AS a_target,
    coalesce(page_type, CASE WHEN has_b THEN b.page_type END, CASE WHEN has_a THEN a.page_type END) AS any_page_type,
    coalesce(resource_hint, CASE WHEN has_b THEN b.hint END, CASE WHEN has_a THEN a.hint END) AS any_hint
  FROM nearby)"""

LABELLED = f"""
lab0 AS (
  SELECT *, lower(coalesce(target, '')) AS own_target,
    CASE WHEN coalesce(target, '') <> '' THEN lower(target)
         ELSE lower(concat_ws(' ', b_target, a_target)) END AS any_target,
    {identifier('coalesce(target, b_target, a_target)')} AS target_key
  FROM ctx),
lab1 AS (SELECT *, {rule_number()} AS rule_no FROM lab0),
lab2 AS (
  SELECT *, CASE WHEN rule_no IS NOT NULL THEN 'rule' WHEN {meaningful('target_key')} THEN 'target_inference'
    WHEN any_page_type IS NOT NULL THEN 'page_type_inference'
    WHEN action = 'application_switch' THEN 'application_switch_inference'
    WHEN action = 'file_download' THEN 'file_download_inference'
    WHEN any_hint IS NOT NULL THEN 'resource_hint_inference' ELSE 'none' END AS how
  FROM lab1),
labelled AS (
  SELECT *, CASE how WHEN 'rule' THEN {rule_field('rule_no', 'action')}
      WHEN 'target_inference' THEN target_key
      WHEN 'page_type_inference' THEN {from_page_type('any_page_type', 'any_hint')}
      WHEN 'application_switch_inference' THEN 'switch_to_' || {identifier('application')}
      WHEN 'file_download_inference' THEN 'export_file'
      WHEN 'resource_hint_inference' THEN {identifier('action')} || '_' || {identifier('any_hint')}
      ELSE 'unknown_action' END AS action_name,
    CASE how WHEN 'rule' THEN {rule_field('rule_no', 'confidence')} WHEN 'target_inference' THEN 0.74
      WHEN 'page_type_inference' THEN 0.69 WHEN 'application_switch_inference' THEN 0.62
      WHEN 'file_download_inference' THEN 0.67 WHEN 'resource_hint_inference' THEN 0.58 ELSE 0.2 END::DOUBLE AS action_confidence,
    CASE WHEN how = 'rule' THEN 'rule' ELSE 'inferred' END AS action_source,
    CASE how WHEN 'rule' THEN {rule_field('rule_no', 'layer')} WHEN 'page_type_inference' THEN 'page_type'
      WHEN 'none' THEN 'unknown' ELSE 'generic' END AS layer,
    CASE WHEN how = 'rule' THEN {rule_field('rule_no', 'pack')} END AS pack_id,
    CASE WHEN how = 'rule' THEN {rule_field('rule_no', 'rule')} END AS rule_id,
    CASE WHEN how NOT IN ('rule', 'none') THEN how END AS strategy
  FROM lab2)"""


def _differs(f: str) -> str:
    return f"coalesce(p.{f} <> '' AND {f} <> '' AND p.{f} <> {f}, false)"


SHIFT = "regexp_matches(action_name, '^(open|search|edit|review|update)_')"
RESET = "regexp_matches(action_name, '^(open|search|edit|review|update|verify)_')"

MARKED = f"""
mk0 AS (
  SELECT *, row_number() OVER w AS idx,
    lag(struct_pack(ts := ts, application := application, domain := domain, route_family := route_family,
        page_type := page_type, resource_hint := resource_hint, action_name := action_name)) OVER w AS p
  FROM labelled WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq)),
mk1 AS (
  SELECT *, epoch_ms(ts) - epoch_ms(p.ts) AS gap_ms,
    CASE WHEN p IS NULL THEN NULL ELSE list_filter([
      CASE WHEN p.application IS DISTINCT FROM application THEN 'application' END,
      CASE WHEN {_differs('domain')} THEN 'domain' END,
      CASE WHEN {_differs('route_family')} THEN 'route_family' END,
      CASE WHEN {_differs('page_type')} THEN 'page_type' END,
      CASE WHEN {_differs('resource_hint')} THEN 'resource_hint' END,
      CASE WHEN p.action_name <> action_name AND {SHIFT} THEN 'action_reset' END
    ], lambda f: f IS NOT NULL) END AS changed
  FROM mk0),
mk2 AS (SELECT *, coalesce(len(changed), 0) AS score FROM mk1),
mk3 AS (
  SELECT *, CASE WHEN p IS NULL THEN 'stream_start'
    WHEN gap_ms > {150000 * S} THEN CASE WHEN score >= 2 THEN 'idle_and_context_shift' ELSE 'idle_gap' END END AS hard_reason,
    CASE WHEN gap_ms > {75000 * S} AND score >= 2 THEN 'context_shift'
      WHEN gap_ms > {60000 * S} AND score > 0 AND {RESET} AND p.action_name <> action_name THEN 'reset_after_interruption' END AS maybe_soft
  FROM mk2),
marked AS (SELECT *, CASE WHEN hard_reason IS NULL THEN maybe_soft END AS soft_reason FROM mk3)"""

# Sessions: a walk over each stream that knows where the current session began.
WALKED = f"""
near_events AS (
  SELECT c.stream_id, c.idx, list(struct_pack(i := o.idx, a := (o.application = c.application)::INT,
      d := coalesce(o.domain <> '' AND o.domain = c.domain, false)::INT,
      r := coalesce(o.route_family <> '' AND o.route_family = c.route_family, false)::INT)) AS seen
  FROM marked c JOIN marked o ON o.stream_id = c.stream_id AND o.idx < c.idx
    AND epoch_ms(c.ts) - epoch_ms(o.ts) <= {300000 * S}
  WHERE c.soft_reason IS NOT NULL GROUP BY c.stream_id, c.idx),
prep AS (SELECT m.stream_id, m.idx, m.hard_reason, m.soft_reason, coalesce(x.seen, []) AS seen
  FROM marked m LEFT JOIN near_events x ON x.stream_id = m.stream_id AND x.idx = m.idx),
walk AS (
  SELECT stream_id, idx, idx AS start_idx FROM prep WHERE idx = 1
  UNION ALL
  SELECT q.stream_id, q.idx, CASE WHEN q.hard_reason IS NOT NULL THEN q.idx WHEN q.soft_reason IS NULL THEN w.start_idx
    WHEN len(list_filter(q.seen, lambda s: s.i >= w.start_idx)) >= 3
      AND list_sum(list_transform(list_filter(q.seen, lambda s: s.i >= w.start_idx), lambda s: s.a))
          / len(list_filter(q.seen, lambda s: s.i >= w.start_idx)) >= 0.6
      AND greatest(list_sum(list_transform(list_filter(q.seen, lambda s: s.i >= w.start_idx), lambda s: s.d)),
                   list_sum(list_transform(list_filter(q.seen, lambda s: s.i >= w.start_idx), lambda s: s.r)))
          / len(list_filter(q.seen, lambda s: s.i >= w.start_idx)) >= 0.6
    THEN w.start_idx ELSE q.idx END
  FROM walk w JOIN prep q ON q.stream_id = w.stream_id AND q.idx = w.idx + 1),
placed AS (
  SELECT m.*, w.start_idx, first_value(m.seq) OVER (PARTITION BY m.stream_id, w.start_idx ORDER BY m.idx) AS session_seq,
    CASE WHEN w.start_idx = m.idx THEN coalesce(m.hard_reason, m.soft_reason) END AS boundary_reason
  FROM marked m JOIN walk w ON w.stream_id = m.stream_id AND w.idx = m.idx)"""

SESSIONS = """
app_count AS (SELECT stream_id, session_seq, application, COUNT(*) AS c, MIN(idx) AS f FROM placed GROUP BY ALL),
dom_count AS (SELECT stream_id, session_seq, domain, COUNT(*) AS c, MIN(idx) AS f FROM placed WHERE domain IS NOT NULL GROUP BY ALL),
app_pick AS (SELECT stream_id, session_seq, arg_min(application, c * -1000000 + f) AS primary_application,
  list(application ORDER BY f) AS applications FROM app_count GROUP BY ALL),
dom_pick AS (SELECT stream_id, session_seq, arg_min(domain, c * -1000000 + f) AS primary_domain,
  list(domain ORDER BY f) AS domains FROM dom_count GROUP BY ALL),
runs AS (SELECT *, application || '|' || action_name AS token,
  lag(application || '|' || action_name) OVER w AS prev_token, lag(action_name) OVER w AS prev_action
  FROM placed WINDOW w AS (PARTITION BY stream_id, session_seq ORDER BY idx)),
seqs AS (SELECT stream_id, session_seq,
  list(token ORDER BY idx) FILTER (WHERE prev_token IS NULL OR prev_token <> token) AS tokens,
  list(action_name ORDER BY idx) FILTER (WHERE prev_action IS NULL OR prev_action <> action_name) AS actions
  FROM runs GROUP BY ALL),
ses0 AS (SELECT stream_id, session_seq, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS step_count,
  MAX(boundary_reason) AS boundary_reason FROM placed GROUP BY ALL),
sessions AS (
  SELECT s.*, strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS start_time, strftime(end_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS end_time,
    a.primary_application, a.applications, d.primary_domain, coalesce(d.domains, []) AS domains, q.tokens, q.actions,
    list_sort(list_distinct(q.actions)) AS action_set,
    CASE WHEN d.domains IS NOT NULL THEN list_sort(list_transform(d.domains, lambda x: 'domain:' || x))
         ELSE list_sort(list_transform(a.applications, lambda x: 'app:' || x)) END AS contexts,
    (epoch_ms(end_ts) - epoch_ms(start_ts)) / 1000 AS duration_seconds,
    hour(start_ts) * 60 + minute(start_ts) AS start_minute
  FROM ses0 s JOIN app_pick a USING (stream_id, session_seq) LEFT JOIN dom_pick d USING (stream_id, session_seq)
  JOIN seqs q USING (stream_id, session_seq)),
described AS (SELECT *, sha1('workflow_signature:' || array_to_string(actions, '>') || '||' || array_to_string(contexts, '>')) AS workflow_signature
  FROM sessions)"""

GROUPS = f"""
grp0 AS (SELECT * FROM described WHERE duration_seconds >= {45 * S}),
grouped AS (SELECT *, MIN(session_seq) OVER (PARTITION BY workflow_signature) AS cluster_seq FROM grp0)"""

LEVELS = [ACTIVITY, NORMALIZED, NEARBY, LABELLED, MARKED, WALKED, SESSIONS, GROUPS]
NAMES = ["activity", "normalized", "ctx", "labelled", "marked", "placed", "described", "grouped"]


def upto(level: str, select: str, extra: str = "") -> str:
    """A statement over everything derived up to a level."""
    used = LEVELS[: NAMES.index(level) + 1]
    more = [extra] if extra else []
    head = "WITH RECURSIVE" if "placed" in NAMES[: NAMES.index(level) + 1] else "WITH"
    return head + ",".join(used + more) + "\n" + select
