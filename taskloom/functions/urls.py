"""URL canonicalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import UrlOptions
from ..rules.vocabulary import UUID_BODY
from .text import WHITESPACE, blank_to_null, has_text

# scheme, host, port, path, query, fragment
URL_PATTERN = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*):(//)?(?:(?<=//)(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)"
    r"(?::([0-9]*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
)
WEB_SCHEMES = ["http", "https", "ws", "wss", "ftp"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
BAD_HOST = r"[\s<>^|%\\]"
PLAIN_PATH_CHAR = r"[\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"
ENCODED_PATH = rf"^{PLAIN_PATH_CHAR}*$"

UUID_SEGMENT = f"(?i)^{UUID_BODY}$"
LONG_HEX_SEGMENT = "(?i)^[0-9a-f]{12,}$"


def _encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(path, F.lit("(?s)(.)"), F.lit(1)),
            lambda c: F.when(c.rlike(PLAIN_PATH_CHAR), c).otherwise(
                F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )
    return F.when(path.rlike(ENCODED_PATH), path).otherwise(encoded)


def _resolve_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments; a trailing one leaves a trailing slash."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(p == ".", acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.concat(
        F.lit("/"),
        F.array_join(kept, "/"),
        F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")),
    )
    return F.when(path.contains("/."), joined).otherwise(path)


SEPARATOR = "\u0001"
# All parts in one pass of the pattern, joined by a character no URL contains.
PARTS = SEPARATOR.join(f"${i}" for i in range(1, 8))


def parse_url(url: Column) -> Column:
    """ARRAY(scheme, slashes, host, port, path, query, fragment), NULL if not a URL."""
    text = F.trim(url, F.lit(WHITESPACE))
    parts = F.split(F.regexp_replace(text, URL_PATTERN, PARTS), SEPARATOR)
    scheme, slashes, host = F.lower(F.get(parts, 0)), F.get(parts, 1), F.get(parts, 2)
    valid = (F.size(parts) == 7) & F.when(
        scheme.isin(WEB_SCHEMES), (slashes == "//") & (host != "") & ~host.rlike(BAD_HOST)
    ).otherwise(F.lit(True))
    return F.when(valid, parts)


def url_fields(parts: Column) -> Column:
    """STRUCT(protocol, host, origin, path, query, fragment) of a parsed URL."""
    scheme, slashes = F.lower(F.get(parts, 0)), F.get(parts, 1)
    host = F.lower(F.get(parts, 2))
    port = F.get(parts, 3)
    shown_port = F.when(port == "", F.lit("")).when(
        F.concat_ws(":", scheme, port).isin([f"{k}:{v}" for k, v in DEFAULT_PORTS.items()]),
        F.lit(""),
    ).otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", "")))
    raw_path = F.get(parts, 4)
    path = F.when(
        (raw_path == "") & scheme.isin(WEB_SCHEMES), F.lit("/")
    ).otherwise(_encode_path(raw_path))
    return F.struct(
        F.concat(scheme, F.lit(":")).alias("protocol"),
        host.alias("host"),
        F.concat(scheme, F.lit(":"), slashes, host, shown_port).alias("origin"),
        F.when(slashes == "//", _resolve_dots(path)).otherwise(path).alias("path"),
        F.get(parts, 5).alias("query"),
        F.get(parts, 6).alias("fragment"),
    )


END = "(?=/|$)"
# An identifier-like segment: digits, long hex, a long opaque word, or a long last word.
ID_SEGMENT = (
    "(?<=/)(?:[0-9]+|[0-9a-fA-F]{12,}"
    "|(?=[A-Za-z0-9_-]{16,}(?:/|$))(?:(?=[^/]*[0-9])|(?=[^/]*[a-z])(?=[^/]*[A-Z]))[^/]+"
    f"|(?:[^/]*[-_])?[A-Za-z0-9]{{16,}}[-_]*){END}"
)
UUID_IN_PATH = f"(?i)(?<=/){UUID_BODY}{END}"


def tidy_path(path: Column) -> Column:
    """One slash between segments, none at the end, one at the start."""
    tidy = F.concat(
        F.lit("/"), F.trim(F.regexp_replace(path, "/{2,}", "/"), F.lit("/"))
    )
    return F.when(path.rlike("^(?:/[^/]+)+$"), path).otherwise(tidy)


def route_template(path: Column) -> Column:
    """The path with identifiers replaced by slots, lower-cased."""
    slotted = F.regexp_replace(tidy_path(path), UUID_IN_PATH, "{uuid}")
    return F.lower(F.regexp_replace(slotted, ID_SEGMENT, "{id}"))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def as_path(segments: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segments, "/"))


def strip_query(parsed: Column) -> Column:
    return F.concat(parsed["origin"], parsed["path"])


def kept_query(query: Column, options: UrlOptions) -> Column:
    """Allow-listed parameters with harmless values, sorted by key and value."""
    keys = [k.lower() for k in options.allowed_query_keys]

    def decode(text: Column) -> Column:
        plain = F.replace(text, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(text), plain)

    def pair(p: Column) -> Column:
        key = F.lower(decode(F.regexp_extract(p, "^([^=]*)", 1)))
        value = F.trim(decode(F.regexp_extract(p, "^[^=]*=(?s)(.*)$", 1)), F.lit(WHITESPACE))
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.filter(
        F.transform(F.split(query, "&"), pair),
        lambda p: p["key"].isin(keys) & p["value"].rlike("(?i)^[a-z0-9._:-]{1,64}$"),
    )
    kept = F.array_join(
        F.transform(
            F.array_sort(pairs),
            lambda p: F.concat(
                p["key"], F.lit("="), F.replace(p["value"], F.lit(":"), F.lit("%3A"))
            ),
        ),
        "&",
    )
    # Most queries hold no such key at all and skip the parsing.
    possible = query.rlike(f"(?i)(?:^|&)(?:{'|'.join(keys)})=|%")
    return F.when(possible, kept).otherwise(F.lit(""))


def sanitized_url(parsed: Column, options: UrlOptions) -> Column:
    query = kept_query(parsed["query"], options)
    return F.concat(
        strip_query(parsed),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def canonical_url(parsed: Column, template: Column, options: UrlOptions) -> Column:
    head = F.substring_index(template, "/", options.canonical_path_depth + 1)
    return F.concat(parsed["protocol"], F.lit("//"), parsed["host"], head)


HASHED_SEGMENT = f"(?i)^(.*/)({UUID_BODY}|[0-9a-f]{{12,}})(?:/.*)?$"


def resource_hash(parsed: Column, template: Column) -> Column:
    """Hash of the last UUID or long-hex segment, seeded with its place; else NULL."""
    path = tidy_path(parsed["path"])
    before = F.regexp_extract(path, HASHED_SEGMENT, 1)
    place = F.length(before) - F.length(F.replace(before, F.lit("/"), F.lit("")))
    seed = F.concat_ws(
        ":",
        parsed["host"],
        F.array_join(F.slice(F.split(template, "/"), F.lit(1), place + 1), "/"),
        F.lower(F.regexp_extract(path, HASHED_SEGMENT, 2)),
    )
    return F.when(path.rlike(HASHED_SEGMENT), F.substring(F.sha2(seed, 256), 1, 16))


def canonical_fields(df, options: UrlOptions, has_context: Column):
    """Add ``canonical``: the browser fields of a row, from its URL or as supplied."""
    parsed, template = F.col("_parsed"), F.col("_template")
    is_url = F.col("_parts").isNotNull()
    canonical = canonical_url(parsed, template, options)
    fallback_url = F.regexp_extract(blank_to_null(F.col("canonical_url")), "^([^?#]*)", 1)
    supplied = blank_to_null(F.col("route_template"))
    supplied_hash = F.lower(blank_to_null(F.col("resource_hash")))
    stamped = (
        is_url
        | F.coalesce(has_context, F.lit(False))
        | has_text(F.col("canonical_url"))
        | has_text(F.col("route_template"))
        | has_text(F.col("route_key"))
    )
    return (
        df.withColumn("_parts", parse_url(F.col("url")))
        .withColumn("_parsed", F.when(is_url, url_fields(F.col("_parts"))))
        .withColumn("_template", route_template(parsed["path"]))
        .withColumn(
            "canonical",
            F.struct(
                F.when(stamped, F.lit(options.schema_version)).alias("browser_schema_version"),
                F.when(is_url, parsed["host"])
                .otherwise(F.lower(blank_to_null(F.col("domain"))))
                .alias("domain"),
                F.when(is_url, sanitized_url(parsed, options)).alias("url"),
                F.when(is_url, strip_query(parsed)).alias("stripped_url"),
                F.when(is_url, canonical).otherwise(fallback_url).alias("canonical_url"),
                F.when(is_url, template)
                .otherwise(F.when(supplied.startswith("/"), supplied))
                .alias("route_template"),
                F.when(is_url, canonical)
                .otherwise(blank_to_null(F.col("route_key")))
                .alias("route_key"),
                F.when(is_url, resource_hash(parsed, template))
                .otherwise(F.when(supplied_hash.rlike("^[0-9a-f]{8,64}$"), supplied_hash))
                .alias("resource_hash"),
            ),
        )
        .drop("_parts", "_parsed", "_template")
    )


def _looks_opaque(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{16,}$") & (
        value.rlike("[0-9]")
        | (value.rlike("[a-z]") & value.rlike("[A-Z]"))
        | ~value.rlike("[-_]")
    )


def segment_slot(segment: Column) -> Column:
    """``{id}`` / ``{uuid}`` for one identifier-like segment, else NULL."""
    return (
        F.when(segment.rlike("^[0-9]+$"), F.lit("{id}"))
        .when(segment.rlike(UUID_SEGMENT), F.lit("{uuid}"))
        .when(
            segment.rlike(LONG_HEX_SEGMENT)
            | _looks_opaque(segment)
            | segment.rlike("(?:^|[-_])[A-Za-z0-9]{16,}[-_]*$"),
            F.lit("{id}"),
        )
    )


def with_route_taxonomy(pages):
    """Add ``route_taxonomy``: facts of the ``#`` route if a page has one, else of its path."""
    parts, parsed = F.col("_parts"), F.col("_parsed")
    route = F.regexp_extract(parsed["fragment"], "^!?([^?]*)", 1)
    rooted = F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route))

    def normalize(raw: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
        s = F.trim(decoded, F.lit(WHITESPACE))
        word = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))
        return F.coalesce(segment_slot(s), F.nullif(word, F.lit("")), F.lit("segment"))

    segments, source = F.col("_segments"), F.col("_source")
    facts = F.struct(
        source.alias("source"),
        F.concat(source, F.lit(":"), as_path(segments)).alias("signature"),
        as_path(segments).alias("route_template"),
        F.size(segments).cast("long").alias("depth"),
        F.get(segments, 0).alias("primary_section"),
        F.get(segments, 1).alias("secondary_section"),
        F.try_element_at(segments, F.lit(-1)).alias("leaf_section"),
        F.size(F.filter(segments, lambda s: s.startswith("{")))
        .cast("long")
        .alias("dynamic_segment_count"),
    )
    return (
        pages.withColumn("_parts", parse_url(F.col("url")))
        .withColumn("_parsed", F.when(parts.isNotNull(), url_fields(parts)))
        .withColumns(
            {
                "_source": F.when(route != "", F.lit("hash")).otherwise(F.lit("pathname")),
                "_path": F.when(route != "", rooted).otherwise(parsed["path"]),
            }
        )
        .withColumn("_segments", F.transform(path_segments(F.col("_path")), normalize))
        .withColumn("route_taxonomy", F.when(parts.isNotNull(), facts))
        .drop("_parts", "_parsed", "_source", "_path", "_segments")
    )
