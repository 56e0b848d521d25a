"""Column helpers for text, identifiers and numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules.vocabulary import UUID_BODY

WHITESPACE = " \t\n\r\x0b\x0c\u00a0\ufeff\u2028\u2029\u3000"
# ASCII word edges, written out because Java's \b also knows other scripts.
NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c, F.lit(WHITESPACE)), F.lit(""))


def has_text(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def lookup(values: dict, c: Column, default: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), default)


def stable_id(namespace: str, *parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(namespace), *parts))


def opaque_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    """16 hex digits of the lower-cased trimmed text; NULL for blank text."""
    return F.substring(F.sha2(F.lower(blank_to_null(c)), 256), 1, 16)


def round_score(c: Column) -> Column:
    """Half-up rounding to two places on the binary value."""
    return F.floor(c * 100 + 0.5) / F.lit(100.0)


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatibility_form(c: Column) -> Column:
    """Unicode NFKC; only non-ASCII texts are sent for it."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _composed(F.when(other, c))).otherwise(c)


def identifier(c: Column) -> Column:
    """Lower case, NFKC, everything but letters and digits squeezed to ``_``."""
    lowered = compatibility_form(F.lower(F.trim(c, F.lit(WHITESPACE))))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def title_pattern(c: Column) -> Column:
    text = F.trim(F.nullif(c, F.lit("")), F.lit(WHITESPACE))
    text = F.regexp_replace(
        text, f"(?i){NOT_AFTER_WORD}{UUID_BODY}{NOT_BEFORE_WORD}", "{uuid}"
    )
    text = F.regexp_replace(text, "#[0-9]+", "#{id}")
    text = F.regexp_replace(
        text, f"{NOT_AFTER_WORD}[0-9]{{2,}}{NOT_BEFORE_WORD}", "{id}"
    )
    return F.regexp_replace(text, r"\s+", " ")


def capitalize_words(c: Column) -> Column:
    """Upper-case the first character of every ASCII word, keep the rest."""
    pieces = F.split(c, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.array_join(
        F.transform(
            pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
        ),
        "",
    )


def humanize(c: Column) -> Column:
    """``edit_product`` -> ``Edit Product``; NULL for missing or empty text."""
    text = F.regexp_replace(F.nullif(c, F.lit("")), "^https?://", "")
    text = F.regexp_replace(text, "[._-]+", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(WHITESPACE))
    return capitalize_words(text)


def humanize_node(c: Column) -> Column:
    """The graph variant: no scheme stripping, inner blanks are kept."""
    text = F.trim(F.regexp_replace(c, "[._-]+", " "), F.lit(WHITESPACE))
    return capitalize_words(text)


def compact_runs(values: Column) -> Column:
    """Drop entries equal to their predecessor."""
    return F.filter(
        values,
        lambda x, i: (i == 0) | (x != F.get(values, i - 1)),
    )


def canonical_timestamp(text: Column) -> Column:
    """ISO text with any offset -> UTC milliseconds text; other text is kept."""
    return F.coalesce(iso_utc(F.try_to_timestamp(text)), text)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds + 0.5)
    minutes = F.floor(whole / 60)
    rest = (whole % 60).cast("string")
    return F.when(minutes == 0, F.concat(rest, F.lit("s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m "), rest, F.lit("s"))
    )


def savings_text(seconds: Column) -> Column:
    total = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("long")
    hours, minutes = F.floor(total / 60).cast("string"), (total % 60).cast("string")
    return F.concat(
        F.lit("about "),
        F.when(total < 60, F.concat(minutes, F.lit("m")))
        .when(total % 60 == 0, F.concat(hours, F.lit("h")))
        .otherwise(F.concat(hours, F.lit("h "), minutes, F.lit("m"))),
        F.lit(" per similar week"),
    )
