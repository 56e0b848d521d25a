"""One registered query per operator, over the whole supplied tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_contamination
from .line_dedup import drop_repeated_lines
from .hard_negatives import mine_hard_negatives
from .language import fit_languages, held_out, identify_languages
from .near_duplicates import link_documents
from .outliers import judge_quality
from .packing import pack_documents
from .phrase_dedup import remove_repeated_passages
from .pretokens import vocabulary_path
from .quotations import link_quotations
from .secret_scan import BASE_KINDS, scan_secrets
from .token_counts import count_tokens
from .vector_codes import code_text, compress_vectors, digest, with_label_errors
from .weak_labels import classify_quality

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
TOKEN_LIMIT = 2048


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")

    def listed(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(one, ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir), vocabulary_path(VOCABULARY), END_ID)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_length",
    )


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked.withColumn("reply_path", F.array_join(F.transform("reply_path", lambda t: t.cast("string")), "."))


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_passages(documents(spark, sf_dir))
    return cleaned.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), vocabulary_path(VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(documents(spark, sf_dir), shingle=4, percent=80)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    known = rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify_languages(rows.select("doc_id", "text"), fit_languages(known))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds; clean documents have none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(documents(spark, sf_dir), benchmark)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
    return found.drop("positive_rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(codes).select(
        "vec_id",
        code_text().alias("code"),
        "error",
        "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_phrase_dedup": op4_phrase_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}

# Positions come from the texts between matches. Values with a checksum are beyond SQL: ``spans``
# equals the base spans where a text has none of those, as in the given tables.
OP1_SQL = r"""
WITH kinds(kind, rank, pattern, least) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 1, '()(AKIA[A-Z0-9]+)', 20),
  ('hex', 2, '()([0-9a-f]+)', 24)),
cut AS (
  SELECT doc_id, kind, rank, least, regexp_extract_all(coalesce(text, ''), pattern) AS whole,
         regexp_extract_all(coalesce(text, ''), pattern, 2) AS value,
         string_split_regex(coalesce(text, ''), pattern) AS between
  FROM documents, kinds),
each AS (
  SELECT doc_id, kind, rank, unnest(list_transform(range(1, len(whole) + 1), lambda i: {
    'start': coalesce(list_sum(list_transform(between[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0),
    'size': length(whole[i]), 'ok': length(value[i]) >= least})) AS m
  FROM cut),
kept AS (
  SELECT doc_id, kind, rank, m.start AS start, concat(kind, ':', m.start::BIGINT, ':', (m.start + m.size)::BIGINT) AS span
  FROM each WHERE m.ok),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS content
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
owners AS (SELECT content, min(doc_id) AS owner FROM windows GROUP BY content),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q
  FROM windows JOIN owners USING (content) WHERE owner < doc_id),
gaps AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(qs, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gaps USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM smallest LEFT JOIN n USING (doc_id)
"""

OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _op12_sql() -> str:
    """Six rounds and the last assignment, each a step of one statement."""
    distance = " + ".join(f"(x[{i}] - y[{i}]) * (x[{i}] - y[{i}])" for i in range(1, 9))
    steps = []
    for k in range(7):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, label, part, x, min({{'d': {distance}, 'e': e}}) AS best
  FROM pieces JOIN book{k} USING (part) GROUP BY ALL)""")
        if k < 6:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT part, e, coalesce(mean, y) AS y FROM book{k} LEFT JOIN (
    SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM (
      SELECT part, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n
      FROM near{k}, range(1, 9) AS r(i) GROUP BY ALL) GROUP BY part, e) USING (part, e))""")
    return f"""
WITH vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT vec_id, label, part, v[8 * part + 1:8 * part + 8] AS x FROM vectors, range(8) AS r(part)),
book0 AS MATERIALIZED (
  SELECT part, e, x AS y FROM (
    SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM pieces) WHERE e < 16),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM near6 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) FROM book6) AS codebooks_sha256
FROM coded
"""


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
common AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

ORACLES = {"op1_secret_scan": OP1_SQL, "op4_phrase_dedup": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_line_dedup": OP13_SQL}
