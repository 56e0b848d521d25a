"""A training corpus from raw documents, in five stages that each keep, drop or change documents.

Every stage works on all that the one before kept. Results are written as Parquet and read again, so a stage can be
repeated without the ones before it.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from taskloom.llm.decontamination import drop_contaminated  # noqa: E402
from taskloom.llm.language import UNKNOWN, fit_languages, held_out, identify_languages  # noqa: E402
from taskloom.llm.near_duplicates import drop_near_duplicates  # noqa: E402
from taskloom.llm.packing import pack_documents  # noqa: E402
from taskloom.llm.pretokens import vocabulary_path  # noqa: E402
from taskloom.llm.queries import END_ID, VOCABULARY  # noqa: E402
from taskloom.llm.secret_scan import redact_secrets  # noqa: E402
from taskloom.plans.materialize import scratch_dir  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` becomes the identified one. Texts without letters go."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify_languages(docs.select(*COLUMNS), fit_languages(known))
    clear = found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return clear.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers or names."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind of secret; ``n_chars`` follows the text."""
    cleaned = redact_secrets(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of at most 4096, one row per piece."""
    return pack_documents(docs, vocabulary_path(VOCABULARY), END_ID)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("secret_scan", redact),
    ("packing", pack),
]

# Learned languages, similarity graphs, checksums and tokenizers are beyond SQL. tests/llm plants a case for each stage and
# counts run()'s tokens with the library; there is no plain-Python version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
