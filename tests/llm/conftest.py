import pytest
from pyspark.sql import types as T

# Names that operators use inside themselves, as extra columns of the input.
CLASHES = ["node", "root", "key", "row", "text_hash", "spans", "n_words", "lang_pred", "score", "kept", "block", "shard", "_text", "body"]


def documents_frame(spark, rows, extra=True):
    """Rows (doc_id, text[, lang, source]) as a documents table with clashing columns."""
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType())]
    full = [tuple(r) + ("en", "src0")[len(r) - 2 :] if len(r) < 4 else tuple(r) for r in rows]
    if extra:
        fields += [(c, T.StringType()) for c in CLASHES]
        full = [r + tuple(f"{c} of row" for c in CLASHES) for r in full]
    return spark.createDataFrame(full, T.StructType([T.StructField(n, t) for n, t in fields]))


LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))

EDGES = [
    (1, None),
    (2, ""),
    (3, " \n\t \x0b\x0c\r "),
    (4, "one"),
    (5, "Straße été\x85naïve 日本語 ΑΣ İstanbul ﬁn"),
    (6, LONG),
    (7, LONG),
    (7, LONG),
    (None, "a row without an id but with words enough for anything that looks at thirteen words or more here"),
    (None, None),
    (8, "a row without an id but with words enough for anything that looks at thirteen words or more here"),
    (9, "x" * 200_000),
    (10, "same id first text with several words in it"),
    (10, "same id second text, quite another one than the first"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return documents_frame(spark, EDGES).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return documents_frame(spark, [])
