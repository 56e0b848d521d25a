import corpus_pipeline
import pytest
from taskloom.llm.pretokens import vocabulary_path

from .conftest import EDGES, documents_frame
from .test_judging import QUESTION, text_in


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(100 + i, text_in(lang, 30 + i, i), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    copies = [(500 + i, rows[i][1], rows[i][2], "s") for i in range(5)]
    leaks = [(600, f"{text_in('aa', 40, 1000)} {QUESTION}", "aa", "s")]
    secrets = [(700, f'{text_in("bb", 40, 2000)} token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "bb", "s")]
    frame = documents_frame(spark, rows + copies + leaks + secrets + [(*e, None, None) for e in EDGES], extra=False)
    frame.selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        held.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "secret_scan":
            text = docs.filter("doc_id = 700").first()
            assert "[assign]" in text.text and "24be" not in text.text and text.n_chars == len(text.text)
    language, near, clean, _, packed = held
    assert not language & {1, 2, 3} and language >= {*range(100, 190), 6, 7, 600, 700}
    assert not near & {500, 501, 502, 503, 504, 7} and near >= set(range(100, 190))
    assert clean == near - {600}
    assert packed == clean


def test_run_equals_the_stages(spark, folder):
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r.length for r in rows) == want
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_empty_corpus(spark, tmp_path):
    documents_frame(spark, [], extra=False).selectExpr("*", "0L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
