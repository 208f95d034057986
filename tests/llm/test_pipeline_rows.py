"""Stages drop rows, not identifiers."""

import random

import corpus_pipeline
import pytest

CLEAN = "The river of the north runs by the old house and the green lamp under the seven stones of the town."


def placed(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0]))


@pytest.mark.parametrize("shared", [None, 5])
def test_rows_of_one_identifier_are_judged_one_by_one(spark, sf_dir, shared):
    stages = dict(corpus_pipeline.STAGES)

    def kept(stage, *rows):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        out = stages[stage](spark, docs, sf_dir)
        assert out.columns == docs.columns
        return placed((r.doc_id, r.text) for r in out.collect())

    trained = [(d, CLEAN) for d in range(100, 120)]
    assert kept("language_id", *trained, (shared, "123 !!"), (shared, CLEAN)) == placed([*trained, (shared, CLEAN)])
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 10)
    assert kept("benchmark_decontamination", (shared, item), (shared, CLEAN)) == [(shared, CLEAN)]
    random.seed(5)
    words = [f"w{random.randrange(1000)}" for _ in range(100)]
    near = " ".join([*words, "more"])
    assert kept("ngram_jaccard_join", (3, " ".join(words)), (shared, near), (shared, CLEAN)) == placed([(3, " ".join(words)), (shared, CLEAN)])


def test_columns_with_names_of_results_are_kept(spark, sf_dir):
    text = "The river of the north runs by the old house and the green lamp under the seven stones of the town."
    rows = [(1, text, "en", "s", 10, "mine", 5, "k", True), (2, text, "en", "s", 10, "yours", 6, "l", False), (3, text + " more", "en", "s", 10, "z", 7, "m", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, keep_id int, _key string, rest boolean")
    want = {"language_id": rows, "exact_dedup": [rows[0], rows[2]], "ngram_jaccard_join": rows[:1], "benchmark_decontamination": rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema["kept"].dataType == docs.schema["kept"].dataType, name
        assert sorted(map(tuple, out.collect())) == want[name], name


def test_rows_that_share_an_identifier_with_their_near_copy(spark, sf_dir):
    words = [f"w{i * 7919 % 1009}" for i in range(120)]
    base = " ".join(words)
    rows = [(4, base, "en", "s", 1), (4, base + " tail", "en", "s", 1), (None, base + " end", "en", "s", 1), (None, "other words that nobody has", "en", "s", 1), (9, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, sf_dir).collect()
    assert len(out) == 3 and {r.doc_id for r in out} == {4, None, 9} and sum(r.doc_id == 4 for r in out) == 1
