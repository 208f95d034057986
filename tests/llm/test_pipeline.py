"""The pipeline, stage by stage, against plain Python."""

import re

import by_definition
import corpus_pipeline
from ledgerloom.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from ledgerloom.llm.tokens import Encoder


def test_stages_equal_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    expected = {r.doc_id: r.text for r in docs.collect()}

    tools = language_id.Compressors(language_id.language_dictionaries(docs.where(~language_id.held_out())))
    told = {d: t for d, t in expected.items() if t and any(map(str.isalpha, t)) and not language_id.decide(tools.sizes(t), tools.languages, 0.002)[2]}

    first: dict[str, int] = {}
    for d in sorted(told):
        first.setdefault(re.sub(exact_dedup.SPACE_RUN, " ", told[d]), d)
    single = {d: told[d] for d in first.values()}

    heads = {d for d, _, least in by_definition.similar_classes(list(single.items()), 5, 80) if d == least}
    different = {d: t for d, t in single.items() if d in heads}

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in by_definition.contamination(list(different.items()), items) if not r[5]}

    wanted = [told, single, different, {d: different[d] for d in clean}]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns, name
        assert {r.doc_id: r.text for r in docs.collect()} == want, name

    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    encoder = Encoder()
    lengths = {d: packing.cut_lengths(len(encoder.encode([t])[0]) + 1, 2048) for d, t in wanted[-1].items()}
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted((d, i, n) for d, own in lengths.items() for i, n in enumerate(own))
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_stages_on_odd_documents(spark, sf_dir):
    rows = [(1, "The river of the north.", "en", "s", 10), (1, "The river of the north.", "en", "s", 10), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "A walk by the river and the house", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.count() <= len(rows), name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)
