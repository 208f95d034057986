"""Hot tokens of sets whose key is a multiple of the number of salts."""

import by_definition
from ledgerloom.llm import ngram_join


def test_hot_tokens_of_the_least_salt_are_kept(spark):
    words = [f"w{i}" for i in range(40)]
    texts = (" ".join([*words, f"x{i}"]) for i in range(1 << 20))
    batch = []
    for text in texts:
        batch.append(text)
        if len(batch) == 4096:
            keys = [ngram_join.set_key(g) % ngram_join.SALTS for g in ngram_join.shingle_sets(batch, 3)]
            if 0 in keys:
                break
            batch = []
    rows = [(1, " ".join([*words, "other"])), (2, batch[keys.index(0)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_documents(docs, 3, 90, sketch_bits=16, most_group=1)
    assert sorted(map(tuple, got.collect())) == sorted(by_definition.similar_classes(rows, 3, 90)) == [(1, 39, 1), (2, 39, 1)]
