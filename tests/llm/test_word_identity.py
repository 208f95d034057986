"""Different words and sets must not pass for equal: strings that collide under polynomial hashes of any odd base."""

import by_definition
import numpy as np

from ledgerloom.llm import decontaminate, ngram_join
from ledgerloom.llm.common import Words, rolled


def thue_morse(bits):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(1 << bits))


PAIRS = [(x, x.translate(str.maketrans("ab", "ba"))) for x in map(thue_morse, (3, 7, 8, 10, 12))]


def test_hashes_of_such_words_differ():
    for kind in ("space", "ascii_alnum"):
        own = Words([x for pair in PAIRS for x in pair], kind).hashes
        assert len(set(own.tolist())) == 2 * len(PAIRS)
    rng = np.random.default_rng(0)
    letters = rng.integers(0, 1 << 63, 2).astype(np.uint64)
    sequences = [np.array([letters["ab".index(c)] for c in x], np.uint64) for x in PAIRS[-1]]
    assert rolled(sequences[0], len(sequences[0]))[0] != rolled(sequences[1], len(sequences[1]))[0]


def test_operators_tell_them_apart(spark):
    rows = [(i, x) for i, x in enumerate(x for pair in PAIRS for x in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.similar_documents(docs, 3, 90).collect())) == [(d, 1, d) for d, _ in rows]
    items = [("x", rows[0][1]), ("y", rows[-1][1])]
    report = decontaminate.contamination_report(decontaminate.find_contamination(docs, decontaminate.benchmark_phrases(spark.createDataFrame(items, "item_id string, text string"))))
    assert sorted(map(tuple, report.collect())) == by_definition.contamination(rows, items)


def test_equal_hashes_are_checked_by_words(spark, monkeypatch):
    """With hashes that are all equal, windows are still told apart."""
    monkeypatch.setattr("ledgerloom.llm.common.span_hashes", lambda buffer, starts, ends: np.full(len(starts), 7, np.uint64))
    phrases = decontaminate.benchmark_phrases(spark.createDataFrame([("x", "alpha beta"), ("y", "gamma delta")], "item_id string, text string"))
    assert len(phrases.words) == 2 and (phrases.symbols[0] == phrases.symbols[1]).all()
