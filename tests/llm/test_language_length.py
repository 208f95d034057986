"""Language identification of texts of any length."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    tools = language_id.Compressors(language_id.language_dictionaries(docs.where(~language_id.held_out())))
    return tools, {r.lang: r.text for r in docs.where(language_id.held_out()).groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).collect()}


@pytest.mark.parametrize("size", [1 << 20, 5 << 20])
def test_long_clean_texts_are_told(learned, size):
    tools, texts = learned
    for lang, text in texts.items():
        told, lead, rejected = language_id.decide(tools.sizes((text * (size // len(text) + 1))[:size]), tools.languages, 0.002)
        assert told == lang and lead > 0.02 and not rejected


def test_every_sampled_text_has_its_share():
    found = language_id.equal_shares([b"a" * 10, b"b" * 1000, b"c" * 1000, b"d" * 500], 310)
    assert [found.count(x) for x in (b"a", b"b", b"c", b"d")] == [10, 100, 100, 100]
    assert language_id.equal_shares([b"ab", b"c"], 10) == b"abc" and language_id.equal_shares([], 10) == b""


def test_samples_reach_into_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "a" * 5000 + "b" * 5000, "xx")], "doc_id long, text string, lang string")
    assert b"b" in language_id.language_dictionaries(docs)["xx"]
