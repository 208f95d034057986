"""URL filter cascades: lists as tables, hosts of very many labels, and what plans hold."""

from pyspark.sql import functions as F

from ledgerloom.llm import url_filter


def test_list_tables_and_very_long_hosts(spark):
    urls = [(1, "http://" + "a." * 20_000 + "bad.net/x"), (2, "http://bad.net"), (3, "http://notbad.net/"), (4, "http://a.very.bad.example.org/es/"), (5, "http://" + "/" * 50_000), (5, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    hosts = spark.createDataFrame([("bad.net",), ("bad.net",), (None,), ("unseen.com",)], "key string")
    got = {(r.page_id, r.verdict, r.rule) for r in url_filter.url_verdicts(pages, spark, blocked_hosts=hosts).collect()}
    assert got == {(1, "block", None), (2, "block", None), (3, "allow", None), (4, "block", "example.org/es/"), (5, "allow", None)}
    none = hosts.where("false")
    assert {r.verdict for r in url_filter.url_verdicts(pages, spark, rules=[], blocked_hosts=none).collect()} == {"allow"}


def test_cascade_of_a_long_list_is_exact_and_in_proportion(spark):
    universe = spark.range(60_000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 60_000, 61).selectExpr("concat('k', id) AS key")
    levels = url_filter.cascade(listed, universe)
    n = listed.count()
    assert sum(level.bits for level in levels) < 30 * n and len(levels) > 1
    found = universe.where(url_filter.is_listed(F.col("key"), levels))
    assert found.exceptAll(listed).isEmpty() and found.count() == n
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 100_000  # words are read, not written into the plan


def test_cascade_of_odd_lists(spark):
    universe = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    assert url_filter.cascade(universe.where("false"), universe) == [] == url_filter.cascade(universe, universe.where("false"))
    every = url_filter.cascade(universe.unionByName(universe), universe)
    assert universe.where(url_filter.is_listed(F.col("key"), every)).count() == 2
