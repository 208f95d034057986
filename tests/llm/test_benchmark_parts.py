"""A benchmark over the bound is searched in parts; results are those of the whole."""

import by_definition

from ledgerloom.llm import decontaminate

TEXT = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
ITEMS = [(f"i{n}", " ".join(TEXT.split()[n : n + 11])) for n in range(12)] + [("i3", "one two"), ("i3", None), ("big", TEXT + " " + TEXT), ("none", "--")]
DOCS = [
    (1, TEXT), (1, TEXT), (2, TEXT.replace(" ", ", ")), (3, "x " + TEXT + " y One  two! " + TEXT), (4, None), (5, ""), (6, "one 2"),
    (None, "one two three"), (7, "iota kappa " * 9), (8, " ".join(TEXT.split()[:10]) + " z " + " ".join(TEXT.split()[5:16])),
]


def test_parts_equal_the_whole(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, unit string")
    parts = decontaminate.benchmark_parts(benchmark, 150)
    assert len(parts) > 3 and sum(p.count() for p, _ in parts) == sum(t is not None for _, t in ITEMS)
    assert all(decontaminate._bytes_of(p) == n for p, n in parts)
    split = decontaminate.contamination(docs, benchmark, most_bytes=150)
    whole = decontaminate.contamination(docs, benchmark)
    assert split.columns == whole.columns and split.dtypes == whole.dtypes
    assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect()))
    report = [tuple(r) for r in decontaminate.contamination_report(split).collect()]
    assert sorted(report, key=repr) == sorted(by_definition.contamination(DOCS, ITEMS), key=repr)


def test_parts_of_no_documents(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.contamination(spark.createDataFrame([], "doc_id long, text string"), benchmark, most_bytes=150).count() == 0
