"""Final reads of any number of processes."""

from ledgerloom import plans


def test_more_than_a_thousand_processes(spark, tmp_path):
    rows = [(0, f"p{i}") for i in range(1100)] + [(1, "p0")]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = plans.queries()["final_read_coverage"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.event_type, r.reads) for r in found) == sorted((1, f"p{i}", 0) for i in range(1, 1100))
