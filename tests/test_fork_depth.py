"""Forks of forks of any depth."""

import pytest

from ledgerloom.operators import streams


def test_forks_deeper_than_eight(spark):
    ids = spark.createDataFrame([(i,) for i in range(12)], "sid long")
    forks = spark.createDataFrame([(i, i - 1, i) for i in range(1, 12)], "sid long, source long, fork_offset long")
    messages = spark.createDataFrame([(i, i, "m", 0) for i in range(12)], "sid long, seq long, body string, msg_offset long")
    ranges = streams.lineage(ids, forks)
    assert max(r.level for r in ranges.collect()) == 11
    assert sorted(r.seq for r in streams.fork_read(messages, ranges).where("reader = 11").collect()) == list(range(12))


def test_forks_of_themselves_are_refused(spark):
    ids = spark.createDataFrame([(1,), (2,)], "sid long")
    forks = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "sid long, source long, fork_offset long")
    with pytest.raises(ValueError, match="themselves"):
        streams.lineage(ids, forks)
