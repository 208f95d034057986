"""Written tables: where they lie, and how they go."""

import os
from types import SimpleNamespace

import pytest

from ledgerloom.sources.storage import discard, materialise, shared_dir


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("file:")
    for master in ("yarn", "spark://x:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))


def test_discarded_tables_are_gone(spark):
    table = materialise(spark.range(5), "some-table")
    path = table.written_to.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    discard(table, None, spark.range(1))
    assert not os.path.exists(path)
