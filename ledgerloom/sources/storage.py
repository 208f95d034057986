"""Shared storage for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    One of our own where it is unset and driver and tasks are one process (tests). On a cluster the setting is required: executors
    would write to their own disks, and later reads would miss their files.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return "file:///tmp/checkpoints/ledgerloom"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Remove the files of tables from materialise that nothing reads any more."""
    for table in tables:
        if table is not None and (path := getattr(table, "written_to", None)):
            jvm, hadoop = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(hadoop).delete(place, True)
