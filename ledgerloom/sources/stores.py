"""Reading stores: objects, checkpoints, clones, and followers of a growing log. Any Hadoop path serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key, size, modified, body of the objects under path; bodies are read only where they are selected."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("body"))


def read_checkpoint(log: DataFrame, checkpoints: DataFrame, name: str) -> DataFrame:
    """The log as of a named row of checkpoints (name, max_seq); nothing if there is none."""
    limit = checkpoints.where(F.col("name") == name).select(F.max("max_seq").alias("_limit"))
    return log.join(F.broadcast(limit)).where(F.col("seq") <= F.col("_limit")).drop("_limit")


def list_checkpoints(manifest: DataFrame, now: int, name: str | None = None) -> DataFrame:
    """The rows of manifest (id, name, max_seq, expires_ms) that have not expired, of one name or of all; null never expires."""
    live = manifest.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now))
    return live if name is None else live.where(F.col("name") == name)


def create_checkpoint(manifest: DataFrame, row: DataFrame) -> DataFrame:
    """manifest with one more checkpoint, a row of the same columns; identifiers are never used twice."""
    return manifest.unionByName(row.join(manifest.select("id"), "id", "left_anti"))


def refresh_checkpoints(manifest: DataFrame, ids: DataFrame, now: int, lifetime: int | None) -> DataFrame:
    """manifest with a new end for the checkpoints in ids: lifetime ms from now, or none."""
    asked = ids.select("id", F.lit(True).alias("_asked")).distinct()
    end = F.lit(None if lifetime is None else now + lifetime).cast("long")
    return manifest.join(asked, "id", "left").withColumn("expires_ms", F.when(F.col("_asked"), end).otherwise(F.col("expires_ms"))).drop("_asked")


def delete_checkpoints(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    return manifest.join(ids.select("id"), "id", "left_anti")


def layout_outcome(pinned: Column, shards: int, hash_name: str) -> Column:
    """What a pinned layout (struct of shards and hash, or null) says of opening with another: new, ok, shards_changed or hash_changed."""
    return F.when(pinned.isNull(), "new").when(pinned["shards"] != shards, "shards_changed").when(pinned["hash"] != hash_name, "hash_changed").otherwise("ok")


def clone(base: DataFrame, max_seq: int, own: DataFrame) -> DataFrame:
    """A database cloned at max_seq: the base's rows up to there and its own; no row is copied."""
    return base.where(F.col("seq") <= max_seq).unionByName(own)


def follow(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the rows that a writer adds to the Parquet table at path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_by_shard(log: DataFrame, path: str, shard: str, key: str) -> None:
    """Write a log so that a scan of one shard and key range reads little: partitioned by shard, sorted by key in each file."""
    log.repartition(shard).sortWithinPartitions(shard, key).write.partitionBy(shard).parquet(path)
