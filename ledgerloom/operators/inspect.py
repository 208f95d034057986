"""Inspection reads: each form of the read-only front end as a function that returns a DataFrame.

Pages take limit and after (a key: rows up to it were seen); the next page's `after` is the last key of this one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files as FS
from . import kv, logs, streams
from .sequences import prefix_filter

LIMIT = 50


def _page(rows: DataFrame, key: str, limit: int, after: object = None) -> DataFrame:
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def home(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """kind, shard, n for named tables, each with its shard column."""
    parts = [rows.groupBy(F.lit(kind).alias("kind"), F.col(shard).cast("string").alias("shard")).agg(F.count("*").alias("n")) for kind, (rows, shard) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_shard_with_rows(counts: DataFrame) -> DataFrame:
    """The least shard of (shard, n) that has rows."""
    return counts.where("n > 0").agg(F.min("shard").alias("shard"))


def scan(log: DataFrame, partition: str, prefix: str = "", limit: int = LIMIT, after: str | None = None) -> DataFrame:
    rows = log.where(F.col("partition") == partition)
    return _page(kv.state(rows.where(prefix_filter("key", prefix)) if prefix else rows).select("key", "value", "seq"), "key", limit, after)


def get(log: DataFrame, partition: str, key: str, offset: int = 0, length: int = 4096) -> DataFrame:
    """Part of one value, where it starts and the whole size; a start past the end gives an empty part and the start asked for."""
    rows = kv.state(log.where((F.col("partition") == partition) & (F.col("key") == key)))
    return rows.select("key", F.substring("value", offset + 1, length).alias("part"), F.lit(offset).alias("at"), F.octet_length("value").alias("full_size"), "seq")


def partitions(log: DataFrame) -> DataFrame:
    return log.select("partition").distinct().orderBy("partition")


def stream_list(rows: DataFrame, prefix: str = "", limit: int = LIMIT, after: str | None = None) -> DataFrame:
    return _page(rows.where(prefix_filter("path", prefix)) if prefix else rows, "path", limit, after)


def stream(rows: DataFrame, forks: DataFrame, sid: int) -> DataFrame:
    """One stream with its tail and trim, its source if it is a fork, and how many forks it has."""
    children = forks.where(F.col("source") == sid).agg(F.count("*").alias("forks"))
    return rows.where(F.col("sid") == sid).join(forks.select("sid", "source", "fork_offset"), "sid", "left").join(F.broadcast(children))


def messages(rows: DataFrame, sid: int, start: int = 0, until: int | None = None, limit: int = LIMIT, last: bool = False) -> DataFrame:
    """Messages that start in [start, until), the first or the last of them, in order."""
    own = rows.where((F.col("sid") == sid) & (F.col("msg_offset") >= start) & (F.lit(True) if until is None else F.col("msg_offset") < until))
    return own.orderBy(F.desc("msg_offset") if last else F.asc("msg_offset")).limit(limit).orderBy("msg_offset")


def logical(rows: DataFrame, ranges: DataFrame, sid: int, start: int = 0, limit: int = LIMIT) -> DataFrame:
    """A stream's messages through its lineage (ranges of streams.lineage)."""
    own = streams.fork_read(rows, ranges.where(F.col("reader") == sid))
    return own.where(F.col("start") >= start).orderBy("start", "sid").limit(limit)


def retention(rows: DataFrame, pins: DataFrame, sid: int) -> DataFrame:
    return streams.reclaim_floor(rows.where(F.col("sid") == sid), pins.where(F.col("sid") == sid))


def file_page(rows: DataFrame, partition: str, limit: int = LIMIT, after: str | None = None) -> DataFrame:
    size = F.octet_length("body")
    own = rows.where(F.col("partition") == partition).select("id", size.alias("size"), FS.storage_class(size).alias("storage"))
    return _page(own, "id", limit, after)


def object_range(rows: DataFrame, object_id: str, first: int, last: int | None = None) -> DataFrame:
    own = rows.where(F.col("id") == object_id).withColumn("size", F.octet_length("body").cast("long"))
    asked = own.withColumn("r", FS.clamp_range(F.lit(first), F.lit(last).cast("long"), F.lit(None).cast("long"), F.col("size")))
    return asked.select("id", "size", "r.outcome", F.expr("substring(CAST(body AS BINARY), CAST(r.first AS INT) + 1, CAST(r.last - r.first AS INT) + 1)").alias("part"))


def log_content(snapshots: DataFrame, entries: DataFrame, base: object) -> DataFrame:
    return logs.reconstruct(snapshots.where(F.col("base") == base), entries.where(F.col("base") == base))


def log_component(entries: DataFrame, base: object, start: int = 0, limit: int = LIMIT) -> DataFrame:
    return entries.where((F.col("base") == base) & (F.col("entry_offset") >= start)).orderBy("entry_offset").limit(limit)


def log_bases(paths: DataFrame, pattern: str = r"^(.+)/\.updates$") -> DataFrame:
    return paths.select(F.regexp_extract("path", pattern, 1).alias("base")).where("base <> ''").distinct()
