"""Snapshot logs: what is current, what is kept, what is garbage, and how content is put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_snapshots(index: DataFrame) -> DataFrame:
    """base and snapshot_offset of the last readable index entry, null after a deletion. index: base, at, snapshot_offset (null: unreadable), deleted."""
    last = F.max_by("snapshot_offset", F.when(F.col("snapshot_offset").isNotNull(), F.col("at")))
    state = index.groupBy("base").agg(last.alias("snapshot_offset"), F.min(F.when(F.col("deleted"), F.col("at"))).alias("deleted_at"))
    return state.select("base", F.when(F.col("deleted_at").isNull(), F.col("snapshot_offset")).alias("snapshot_offset"), F.col("deleted_at").isNotNull().alias("deleted"))


def kept_history(snapshots: DataFrame, rules: list[tuple[int, int]], now: int) -> DataFrame:
    """snap_offset of the snapshots (snap_offset, created_ms, rising together) that any rule (every, keep) keeps.

    A rule keeps the latest of each bucket of `every` ms that is younger than `keep`.
    """
    ruled = snapshots.withColumn("rule", F.explode(F.array(*(F.struct(F.lit(e).cast("long").alias("every"), F.lit(k).cast("long").alias("keep")) for e, k in rules))))
    last = ruled.groupBy("rule", F.expr("created_ms div rule.every").alias("bucket")).agg(F.max(F.struct("created_ms", "snap_offset")).alias("s"))
    return last.where(F.lit(now) - F.col("s.created_ms") < F.col("rule.keep")).select(F.col("s.snap_offset").alias("snap_offset")).distinct()


def reconstruct(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """base, kind, at: each log's latest snapshot and the entries from its offset on; all entries if there is none."""
    current = snapshots.groupBy("base").agg(F.max("snapshot_offset").alias("from"))
    tail = entries.join(current, "base", "left").where(F.col("entry_offset") >= F.coalesce("from", F.lit(0)))
    return current.select("base", F.lit("snapshot").alias("kind"), F.col("from").alias("at")).unionByName(tail.select("base", F.lit("entry").alias("kind"), F.col("entry_offset").alias("at")))


def contiguous_suffix(entries: DataFrame) -> DataFrame:
    """base and retained_from: where the last unbroken run of entries begins (entry_offset, next_offset)."""
    order = Window.partitionBy("base").orderBy("entry_offset")
    gaps = entries.withColumn("broken", F.coalesce(F.lag("next_offset").over(order) != F.col("entry_offset"), F.lit(True)))
    return gaps.where("broken").groupBy("base").agg(F.max("entry_offset").alias("retained_from"))
