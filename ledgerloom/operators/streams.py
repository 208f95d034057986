"""Append-only byte streams: pages, outcomes, retention, forks and copies as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.storage import materialise

from .sequences import page_by_bytes

#: A fork's own range has no end.
OPEN_END = (1 << 63) - 1


def read_page(messages: DataFrame, start: Column, budget: int) -> DataFrame:
    """Each stream's messages from start, up to and with the one that reaches budget bytes of bodies."""
    rows = messages.where(F.col("msg_offset") >= start).withColumn("bytes", F.octet_length("body").cast("long"))
    return page_by_bytes(rows, ["sid"], "seq", "bytes", budget)


def read_outcome(offset: Column, trim: Column, tail: Column, closed: Column) -> Column:
    """What a read at offset gives: reading exactly at trim is allowed, `closed` comes only at the end of a closed stream."""
    return F.when(offset < trim, "trimmed").when(offset > tail, "offset_beyond_tail").when(offset < tail, "data").when(closed, "closed").otherwise("up_to_date")


def deadline(row_expires: Column, last_access: Column, ttl_s: Column) -> Column:
    """Absolute expiry, else last access plus time to live; null if there is neither."""
    return F.coalesce(row_expires, last_access + ttl_s * 1000)


def reclaim_floor(streams: DataFrame, pins: DataFrame) -> DataFrame:
    """sid and floor = max(reclaimed, least(trim, least pin)) for streams (sid, trim, reclaimed) and pins (sid, start)."""
    low = pins.groupBy("sid").agg(F.min("start").alias("pin"))
    return streams.join(low, "sid", "left").select("sid", F.greatest("reclaimed", F.least("trim", F.coalesce("pin", "trim"))).alias("floor"))


def lineage(streams: DataFrame, forks: DataFrame) -> DataFrame:
    """reader, sid, level, lo, hi: whose messages a stream reads, and the offsets where those may start.

    A fork inherits what its source's readers see before the fork offset; whole messages, even if the offset lies inside one. Each step
    up is one join, as many as the deepest fork needs. Forks that lead back to themselves are refused.
    """
    start = streams.join(forks, "sid", "left").select("sid", "source", F.coalesce("fork_offset", F.lit(0)).cast("long").alias("fork_offset"))
    start = materialise(start, "lineage-streams")
    step = start.select(F.col("sid").alias("reader"), "sid", F.lit(0).alias("level"), F.col("fork_offset").alias("lo"), F.lit(OPEN_END).alias("hi"), "source")
    parents = start.select(F.col("sid").alias("source"), F.col("source").alias("next"), F.col("fork_offset").alias("parent_lo"))
    out = step.select("reader", "sid", "level", "lo", "hi")
    most, depth = start.count(), 0
    while True:
        step = step.where("source IS NOT NULL").join(parents, "source")
        step = step.select("reader", F.col("source").alias("sid"), (F.col("level") + 1).alias("level"), F.col("parent_lo").alias("lo"), F.least("hi", "lo").alias("hi"), F.col("next").alias("source"))
        step = materialise(step, "lineage-step")
        if step.isEmpty():
            break
        depth += 1
        if depth >= most:
            raise ValueError("forks lead back to themselves")
        out = out.unionByName(step.select("reader", "sid", "level", "lo", "hi"))
    return out


def fork_read(messages: DataFrame, ranges: DataFrame) -> DataFrame:
    """reader, sid, start, seq of every message that a stream reads, its own and inherited; ranges as lineage gives them."""
    rows = messages.join(ranges, "sid").withColumn("start", F.col("msg_offset") + F.col("lo"))
    return rows.where(F.col("start") < F.col("hi")).select("reader", "sid", "start", "seq")


def copy_range(messages: DataFrame, start: Column, end: Column, new_sid: Column) -> DataFrame:
    """Messages that start in [start, end), under a new stream id, offsets kept."""
    return messages.where((F.col("msg_offset") >= start) & (F.col("msg_offset") < end)).withColumn("sid", new_sid)


def split_parts(rows: DataFrame, body: str, part_bytes: int) -> DataFrame:
    """rows with part and bytes: the body cut into parts of part_bytes; an empty body is one empty part."""
    raw = F.col(body).cast("binary")
    parts = F.greatest(F.ceil(F.octet_length(raw) / part_bytes), F.lit(1)).cast("int")
    cut = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.withColumn("bytes", F.expr(f"substring(CAST({body} AS BINARY), part * {part_bytes} + 1, {part_bytes})")).drop(body)


def join_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and body (binary): parts of a message put together again; a message has a bounded number of parts."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "bytes")))
    return parts.groupBy(*keys).agg(F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("body"))


def guarded(writes: DataFrame, sealed: DataFrame, streams: DataFrame) -> DataFrame:
    """writes with outcome: sealed, conflict or ok.

    writes: grp, unsealed (whether its group must not be sealed), absent (a stream that must not be), identity and offset (a stream that
    must end there). sealed: grp. streams: sid, tail. The seal is looked at first.
    """
    seals = sealed.select("grp", F.lit(True).alias("_sealed")).distinct()
    there = streams.select(F.col("sid").alias("absent"), F.lit(True).alias("_there"))
    ends = streams.select(F.col("sid").alias("identity"), F.col("tail").alias("_tail"))
    rows = writes.join(seals, "grp", "left").join(there, "absent", "left").join(ends, "identity", "left")
    moved = F.col("identity").isNotNull() & F.coalesce(F.col("_tail") != F.col("offset"), F.lit(True))
    outcome = F.when(F.col("unsealed") & F.col("_sealed").isNotNull(), "sealed").when(F.col("_there").isNotNull() | moved, "conflict").otherwise("ok")
    return rows.withColumn("outcome", outcome).drop("_sealed", "_there", "_tail")
