"""Logical tables of logs, streams, files and snapshot logs, derived from the stored Parquet tables.

Every table is an event log or a view of one; nothing is inferred, schemas come from the files. Paths are Hadoop paths, so any store
that Spark reads serves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sequences import global_places, running_total, running_totals
from ledgerloom.sources.storage import materialise

DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, seq, body, ts_ms, path, place, msg_offset, next_offset: events as messages of one stream for each user, numbered from 0."""
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("body"),
        F.col("event_type"),
        millis("ts").alias("ts_ms"),
        F.concat(F.lit("/events/"), F.col("user_id"), F.lit("/.updates")).alias("path"),
        (4 + F.octet_length("props")).cast("long").alias("size"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = running_totals(rows, ["sid"], "seq", {"msg_offset": "size", "place": "one"}).drop("one")
    return rows.withColumn("next_offset", F.col("msg_offset") + F.col("size"))


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages as a written table, for plans that read it more than once."""
    return materialise(messages(spark, sf_dir), "messages")


def streams(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One row for each stream: n, tail, trim (the offset of message n div 4), ttl_s, last_access_ms. rows: messages, if at hand."""
    rows = messages(spark, sf_dir) if rows is None else rows
    totals = rows.groupBy("sid").agg(F.count("*").alias("n"), F.sum("size").alias("tail"), F.max("ts_ms").alias("last_access_ms"))
    trims = rows.join(totals.select("sid", F.expr("n div 4").alias("at")), "sid").where("place = at").select("sid", F.col("msg_offset").alias("trim"))
    return totals.join(trims, "sid").withColumn("ttl_s", F.when(F.col("sid") % 5 > 0, F.col("sid") % 5 * 86400))


def forks(spark: SparkSession, sf_dir: str, divisor: int = 4, rows: DataFrame | None = None) -> DataFrame:
    """sid, source, fork_offset: stream u forks from u div divisor at half of the source's own bytes, rarely a message's boundary."""
    own = (messages(spark, sf_dir) if rows is None else rows).groupBy("sid").agg(F.sum("size").alias("tail"))
    children = own.where("sid > 0").select("sid", F.expr(f"sid div {divisor}").alias("source"))
    return children.join(own.select(F.col("sid").alias("source"), F.expr("tail div 2").alias("fork_offset")), "source").select("sid", "source", "fork_offset")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partition, key, seq, batch, batch_pos, op, value, amount, create_ts, expire_ts: line items as writes in order of shipping."""
    items = read(spark, sf_dir, "lineitem")
    rows = global_places(items, "l_shipdate", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "seq")
    ttl = F.col("l_linenumber") % 3 * DAY_MS
    return rows.select(
        F.concat("l_returnflag", "l_linestatus").alias("partition"),
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("key"),
        "seq",
        F.expr("(seq - 1) div 8").alias("batch"),
        ((F.col("seq") - 1) % 8).alias("batch_pos"),
        F.when(F.col("l_quantity") < 5, "delete").otherwise("put").alias("op"),
        F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("value"),
        F.col("l_quantity").cast("long").alias("amount"),
        F.col("l_suppkey").alias("supplier"),
        millis("l_shipdate").alias("create_ts"),
        F.when(ttl > 0, millis("l_shipdate") + ttl).alias("expire_ts"),
    )


def merge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, op, amount: operands for each supplier; every 50th row sets a base, every 97th clears it."""
    kind = F.when(F.col("seq") % 97 == 0, "delete").when(F.col("seq") % 50 == 0, "put").otherwise("merge")
    return kv_log(spark, sf_dir).select(F.col("supplier").alias("key"), "seq", kind.alias("op"), "amount")


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, seq, body, entry_offset, next_offset: conversation turns as entries of one log for each conversation."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("base"), F.col("turn").alias("seq"), "role", F.col("text").alias("body"), (4 + F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("size"))
    return running_total(rows, ["base"], "seq", "size", "entry_offset").withColumn("next_offset", F.col("entry_offset") + F.col("size"))


def log_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, snapshot_offset, seq: a snapshot after every third turn, at the offset that follows it."""
    return log_entries(spark, sf_dir).where("seq % 3 = 2").select("base", F.col("next_offset").alias("snapshot_offset"), "seq")


def log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snap_offset, created_ms: orders as published snapshots of one log, in order of their dates."""
    orders = read(spark, sf_dir, "orders")
    rows = global_places(orders, "o_orderdate", "o_orderkey", [], "snap_offset")
    return rows.select("snap_offset", millis("o_orderdate").alias("created_ms"), F.col("o_orderkey").alias("order_key"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partition, id, body: documents as files, one partition for each source."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("partition"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"), F.col("text").alias("body"), "doc_id", "lang")


def producer_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """producer, at, epoch, seq: events numbered in their epoch (a third of a month), with repeats and gaps."""
    events = read(spark, sf_dir, "events")
    epoch = F.expr("(dayofmonth(ts) - 1) div 10").cast("long")
    rows = events.select(F.col("user_id").alias("producer"), F.col("event_id").alias("at"), epoch.alias("epoch"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("producer", "epoch").orderBy("at")).cast("long") - 1)
    rows = rows.select("producer", (F.col("at") * 2).alias("at"), "epoch", "seq")
    again = rows.where("at div 2 % 10 = 0").withColumn("at", F.col("at") + 1)
    return rows.where("at div 2 % 37 <> 0").unionByName(again)
