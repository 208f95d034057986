"""Reads, scans, pages and writes of key-value logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import kv
from ledgerloom.sources.tables import kv_log, log_index, merge_log, read

from .registry import query


@query("SELECT partition, key, value, seq FROM kv_state", "kv_state")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv_log(spark, sf_dir)).select("partition", "key", "value", "seq")


@query("SELECT partition, key, value, seq, create_ts, expire_ts FROM kv_state", "kv_state")
def kv_latest_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv_log(spark, sf_dir)).select("partition", "key", "value", "seq", "create_ts", "expire_ts")


@query("SELECT partition, key, substr(value, 3, 4) AS part, CAST(2 AS BIGINT) AS at, CAST(strlen(value) AS BIGINT) AS full_size FROM kv_state", "kv_state")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.state(kv_log(spark, sf_dir))
    return rows.select("partition", "key", F.substring("value", 3, 4).alias("part"), F.lit(2).cast("long").alias("at"), F.octet_length("value").cast("long").alias("full_size"))


@query("SELECT key, value FROM kv_state WHERE partition = 'NO' AND key >= '0000001000' AND key < '0000003000' ORDER BY key", "kv_state")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.scan(kv_log(spark, sf_dir), "NO", gte="0000001000", lt="0000003000")
    return kv.state(rows).select("key", "value").orderBy("key")


@query("SELECT key, value FROM kv_state WHERE partition = 'RF' AND starts_with(key, '00000001') ORDER BY key", "kv_state")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.scan(kv_log(spark, sf_dir), "RF", prefix="00000001")).select("key", "value").orderBy("key")


@query("SELECT key, value FROM kv_state WHERE partition = 'NO' AND key > '0000000100' AND key <= '0000002000' ORDER BY key DESC LIMIT 100", "kv_state")
def range_scan_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.scan(kv_log(spark, sf_dir), "NO", gt="0000000100", lte="0000002000")
    return kv.state(rows).select("key", "value").orderBy(F.desc("key")).limit(100)


@query("SELECT key, value, seq FROM kv_state WHERE partition = 'AF' ORDER BY key", "kv_state")
def scan_with_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.scan(kv_log(spark, sf_dir), "AF")).select("key", "value", "seq").orderBy("key")


@query(
    """SELECT partition, substr(key, 1, 8) AS key_part, CAST(strlen(key) AS BIGINT) AS key_size, substr(value, 1, 6) AS value_part,
         CAST(strlen(value) AS BIGINT) AS value_size, strlen(value) > 6 AS truncated, strlen(key) > 8 AS oversized_key, seq FROM kv_state""",
    "kv_state",
)
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.state(kv_log(spark, sf_dir))
    key_size, value_size = F.octet_length("key").cast("long"), F.octet_length("value").cast("long")
    return rows.select("partition", F.substring("key", 1, 8).alias("key_part"), key_size.alias("key_size"), F.substring("value", 1, 6).alias("value_part"), value_size.alias("value_size"), (value_size > 6).alias("truncated"), (key_size > 8).alias("oversized_key"), "seq")


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY partition, key ORDER BY seq DESC) AS k FROM kv_log WHERE seq <= 3000)
       SELECT partition, key, value, seq FROM s WHERE k = 1 AND op <> 'delete'""",
    "kv_log",
)
def snapshot_as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state_as_of(kv_log(spark, sf_dir), 3000).select("partition", "key", "value", "seq")


@query(
    """WITH p AS (SELECT key, value, row_number() OVER (ORDER BY key) AS k FROM kv_state WHERE partition = 'NO' AND key > '0000000500' AND key < '0000009000')
       SELECT key, value, CASE WHEN (SELECT count(*) FROM p) > 100 THEN (SELECT key FROM p WHERE k = 100) END AS cursor FROM p WHERE k <= 100""",
    "kv_state",
)
def kv_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.state(kv.scan(kv_log(spark, sf_dir), "NO", gt="0000000500", lt="0000009000"))
    return kv.page(rows.select("key", "value"), 100)


@query(
    """WITH p AS (SELECT key, value, CAST(strlen(key) + strlen(value) AS BIGINT) AS size FROM kv_state WHERE partition = 'NO' ORDER BY key LIMIT 200),
       q AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
       SELECT key, value, size FROM q WHERE used < 2048""",
    "kv_state",
)
def bounded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.bounded_page(kv.state(kv.scan(kv_log(spark, sf_dir), "NO")).select("key", "value"), 200, 2048)


@query("SELECT DISTINCT source AS partition FROM documents")
def distinct_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("source").alias("partition")).distinct()


@query("SELECT key, value FROM kv_state WHERE partition = 'NO' AND amount >= 40 ORDER BY key LIMIT 50", "kv_state")
def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.scan(kv_log(spark, sf_dir), "NO")).where("amount >= 40").select("key", "value").orderBy("key").limit(50)


@query("SELECT * FROM (SELECT key, value FROM kv_state WHERE partition = 'RF' ORDER BY key DESC LIMIT 20) ORDER BY key", "kv_state")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.scan(kv_log(spark, sf_dir), "RF")).select("key", "value").orderBy(F.desc("key")).limit(20).orderBy("key")


@query("SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) AS k FROM kv_state WHERE partition = 'NO') WHERE k = 101", "kv_state")
def page_next_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.scan(kv_log(spark, sf_dir), "NO")).select("key").orderBy("key").offset(100).limit(1)


@query("SELECT partition, least(count(*), 50) AS rows_seen, count(*) >= 50 AS at_least FROM kv_state GROUP BY partition", "kv_state")
def capped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kv.state(kv_log(spark, sf_dir)).groupBy("partition").count()
    return counts.select("partition", F.least("count", F.lit(50).cast("long")).alias("rows_seen"), (F.col("count") >= 50).alias("at_least"))


@query(
    """SELECT 'kv' AS kind, partition AS shard, count(*) AS n FROM kv_state GROUP BY partition
       UNION ALL SELECT 'files', source, count(*) FROM documents GROUP BY source
       UNION ALL SELECT 'streams', CAST(user_id % 8 AS VARCHAR), count(DISTINCT user_id) FROM events GROUP BY user_id % 8""",
    "kv_state",
)
def home_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv.state(kv_log(spark, sf_dir)).groupBy(F.lit("kv").alias("kind"), F.col("partition").alias("shard")).agg(F.count("*").alias("n"))
    docs = read(spark, sf_dir, "documents").groupBy(F.lit("files").alias("kind"), F.col("source").alias("shard")).agg(F.count("*").alias("n"))
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return rows.unionByName(docs).unionByName(users.groupBy(F.lit("streams").alias("kind"), (F.col("user_id") % 8).cast("string").alias("shard")).agg(F.count("*").alias("n")))


@query(
    """WITH bad AS (SELECT DISTINCT batch FROM kv_log WHERE amount = 13)
       SELECT batch, max(seq) AS version, count(*) AS n_ops FROM kv_log WHERE batch NOT IN (SELECT batch FROM bad) GROUP BY batch""",
    "kv_log",
)
def atomic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with any invalid operation (here: amount 13) drops whole; the others get one version."""
    log = kv_log(spark, sf_dir)
    return log.groupBy("batch").agg(F.max("seq").alias("version"), F.count("*").alias("n_ops"), F.max(F.col("amount") == 13).alias("bad")).where("NOT bad").drop("bad")


@query(
    """SELECT partition, key, seq, expire_ts, expire_ts IS NULL OR expire_ts > (SELECT max(create_ts) - 2592000000 FROM kv_log) AS live FROM kv_state""",
    "kv_state",
)
def ttl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired rows stay visible until compaction; live tells a strict reader which they are."""
    log = kv_log(spark, sf_dir)
    now = log.agg((F.max("create_ts") - 30 * 86400000).alias("now"))
    return kv.state(log).join(F.broadcast(now)).select("partition", "key", "seq", "expire_ts", (F.col("expire_ts").isNull() | (F.col("expire_ts") > F.col("now"))).alias("live"))


def _merge(name: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kv.merge_fold(kv.merge_tail(merge_log(spark, sf_dir)), name)

    run.__name__ = f"merge_{name}"
    return query(sql, "merge_tail")(run)


_merge("u64_add", "SELECT key, CAST(sum(amount) % 18446744073709551616 AS VARCHAR) AS merged FROM merge_tail GROUP BY key")
_merge("i64_add", "SELECT key, CAST(sum(amount) AS BIGINT) AS merged FROM merge_tail GROUP BY key")
_merge("u64_max", "SELECT key, max(amount) AS merged FROM merge_tail GROUP BY key")
_merge("u64_min", "SELECT key, min(amount) AS merged FROM merge_tail GROUP BY key")
_merge("append", "SELECT key, string_agg(CAST(amount AS VARCHAR), '' ORDER BY seq) AS merged FROM merge_tail GROUP BY key")


@query(
    """WITH b AS (SELECT batch, count(*) AS n, count(DISTINCT partition || key) AS k, sum(strlen(key) + strlen(value)) AS bytes FROM kv_log GROUP BY batch)
       SELECT batch, CASE WHEN k < n THEN 'duplicate_key' WHEN n > 1000 THEN 'batch_too_large' WHEN bytes > 160 THEN 'too_many_bytes' ELSE 'ok' END AS outcome FROM b""",
    "kv_log",
)
def kv_batch_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 1,000 operations, all of different keys, of at most 160 bytes (small, so that some are refused)."""
    b = kv_log(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct(F.concat("partition", "key")).alias("k"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"))
    outcome = F.when(F.col("k") < F.col("n"), "duplicate_key").when(F.col("n") > 1000, "batch_too_large").when(F.col("bytes") > 160, "too_many_bytes").otherwise("ok")
    return b.select("batch", outcome.alias("outcome"))


@query(
    """WITH i AS (SELECT user_id, (epoch_us(ts) // 1000) AS b, (epoch_us(ts) // 1000) + 3600000 * (1 + event_id % 5) AS e, CAST(strlen(props) AS BIGINT) AS n FROM events),
       c AS (SELECT user_id, b AS moment, n AS d FROM i UNION ALL SELECT user_id, e, -n FROM i),
       s AS (SELECT user_id, moment, sum(d) AS d FROM c GROUP BY user_id, moment)
       SELECT user_id, moment, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY moment) AS BIGINT) AS load FROM s"""
)
def inflight_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    begin = F.unix_millis(F.col("ts").cast("timestamp"))
    intervals = events.select("user_id", begin.alias("begin"), (begin + 3600000 * (1 + F.col("event_id") % 5)).alias("end"), F.octet_length("props").cast("long").alias("bytes"))
    return kv.in_flight(intervals, ["user_id"]).withColumnRenamed("at", "moment")


_TX = """WITH t AS (SELECT batch AS tx, min(seq) - 40 AS begin, max(seq) AS commit FROM kv_log GROUP BY batch),
       r AS (SELECT DISTINCT batch AS tx, supplier AS key, op = 'put' AS wrote FROM kv_log)
       SELECT DISTINCT a.tx FROM r x JOIN t a ON a.tx = x.tx JOIN r y ON y.key = x.key AND y.wrote JOIN t b ON b.tx = y.tx
       WHERE a.tx <> b.tx AND a.begin < b.commit AND b.commit < a.commit{}"""


def _transactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = kv_log(spark, sf_dir)
    times = log.groupBy(F.col("batch").alias("tx")).agg((F.min("seq") - 40).alias("begin"), F.max("seq").alias("commit"))
    return times, log.select(F.col("batch").alias("tx"), F.col("supplier").alias("key"), (F.col("op") == "put").alias("wrote")).distinct()


@query(_TX.format(" AND x.wrote"), "kv_log")
def tx_conflicts_ww(spark: SparkSession, sf_dir: str) -> DataFrame:
    times, touched = _transactions(spark, sf_dir)
    return kv.write_conflicts_ww(times, touched)


@query(_TX.format(""), "kv_log")
def tx_conflicts_rw(spark: SparkSession, sf_dir: str) -> DataFrame:
    times, touched = _transactions(spark, sf_dir)
    return kv.write_conflicts_rw(times, touched)


PREFIXES = ["00000012", "000000123", "00000050", "000000505", "0000009"]


@query("SELECT partition, key, value FROM kv_state WHERE NOT (starts_with(key, '00000012') OR starts_with(key, '00000050') OR starts_with(key, '0000009'))", "kv_state")
def prefix_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.state(kv.compact(kv_log(spark, sf_dir), PREFIXES)).select("partition", "key", "value")


@query("SELECT * FROM (VALUES ('00000012'), ('00000050'), ('0000009')) t(prefix)")
def reduced_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in kv.reduced_prefixes(PREFIXES)], "prefix string")


@query(
    """WITH q AS (SELECT CAST(unnest([100, 5000, 14000]) AS BIGINT) AS seq)
       SELECT seq, (SELECT max(created_ms) FROM log_index WHERE snap_offset <= q.seq) AS at_or_before,
              (SELECT min(created_ms) FROM log_index WHERE snap_offset >= q.seq) AS at_or_after FROM q""",
    "log_index",
)
def seq_to_time_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of a sequence number, rounded down and up; sequence numbers and times rise together."""
    asked = [100, 5000, 14000]

    def nearest(seq: int):
        down, up = F.when(F.col("snap_offset") <= seq, F.col("snap_offset")), F.when(F.col("snap_offset") >= seq, F.col("snap_offset"))
        times = F.max_by("created_ms", down).alias("at_or_before"), F.min_by("created_ms", up).alias("at_or_after")
        return F.struct(F.lit(seq).cast("long").alias("seq"), *times)

    row = log_index(spark, sf_dir).agg(F.array(*map(nearest, asked)).alias("found"))  # one pass for all
    return row.select(F.explode("found").alias("f")).select("f.*")


@query("SELECT batch % 4 AS shard, max(seq) AS last_seq, max(CASE WHEN seq % 10 < 8 THEN seq END) AS durable_seq, max(seq) - max(CASE WHEN seq % 10 < 8 THEN seq END) AS lag FROM kv_log GROUP BY batch % 4", "kv_log")
def durability_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    durable = F.max(F.when(F.col("seq") % 10 < 8, F.col("seq")))
    return kv_log(spark, sf_dir).groupBy((F.col("batch") % 4).alias("shard")).agg(F.max("seq").alias("last_seq"), durable.alias("durable_seq"), (F.max("seq") - durable).alias("lag"))
