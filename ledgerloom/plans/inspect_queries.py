"""The read-only front end's forms, checkpoints, guarded and late writes, and small codecs, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import codecs
from ledgerloom.operators import files as FS
from ledgerloom.operators import inspect as I
from ledgerloom.operators import kv
from ledgerloom.operators import streams as S
from ledgerloom.sources import stores
from ledgerloom.sources.tables import DAY_MS, files, forks, kv_log, log_entries, log_snapshots, messages, millis, read, stored_messages, streams

from .registry import query

#: The stream, log and keys that the single-object forms look at.
SID, BASE = 7, 3

# --- inspection forms


@query(
    """SELECT 'kv' AS kind, partition AS shard, count(*) AS n FROM kv_state GROUP BY partition
       UNION ALL SELECT 'files', partition, count(*) FROM files GROUP BY partition
       UNION ALL SELECT 'streams', CAST(sid % 8 AS VARCHAR), count(*) FROM streams GROUP BY sid % 8""",
    "kv_state files streams",
)
def inspect_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = streams(spark, sf_dir).select((F.col("sid") % 8).alias("shard"))
    return I.home({"kv": (kv.state(kv_log(spark, sf_dir)), "partition"), "files": (files(spark, sf_dir), "partition"), "streams": (own, "shard")})


@query("SELECT key, value, seq FROM kv_state WHERE partition = 'NO' AND starts_with(key, '00000001') AND key > '0000000110' ORDER BY key LIMIT 50", "kv_state")
def inspect_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scan(kv_log(spark, sf_dir), "NO", prefix="00000001", after="0000000110")


@query("SELECT key, substr(value, 3, 4) AS part, CAST(2 AS INTEGER) AS at, CAST(strlen(value) AS INTEGER) AS full_size, seq FROM kv_state WHERE partition = 'RF' AND key = '0000000003'", "kv_state")
def inspect_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.get(kv_log(spark, sf_dir), "RF", "0000000003", offset=2, length=4)


@query("SELECT DISTINCT path FROM messages WHERE starts_with(path, '/events/1') AND path > '/events/10/.updates' ORDER BY path LIMIT 50", "messages")
def inspect_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stream_list(messages(spark, sf_dir).select("path").distinct(), "/events/1", after="/events/10/.updates")


@query(
    f"""SELECT s.sid, n, tail, trim, source, fork_offset, (SELECT count(*) FROM forks WHERE source = {SID}) AS forks
        FROM streams s LEFT JOIN forks f ON f.sid = s.sid WHERE s.sid = {SID}""",
    "forks",
)
def inspect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    return I.stream(streams(spark, sf_dir, rows), forks(spark, sf_dir, rows=rows), SID).select("sid", "n", "tail", "trim", "source", "fork_offset", "forks")


@query(
    f"""SELECT 'first' AS which, seq, msg_offset, body FROM (SELECT * FROM messages WHERE sid = {SID} AND msg_offset >= 100 ORDER BY msg_offset LIMIT 5)
        UNION ALL SELECT 'last', seq, msg_offset, body FROM (SELECT * FROM messages WHERE sid = {SID} AND msg_offset >= 100 ORDER BY msg_offset DESC LIMIT 5)""",
    "messages",
)
def inspect_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    pages = [I.messages(rows, SID, start=100, limit=5, last=last).select(F.lit(name).alias("which"), "seq", "msg_offset", "body") for name, last in (("first", False), ("last", True))]
    return pages[0].unionByName(pages[1])


@query(
    f"""WITH RECURSIVE s AS (SELECT t.sid, f.source, coalesce(f.fork_offset, 0) AS lo FROM streams t LEFT JOIN forks f ON f.sid = t.sid),
       r(reader, sid, lo, hi, source) AS (SELECT sid, sid, lo, 9223372036854775807, source FROM s WHERE sid = {SID}
         UNION ALL SELECT r.reader, s.sid, s.lo, least(r.hi, r.lo), s.source FROM r JOIN s ON s.sid = r.source)
       SELECT r.sid, msg_offset + lo AS start, seq FROM r JOIN messages m ON m.sid = r.sid WHERE msg_offset + lo < hi ORDER BY start, r.sid LIMIT 50""",
    "forks",
)
def inspect_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    return I.logical(rows, S.lineage(rows.select("sid").distinct(), forks(spark, sf_dir, rows=rows)), SID).select("sid", "start", "seq")


@query(
    f"""SELECT s.sid, greatest(s.sid % 7, least(trim, coalesce(min(fork_offset // 2), trim))) AS floor
        FROM streams s LEFT JOIN forks ON source = s.sid WHERE s.sid = {SID} GROUP BY s.sid, trim""",
    "forks",
)
def inspect_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    pins = forks(spark, sf_dir, rows=rows).select(F.col("source").alias("sid"), F.expr("fork_offset div 2").alias("start"))
    return I.retention(streams(spark, sf_dir, rows).withColumn("reclaimed", F.col("sid") % 7), pins, SID)


@query("SELECT DISTINCT partition FROM kv_log", "kv_log")
def inspect_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.partitions(kv_log(spark, sf_dir))


@query(
    """SELECT id, CAST(strlen(body) AS INTEGER) AS size, CASE WHEN strlen(body) <= 16384 THEN 'inline' ELSE 'object' END AS storage
       FROM files WHERE partition = 'src3' AND id > '0000000050' ORDER BY id LIMIT 50""",
    "files",
)
def inspect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.file_page(files(spark, sf_dir), "src3", after="0000000050")


@query("SELECT id, CAST(strlen(body) AS BIGINT) AS size, 'ok' AS outcome, sha256(body) AS part_sha256 FROM files WHERE id = '0000000011'", "files")
def inspect_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that ends beyond the body gives all of it."""
    return I.object_range(files(spark, sf_dir), "0000000011", 0, 1_000_000_000).select("id", "size", "outcome", F.sha2("part", 256).alias("part_sha256"))


@query(
    f"""WITH c AS (SELECT max(snapshot_offset) AS f FROM log_snapshots WHERE base = {BASE})
       SELECT base, 'entry' AS kind, entry_offset AS at FROM log_entries, c WHERE base = {BASE} AND entry_offset >= coalesce(f, 0)
       UNION ALL SELECT {BASE}, 'snapshot', f FROM c WHERE f IS NOT NULL""",
    "log_snapshots",
)
def inspect_log_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.log_content(log_snapshots(spark, sf_dir), log_entries(spark, sf_dir), BASE)


@query(f"SELECT base, seq, entry_offset FROM log_entries WHERE base = {BASE} AND entry_offset >= 50 ORDER BY entry_offset LIMIT 50", "log_entries")
def inspect_log_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.log_component(log_entries(spark, sf_dir), BASE, start=50).select("base", "seq", "entry_offset")


@query("SELECT DISTINCT '/events/' || user_id AS base FROM events")
def inspect_log_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.log_bases(messages(spark, sf_dir).select("path"))


@query("SELECT min(source) AS shard FROM documents WHERE n_chars > 2000")
def inspect_first_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has a long document."""
    counts = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("shard")).agg(F.count_if(F.col("n_chars") > 2000).alias("n"))
    return I.first_shard_with_rows(counts)


# --- checkpoints

_MANIFEST = """SELECT o_orderkey AS id, 'cp' || o_custkey % 10 AS name, o_orderkey * 3 AS max_seq, epoch_us(o_orderdate) // 1000 AS created_ms,
  CASE WHEN o_orderkey % 3 > 0 THEN epoch_us(o_orderdate) // 1000 + o_orderkey % 3 * 86400000 * 400 END AS expires_ms FROM orders"""
_NOW = 852_076_800_000  # a day among the orders


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3 * DAY_MS * 400)
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cp"), F.col("o_custkey") % 10).alias("name"), (F.col("o_orderkey") * 3).alias("max_seq"), millis("o_orderdate").alias("created_ms"), life.alias("life"))
    return rows.select("id", "name", "max_seq", "created_ms", (F.col("created_ms") + F.col("life")).alias("expires_ms"))


@query(f"WITH m AS ({_MANIFEST}) SELECT id, name, max_seq, expires_ms FROM m WHERE name = 'cp4' AND created_ms <= {_NOW} AND (expires_ms IS NULL OR expires_ms > {_NOW})")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checkpoints: those of one name that exist and have not expired at a day."""
    return stores.list_checkpoints(_manifest(spark, sf_dir).where(F.col("created_ms") <= _NOW), _NOW, "cp4").select("id", "name", "max_seq", "expires_ms")


@query(
    f"""WITH m AS ({_MANIFEST}), r AS (SELECT id, name, max_seq, CASE WHEN id % 4 = 1 THEN {_NOW} + 1000 ELSE expires_ms END AS expires_ms FROM m WHERE id % 4 <> 2)
        SELECT name, count(*) AS n, count(*) FILTER (expires_ms <= {_NOW}) AS expired, min(max_seq) AS least_seq FROM r GROUP BY name"""
)
def checkpoint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After some checkpoints were deleted and some given another second to live: how many are left, and how many of these expired."""
    rows = _manifest(spark, sf_dir)
    rows = stores.delete_checkpoints(rows, rows.where("id % 4 = 2").select("id"))
    rows = stores.refresh_checkpoints(rows, rows.where("id % 4 = 1").select("id"), _NOW, 1000)
    expired = F.count_if(F.coalesce(F.col("expires_ms") <= _NOW, F.lit(False)))
    return rows.groupBy("name").agg(F.count("*").alias("n"), expired.alias("expired"), F.min("max_seq").alias("least_seq"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'new' WHEN c_nationkey % 5 = 1 THEN 'shards_changed' WHEN c_nationkey % 5 = 2 THEN 'hash_changed' ELSE 'ok' END AS outcome FROM customer"""
)
def layout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clusters: what opening with 16 shards and hash xxh64 says, given what was pinned."""
    kind = F.col("c_nationkey") % 5
    pinned = F.when(kind > 0, F.struct(F.when(kind == 1, 8).otherwise(16).alias("shards"), F.when(kind == 2, "other").otherwise("xxh64").alias("hash")))
    return read(spark, sf_dir, "customer").select("c_custkey", stores.layout_outcome(pinned, 16, "xxh64").alias("outcome"))


# --- writes


@query("SELECT seq, CASE WHEN create_ts + amount % 7 * 1000 < create_ts + seq % 5 * 1000 THEN 'ok' ELSE 'deadline_exceeded' END AS outcome FROM kv_log", "kv_log")
def deadline_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that reach their partition's writer some seconds later, with a deadline."""
    rows = kv_log(spark, sf_dir)
    return rows.select("seq", kv.deadline_outcome(F.col("create_ts") + F.col("amount") % 7 * 1000, F.col("create_ts") + F.col("seq") % 5 * 1000).alias("outcome"))


@query(
    """WITH o AS (SELECT partition, key, op, 'mine-' || seq AS value, row_number() OVER (PARTITION BY partition, key ORDER BY seq DESC) AS k FROM kv_log WHERE batch % 50 = 7),
       t AS (SELECT * FROM o WHERE k = 1)
       SELECT partition, key, value, CAST(NULL AS BIGINT) AS seq FROM t WHERE op <> 'delete'
       UNION ALL SELECT s.partition, s.key, s.value, s.seq FROM kv_state s ANTI JOIN t ON t.partition = s.partition AND t.key = s.key""",
    "kv_state",
)
def read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan inside a transaction that has put and deleted some keys: its own rows have no version yet."""
    log = kv_log(spark, sf_dir)
    overlay = log.where("batch % 50 = 7").select("partition", "key", "op", F.concat(F.lit("mine-"), "seq").alias("value"), F.col("seq").alias("place"))
    return kv.overlaid(kv.state(log).select("partition", "key", "value", "seq"), overlay)


@query(
    """WITH w AS (SELECT s.sid, s.sid % 16 AS grp, s.sid % 3 AS kind, s.sid * 2 AS other, CASE WHEN s.sid % 2 = 0 THEN tail ELSE tail + 1 END AS expected, s.sid % 5 > 0 AS unsealed, tail FROM streams s)
       SELECT sid, CASE WHEN unsealed AND grp % 4 = 1 THEN 'sealed' WHEN kind = 1 AND other IN (SELECT sid FROM streams) THEN 'conflict'
                        WHEN kind = 2 AND expected <> tail THEN 'conflict' ELSE 'ok' END AS outcome FROM w""",
    "streams",
)
def guarded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to groups: some want the group unsealed, some a path to be absent, some a stream to end where they saw it end."""
    rows = streams(spark, sf_dir).select("sid", "tail").withColumn("grp", F.col("sid") % 16)
    writes = rows.select(
        F.col("sid").alias("id"), "grp", (F.col("sid") % 5 > 0).alias("unsealed"),
        F.when(F.col("sid") % 3 == 1, F.col("sid") * 2).alias("absent"), F.when(F.col("sid") % 3 == 2, F.col("sid")).alias("identity"), (F.col("tail") + F.col("sid") % 2).alias("offset"),
    )
    return S.guarded(writes, rows.where("grp % 4 = 1").select("grp").distinct(), rows.select("sid", "tail")).select(F.col("id").alias("sid"), "outcome")


@query(
    f"""SELECT doc_id, doc_id * 1000 + {DAY_MS} AS due_ms, doc_id * 1000 + {DAY_MS} <= (SELECT max(doc_id) FROM documents) * 500 + {DAY_MS} AS due
        FROM documents WHERE lang = 'en' AND strlen(text) > 16384"""
)
def deleted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as deleted files: when their bodies go, a day after; small ones were inline and have none."""
    rows = read(spark, sf_dir, "documents")
    gone = rows.where("lang = 'en'").select("doc_id", F.octet_length("text").alias("size"), (F.col("doc_id") * 1000).alias("deleted_ms"))
    now = rows.agg((F.max("doc_id") * 500 + DAY_MS).alias("now"))
    return FS.deleted_bodies(gone, DAY_MS).join(F.broadcast(now)).select("doc_id", "due_ms", (F.col("due_ms") <= F.col("now")).alias("due"))


# --- codecs


@query(
    """WITH k AS (SELECT event_id, substr(props, 1, 6) AS cut, strlen(props) AS size, CASE event_id % 4 WHEN 0 THEN substr(props, 1, 6) WHEN 1 THEN substr(props, 1, 3) WHEN 2 THEN props ELSE 'm' END AS bound FROM events),
       h AS (SELECT *, substr(bound, 1, least(strlen(cut), strlen(bound))) AS head FROM k)
       SELECT event_id, CASE WHEN size = strlen(cut) THEN CASE WHEN cut > bound THEN 'gt' WHEN cut < bound THEN 'lt' ELSE 'eq' END
                             WHEN cut > head THEN 'gt' WHEN cut < head THEN 'lt' WHEN strlen(bound) <= strlen(cut) THEN 'gt' ELSE 'unknown' END AS ordering FROM h"""
)
def cut_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How keys that are known by their first bytes and their size stand to a bound."""
    bound = F.expr("CASE event_id % 4 WHEN 0 THEN substring(props, 1, 6) WHEN 1 THEN substring(props, 1, 3) WHEN 2 THEN props ELSE 'm' END")
    return read(spark, sf_dir, "events").select("event_id", codecs.cut_order(F.substring("props", 1, 6), F.octet_length("props"), bound).alias("ordering"))


_HEADERS = "CASE event_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '0' || event_id WHEN 2 THEN '-5' WHEN 3 THEN '' WHEN 4 THEN event_id || ' ' WHEN 5 THEN NULL WHEN 6 THEN '1e3' ELSE '' || event_id END"


@query(
    f"""WITH h AS (SELECT event_id, {_HEADERS} AS header FROM events)
        SELECT event_id, CASE WHEN header IS NULL THEN 'absent' WHEN regexp_full_match(header, '0|[1-9][0-9]*') THEN 'ok' ELSE 'bad_request' END AS outcome,
               CASE WHEN regexp_full_match(header, '0|[1-9][0-9]*') THEN CAST(header AS BIGINT) END AS number FROM h"""
)
def integer_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read(spark, sf_dir, "events").select("event_id", codecs.header_integer(F.expr(_HEADERS.replace("'' || event_id", "cast(event_id as string)"))).alias("h"))
    return parsed.select("event_id", "h.outcome", "h.number")


@query()
def file_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in each of 64 buckets of a hash of their reference; the hash is Spark's."""
    return files(spark, sf_dir).groupBy(F.pmod(F.xxhash64("partition", "id"), F.lit(64)).alias("bucket")).agg(F.count("*").alias("n"))
