"""Offsets, pages, retention, forks and tokens of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import codecs
from ledgerloom.operators import streams as S
from ledgerloom.operators.sequences import prefix_filter
from ledgerloom.sources.tables import DAY_MS, files, forks, messages, stored_messages, streams

from .registry import query


@query("SELECT sid, seq, msg_offset, next_offset FROM messages", "messages")
def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("sid", "seq", "msg_offset", "next_offset")


@query(
    """WITH m AS (SELECT m.*, coalesce(sum(strlen(body)) OVER (PARTITION BY m.sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
                  FROM messages m JOIN streams s ON s.sid = m.sid WHERE msg_offset >= trim)
       SELECT sid, seq, msg_offset, next_offset FROM m WHERE used < 64""",
    "streams",
)
def stream_read_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored_messages(spark, sf_dir)
    rows = own.join(streams(spark, sf_dir, own).select("sid", "trim"), "sid")
    return S.read_page(rows, F.col("trim"), 64).select("sid", "seq", "msg_offset", "next_offset")


@query(
    """SELECT sid, sid * 37 % (tail + 50) AS asked, CASE WHEN sid * 37 % (tail + 50) < trim THEN 'trimmed' WHEN sid * 37 % (tail + 50) > tail THEN 'offset_beyond_tail'
              WHEN sid * 37 % (tail + 50) < tail THEN 'data' WHEN sid % 3 = 0 THEN 'closed' ELSE 'up_to_date' END AS outcome FROM streams
       UNION ALL SELECT sid, tail, CASE WHEN sid % 3 = 0 THEN 'closed' ELSE 'up_to_date' END FROM streams""",
    "streams",
)
def stream_read_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir)
    asked = rows.withColumn("asked", F.explode(F.array(F.col("sid") * 37 % (F.col("tail") + 50), F.col("tail"))))
    return asked.select("sid", "asked", S.read_outcome(F.col("asked"), F.col("trim"), F.col("tail"), F.col("sid") % 3 == 0).alias("outcome"))


_TOKEN = """CASE event_id % 6 WHEN 0 THEN 'start' WHEN 1 THEN 'now' WHEN 2 THEN '0000000000000000_' || lpad(CAST(event_id AS VARCHAR), 16, '0')
            WHEN 3 THEN '0000000000000001_' || lpad(CAST(event_id AS VARCHAR), 16, '0') WHEN 4 THEN '0000000000000000_' || event_id ELSE ' 0000000000000000_0000000000000001' END"""


@query(
    f"""WITH t AS (SELECT event_id, {_TOKEN} AS token FROM events)
       SELECT event_id, token, CASE WHEN token IN ('start', 'now') THEN token WHEN regexp_full_match(token, '0{{16}}_[0-9]{{16}}') THEN 'offset' ELSE 'bad_offset' END AS kind,
              CASE WHEN regexp_full_match(token, '0{{16}}_[0-9]{{16}}') THEN CAST(substr(token, 18) AS BIGINT) END AS value FROM t"""
)
def offset_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr(_TOKEN.replace("VARCHAR", "STRING"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", token.alias("token"))
    return rows.select("event_id", "token", codecs.parse_offset(F.col("token")).alias("p")).select("event_id", "token", "p.kind", "p.value")


@query("SELECT sid, seq, '0000000000000000_' || lpad(CAST(msg_offset AS VARCHAR), 16, '0') AS token FROM messages", "messages")
def offset_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("sid", "seq", codecs.offset_token(F.col("msg_offset")).alias("token"))


@query(
    """WITH f AS (SELECT id, strlen(body) AS n FROM files)
       SELECT id, CAST(p AS INTEGER) AS part, CAST(least(4096, n - p * 4096) AS BIGINT) AS part_bytes
       FROM f, unnest(range(greatest((n + 4095) // 4096, 1))) t(p)""",
    "files",
)
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies cut at 4 KiB; the store's own limit of 256 KiB is a parameter."""
    parts = S.split_parts(files(spark, sf_dir).select("id", "body"), "body", 4096)
    return parts.select("id", "part", F.octet_length("bytes").cast("long").alias("part_bytes"))


@query("SELECT id, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM files", "files")
def message_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = S.join_parts(S.split_parts(files(spark, sf_dir).select("id", "body"), "body", 4096), ["id"])
    return whole.select("id", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))


@query("SELECT m.sid, m.seq, msg_offset FROM messages m JOIN streams s ON s.sid = m.sid WHERE msg_offset >= trim", "streams")
def stream_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trims = streams(spark, sf_dir).select("sid", "trim")
    return messages(spark, sf_dir).join(trims, "sid").where("msg_offset >= trim").select("sid", "seq", "msg_offset")


_NOW = "(SELECT max(last_access_ms) + 86400000 FROM streams)"


def _with_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams(spark, sf_dir)
    now = rows.agg((F.max("last_access_ms") + DAY_MS).alias("now"))
    absolute = F.when(F.col("sid") % 11 == 0, F.lit(1_705_000_000_000))
    return rows.crossJoin(F.broadcast(now)).withColumn("deadline_ms", S.deadline(absolute, F.col("last_access_ms"), F.col("ttl_s")))


_DEADLINE = "coalesce(CASE WHEN sid % 11 = 0 THEN 1705000000000 END, last_access_ms + ttl_s * 1000)"


@query(f"SELECT sid, {_DEADLINE} AS deadline_ms, coalesce({_NOW} >= {_DEADLINE}, false) AS expired FROM streams", "streams")
def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_deadline(spark, sf_dir).select("sid", "deadline_ms", F.coalesce(F.col("now") >= F.col("deadline_ms"), F.lit(False)).alias("expired"))


@query(f"SELECT sid, {_DEADLINE} AS deadline_ms FROM streams WHERE {_DEADLINE} <= {_NOW} ORDER BY deadline_ms, sid LIMIT 1000", "streams")
def expiry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep takes at most 1,000 streams at a time, the longest overdue first."""
    return _with_deadline(spark, sf_dir).where("deadline_ms <= now").select("sid", "deadline_ms").orderBy("deadline_ms", "sid").limit(1000)


@query("SELECT s.sid, count(f.sid) AS forks, CASE WHEN count(f.sid) > 0 THEN 'gone' ELSE 'deleted' END AS state FROM streams s LEFT JOIN forks f ON f.source = s.sid GROUP BY s.sid", "forks")
def stream_delete_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting a stream that has forks leaves it gone, its messages kept for them."""
    counts = forks(spark, sf_dir).groupBy(F.col("source").alias("sid")).agg(F.count("*").alias("forks"))
    rows = streams(spark, sf_dir).select("sid").join(counts, "sid", "left").withColumn("forks", F.coalesce("forks", F.lit(0)).cast("long"))
    return rows.select("sid", "forks", F.when(F.col("forks") > 0, "gone").otherwise("deleted").alias("state"))


_FLOOR = """f AS (SELECT s.sid, greatest(s.sid % 7, least(trim, coalesce(min(fork_offset // 2), trim))) AS floor
                  FROM streams s LEFT JOIN forks ON source = s.sid GROUP BY s.sid, trim)"""


def _floors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    pins = forks(spark, sf_dir, rows=rows).select(F.col("source").alias("sid"), F.expr("fork_offset div 2").alias("start"))
    return S.reclaim_floor(streams(spark, sf_dir, rows).withColumn("reclaimed", F.col("sid") % 7), pins)


@query(f"WITH {_FLOOR} SELECT sid, floor FROM f", "forks")
def reclaim_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir, stored_messages(spark, sf_dir))


@query(f"WITH {_FLOOR} SELECT m.sid, m.seq, msg_offset FROM messages m JOIN f ON f.sid = m.sid WHERE msg_offset < floor", "forks")
def reclaimable_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    return rows.join(_floors(spark, sf_dir, rows), "sid").where("msg_offset < floor").select("sid", "seq", "msg_offset")


@query(
    """WITH RECURSIVE d(sid, depth) AS (SELECT sid, 0 FROM streams WHERE sid NOT IN (SELECT sid FROM forks)
         UNION ALL SELECT f.sid, d.depth + 1 FROM forks f JOIN d ON f.source = d.sid)
       SELECT sid, depth FROM d""",
    "forks",
)
def fork_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    ranges = S.lineage(rows.select("sid").distinct(), forks(spark, sf_dir, rows=rows))
    return ranges.groupBy(F.col("reader").alias("sid")).agg(F.max("level").alias("depth"))


@query(
    """WITH RECURSIVE s AS (SELECT t.sid, f.source, coalesce(f.fork_offset, 0) AS lo FROM streams t LEFT JOIN forks f ON f.sid = t.sid),
       r(reader, sid, lo, hi, source) AS (SELECT sid, sid, lo, 9223372036854775807, source FROM s
         UNION ALL SELECT r.reader, s.sid, s.lo, least(r.hi, r.lo), s.source FROM r JOIN s ON s.sid = r.source)
       SELECT reader, r.sid, msg_offset + lo AS start, seq FROM r JOIN messages m ON m.sid = r.sid WHERE msg_offset + lo < hi""",
    "forks",
)
def fork_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_messages(spark, sf_dir)
    return S.fork_read(rows, S.lineage(rows.select("sid").distinct(), forks(spark, sf_dir, rows=rows)))


@query("SELECT sid, seq, substr(body, 1, CAST(seq % 5 AS BIGINT)) AS prefix, msg_offset FROM messages", "messages")
def fork_sub_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork inside a message takes that many bytes of its body (bodies here are ASCII)."""
    return messages(spark, sf_dir).select("sid", "seq", F.col("body").substr(F.lit(1), (F.col("seq") % 5).cast("int")).alias("prefix"), "msg_offset")


@query("SELECT 100000 + m.sid AS sid, m.seq, msg_offset FROM messages m JOIN streams s ON s.sid = m.sid WHERE msg_offset >= trim AND msg_offset < tail // 2", "streams")
def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).join(streams(spark, sf_dir).select("sid", "trim", "tail"), "sid")
    return S.copy_range(rows, F.col("trim"), F.expr("tail div 2"), F.col("sid") + 100_000).select("sid", "seq", "msg_offset")


@query(
    """WITH c AS (SELECT sid, sid % 16 AS grp, min(seq) AS created FROM messages GROUP BY sid), g AS (SELECT grp, min(created) + 40 AS sealed FROM c WHERE grp % 3 = 0 GROUP BY grp)
       SELECT c.sid, c.grp, c.created, sealed IS NOT NULL AND created > sealed AS rejected FROM c LEFT JOIN g ON g.grp = c.grp""",
    "messages",
)
def sealed_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams created in a group after its seal are refused."""
    created = messages(spark, sf_dir).groupBy("sid").agg(F.min("seq").alias("created")).withColumn("grp", F.col("sid") % 16)
    seals = created.where("grp % 3 = 0").groupBy("grp").agg((F.min("created") + 40).alias("sealed"))
    return created.join(seals, "grp", "left").select("sid", "grp", "created", F.coalesce(F.col("created") > F.col("sealed"), F.lit(False)).alias("rejected"))


@query(
    "SELECT sid, CASE WHEN sid % 10 = 9 THEN 'deleted' WHEN tail > sid * 37 % (tail + 50) THEN 'data' WHEN sid % 3 = 0 THEN 'closed' ELSE 'none' END AS reason FROM streams",
    "streams",
)
def wake_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("sid") * 37 % (F.col("tail") + 50)
    reason = F.when(F.col("sid") % 10 == 9, "deleted").when(F.col("tail") > asked, "data").when(F.col("sid") % 3 == 0, "closed").otherwise("none")
    return streams(spark, sf_dir).select("sid", reason.alias("reason"))


@query("SELECT DISTINCT path, '/events/' || sid AS placement_key FROM messages", "messages")
def placement_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("path").distinct().select("path", codecs.placement_key(F.col("path")).alias("placement_key"))


@query("SELECT sid, sid || ':' || trim || ':' || tail || CASE WHEN sid % 3 = 0 THEN ':c' ELSE '' END AS etag FROM streams", "streams")
def page_etag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(spark, sf_dir).select("sid", F.concat(F.col("sid"), F.lit(":"), F.col("trim"), F.lit(":"), F.col("tail"), F.when(F.col("sid") % 3 == 0, ":c").otherwise("")).alias("etag"))


@query("SELECT event_id, CAST(floor(((epoch_us(ts) // 1000) - 1728432000000) / 20000) AS BIGINT) AS cursor FROM events")
def wire_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", codecs.wire_cursor(F.unix_millis(F.col("ts").cast("timestamp"))).alias("cursor"))


@query(f"SELECT sid, {_NOW} - last_access_ms AS idle_ms FROM streams WHERE {_NOW} - last_access_ms >= 172800000", "streams")
def repair_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending work without progress for longer than the grace (two days here; the service's hour is a parameter)."""
    idle = F.col("now") - F.col("last_access_ms")
    return _with_deadline(spark, sf_dir).where(idle >= 2 * DAY_MS).select("sid", idle.alias("idle_ms"))


@query("SELECT DISTINCT path FROM messages WHERE starts_with(path, '/events/1') AND sid % 10 <> 9 ORDER BY path", "messages")
def stream_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams under a prefix that are neither deleted nor pending."""
    return messages(spark, sf_dir).where(prefix_filter("path", "/events/1") & (F.col("sid") % 10 != 9)).select("path").distinct().orderBy("path")


@query(
    """SELECT f.sid, f.source, s.tail AS source_tail, s.trim AS source_trim FROM forks f LEFT JOIN streams s ON s.sid = f.source""",
    "forks",
)
def registration_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = streams(spark, sf_dir).select(F.col("sid").alias("source"), F.col("tail").alias("source_tail"), F.col("trim").alias("source_trim"))
    return forks(spark, sf_dir).select("sid", "source").join(source, "source", "left").select("sid", "source", "source_tail", "source_trim")
