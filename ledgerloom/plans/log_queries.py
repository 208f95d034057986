"""Snapshot logs, files, documents and their codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import frames
from ledgerloom.operators import files as FS
from ledgerloom.operators import logs as L
from ledgerloom.sources.tables import DAY_MS, files, log_entries, log_index, log_snapshots, read

from .registry import query


@query(
    """SELECT base, CASE WHEN asked < trim THEN 'reset' WHEN asked >= tail THEN 'up_to_date' ELSE 'entries' END AS outcome, CASE WHEN asked < trim THEN trim ELSE asked END AS next_from
       FROM (SELECT base, max(next_offset) AS tail, coalesce(max(CASE WHEN seq % 3 = 2 THEN next_offset END), 0) AS trim, base * 97 % 400 AS asked FROM log_entries GROUP BY base)""",
    "log_entries",
)
def log_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader behind the trim is told to start again at the snapshot."""
    rows = log_entries(spark, sf_dir).groupBy("base").agg(F.max("next_offset").alias("tail"), F.coalesce(F.max(F.when(F.col("seq") % 3 == 2, F.col("next_offset"))), F.lit(0)).alias("trim"))
    rows = rows.withColumn("asked", F.col("base") * 97 % 400)
    outcome = F.when(F.col("asked") < F.col("trim"), "reset").when(F.col("asked") >= F.col("tail"), "up_to_date").otherwise("entries")
    return rows.select("base", outcome.alias("outcome"), F.when(F.col("asked") < F.col("trim"), F.col("trim")).otherwise(F.col("asked")).alias("next_from"))


_INDEX = """i AS (SELECT base, seq AS pos, CASE WHEN seq % 7 <> 5 THEN next_offset END AS snapshot_offset, seq % 11 = 10 AS deleted FROM log_entries WHERE seq % 3 = 2)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_entries(spark, sf_dir).where("seq % 3 = 2")
    return rows.select("base", F.col("seq").alias("at"), F.when(F.col("seq") % 7 != 5, F.col("next_offset")).alias("snapshot_offset"), (F.col("seq") % 11 == 10).alias("deleted"))


@query(
    f"""WITH {_INDEX} SELECT base, CASE WHEN NOT bool_or(deleted) THEN arg_max(snapshot_offset, pos) FILTER (snapshot_offset IS NOT NULL) END AS snapshot_offset, bool_or(deleted) AS deleted FROM i GROUP BY base""",
    "log_entries",
)
def log_current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_snapshots(_index(spark, sf_dir))


@query(
    """WITH o AS (SELECT *, (o_orderkey * 7919) % 1000 AS offered FROM orders),
       p AS (SELECT o_orderkey, o_custkey, offered, max(offered) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o)
       SELECT o_orderkey, CASE WHEN offered > 900 THEN 'beyond_tail' WHEN best IS NULL OR offered > best THEN 'current' WHEN offered = best THEN 'after' ELSE 'superseded' END AS outcome FROM p"""
)
def log_publish_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is published unless a later one already was (order keys as time, one log for each customer)."""
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    rows = read(spark, sf_dir, "orders").withColumn("offered", F.col("o_orderkey") * 7919 % 1000).withColumn("best", F.max("offered").over(before))
    outcome = F.when(F.col("offered") > 900, "beyond_tail").when(F.col("best").isNull() | (F.col("offered") > F.col("best")), "current").when(F.col("offered") == F.col("best"), "after").otherwise("superseded")
    return rows.select("o_orderkey", outcome.alias("outcome"))


RULES = [(30 * DAY_MS, 365 * DAY_MS), (DAY_MS, 7 * DAY_MS)]
_KEPT = """r(every, keep) AS (VALUES (2592000000, 31536000000), (86400000, 604800000)), n AS (SELECT max(created_ms) + 86400000 AS now FROM log_index),
       l AS (SELECT every, keep, created_ms // every AS bucket, max(created_ms) AS c, max(snap_offset) AS s FROM log_index, r GROUP BY every, keep, created_ms // every),
       kept AS (SELECT DISTINCT s AS snap_offset FROM l, n WHERE now - c < keep)"""


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = log_index(spark, sf_dir)
    now = index.agg(F.max("created_ms")).first()[0] + DAY_MS
    return index, L.kept_history(index, RULES, now)


@query(f"WITH {_KEPT} SELECT snap_offset FROM kept", "log_index")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir)[1]


@query(f"WITH {_KEPT} SELECT snap_offset FROM log_index WHERE snap_offset < (SELECT max(snap_offset) FROM log_index) AND snap_offset NOT IN (SELECT snap_offset FROM kept)", "log_index")
def snapshot_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored snapshots before the current one that no rule names."""
    index, kept = _kept(spark, sf_dir)
    current = index.agg(F.max("snap_offset").alias("current"))
    return index.select("snap_offset").join(kept, "snap_offset", "left_anti").join(F.broadcast(current)).where("snap_offset < current").select("snap_offset")


@query(f"WITH {_KEPT} SELECT snap_offset, false AS current FROM kept WHERE snap_offset % 3 > 0 AND snap_offset < (SELECT max(snap_offset) FROM log_index) UNION ALL SELECT max(snap_offset), true FROM log_index", "log_index")
def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot and those kept ones that are still stored (two of three here)."""
    index, kept = _kept(spark, sf_dir)
    current = index.agg(F.max("snap_offset").alias("snap_offset"))
    stored = index.where("snap_offset % 3 > 0").select("snap_offset")
    older = kept.join(stored, "snap_offset", "left_semi").join(current, "snap_offset", "left_anti")
    return older.withColumn("current", F.lit(False)).unionByName(current.withColumn("current", F.lit(True)))


@query(
    """WITH c AS (SELECT base, max(snapshot_offset) AS f FROM log_snapshots GROUP BY base)
       SELECT base, 'snapshot' AS kind, f AS at FROM c
       UNION ALL SELECT e.base, 'entry', entry_offset FROM log_entries e LEFT JOIN c ON c.base = e.base WHERE entry_offset >= coalesce(f, 0)""",
    "log_snapshots",
)
def log_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reconstruct(log_snapshots(spark, sf_dir), log_entries(spark, sf_dir))


@query(
    """WITH a AS (SELECT base, arg_min(next_offset, seq) FILTER (seq >= 1) AS pos FROM log_entries GROUP BY base)
       SELECT e.base, e.seq, entry_offset FROM log_entries e JOIN a ON a.base = e.base WHERE next_offset <= pos""",
    "log_entries",
)
def log_history_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries up to an offset that is a message's boundary: the end of the first turn from 1 on."""
    rows = log_entries(spark, sf_dir)
    at = rows.where("seq >= 1").groupBy("base").agg(F.min_by("next_offset", "seq").alias("at"))
    return rows.join(at, "base").where("next_offset <= at").select("base", "seq", "entry_offset")


@query(
    """WITH k AS (SELECT * FROM log_entries WHERE (base + seq) % 4 <> 0), g AS (SELECT base, entry_offset, coalesce(lag(next_offset) OVER (PARTITION BY base ORDER BY entry_offset) <> entry_offset, true) AS broken FROM k)
       SELECT base, max(entry_offset) AS retained_from FROM g WHERE broken GROUP BY base""",
    "log_entries",
)
def contiguous_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contiguous_suffix(log_entries(spark, sf_dir).where("(base + seq) % 4 <> 0"))


@query(
    """WITH c AS (SELECT base, max(snapshot_offset) AS s FROM log_snapshots GROUP BY base)
       SELECT e.base + 1000000 AS base, c.s AS snapshot_offset, e.seq, entry_offset FROM log_entries e LEFT JOIN c ON c.base = e.base WHERE entry_offset >= coalesce(s, 0)""",
    "log_snapshots",
)
def log_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forked log refers to its source's current snapshot and inherits the entries after it."""
    current = log_snapshots(spark, sf_dir).groupBy("base").agg(F.max("snapshot_offset").alias("snapshot_offset"))
    rows = log_entries(spark, sf_dir).join(current, "base", "left").where("entry_offset >= coalesce(snapshot_offset, 0)")
    return rows.select((F.col("base") + 1_000_000).alias("base"), "snapshot_offset", "seq", "entry_offset")


@query("SELECT DISTINCT '/events/' || user_id AS base FROM events WHERE user_id % 2 = 0")
def log_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that parse as <base>/.updates are logs."""
    suffix = F.when(F.col("user_id") % 2 == 0, "/.updates").otherwise("/data")
    paths = read(spark, sf_dir, "events").select(F.concat(F.lit("/events/"), F.col("user_id"), suffix).alias("path")).distinct()
    return paths.select(F.regexp_extract("path", r"^(.+)/\.updates$", 1).alias("base")).where("base <> ''")


@query(
    """WITH c AS (SELECT o_custkey AS log, o_orderkey AS pos, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'deleted' ELSE 'ready' END AS state FROM orders)
       SELECT log, arg_max(state, pos) AS state, CASE arg_max(state, pos) WHEN 'ready' THEN 'ok' WHEN 'pending' THEN 'busy' ELSE 'deleted' END AS access FROM c GROUP BY log"""
)
def log_access_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access by the last control record of each log."""
    names = F.array(*map(F.lit, ("pending", "ready", "cancelled", "deleted", "ready")))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("at"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("state"))
    last = rows.groupBy("log").agg(F.max_by("state", "at").alias("state"))
    return last.select("log", "state", F.when(F.col("state") == "ready", "ok").when(F.col("state") == "pending", "busy").otherwise("deleted").alias("access"))


@query("SELECT o_orderkey AS work, CASE o_orderkey % 15 WHEN 0 THEN 'create' WHEN 5 THEN 'fork' ELSE 'delete' END AS kind FROM orders WHERE o_orderkey % 5 = 0")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 15 == 0, "create").when(F.col("o_orderkey") % 15 == 5, "fork").otherwise("delete")
    return read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("work"), kind.alias("kind"))


@query(
    """WITH c AS (SELECT base, max(snapshot_offset) AS s, count(*) AS snapshots FROM log_snapshots GROUP BY base), e AS (SELECT base, count(*) AS entries, max(next_offset) AS tail FROM log_entries GROUP BY base)
       SELECT e.base, entries, tail, coalesce(snapshots, 0) AS snapshots, CASE WHEN s IS NULL THEN 'not_selected' WHEN s = tail THEN 'current' ELSE 'retained' END AS selected FROM e LEFT JOIN c ON c.base = e.base""",
    "log_snapshots",
)
def log_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = log_snapshots(spark, sf_dir).groupBy("base").agg(F.max("snapshot_offset").alias("s"), F.count("*").alias("snapshots"))
    rows = log_entries(spark, sf_dir).groupBy("base").agg(F.count("*").alias("entries"), F.max("next_offset").alias("tail")).join(current, "base", "left")
    selected = F.when(F.col("s").isNull(), "not_selected").when(F.col("s") == F.col("tail"), "current").otherwise("retained")
    return rows.select("base", "entries", "tail", F.coalesce("snapshots", F.lit(0)).cast("long").alias("snapshots"), selected.alias("selected"))


# --- files


@query("SELECT partition, id, CAST(strlen(body) AS BIGINT) AS size, CASE WHEN strlen(body) <= 16384 THEN 'inline' ELSE 'object' END AS storage FROM files", "files")
def file_storage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("body").cast("long")
    return files(spark, sf_dir).select("partition", "id", size.alias("size"), FS.storage_class(size).alias("storage"))


@query("SELECT partition, id, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS sha256 FROM files", "files")
def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("partition", "id", F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))


_RANGES = [("0", "99", "NULL"), ("500", "NULL", "NULL"), ("NULL", "NULL", "64"), ("3", "2", "NULL"), ("1000000000", "NULL", "NULL")]


@query(
    f"""WITH q(a, b, c) AS (VALUES {', '.join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT))" for a, b, c in _RANGES)}),
       f AS (SELECT id, a, b, c, CAST(strlen(body) AS BIGINT) AS size FROM files, q),
       g AS (SELECT *, CASE WHEN c IS NOT NULL THEN greatest(size - c, 0) ELSE a END AS lo, CASE WHEN c IS NOT NULL OR b IS NULL THEN size - 1 ELSE least(b, size - 1) END AS hi FROM f),
       h AS (SELECT *, CASE WHEN coalesce(a < 0 OR b < a OR c < 0, false) THEN 'invalid_range' WHEN lo >= size THEN 'range_not_satisfiable' ELSE 'ok' END AS outcome FROM g)
       SELECT id, a, b, c, outcome, CASE WHEN outcome = 'ok' THEN lo END AS first, CASE WHEN outcome = 'ok' THEN hi END AS last FROM h""",
    "files",
)
def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*(F.struct(*(F.expr(f"CAST({v} AS BIGINT)").alias(n) for n, v in zip("abc", r, strict=True))) for r in _RANGES))
    rows = files(spark, sf_dir).select("id", F.octet_length("body").cast("long").alias("size"), F.explode(asked).alias("q")).select("id", "size", "q.*")
    return rows.withColumn("r", FS.clamp_range(F.col("a"), F.col("b"), F.col("c"), F.col("size"))).select("id", "a", "b", "c", "r.outcome", "r.first", "r.last")


@query("SELECT id, doc_id FROM files WHERE partition = 'src3' AND id > '0000000050' ORDER BY id LIMIT 20", "files")
def file_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("partition = 'src3' AND id > '0000000050'").select("id", "doc_id").orderBy("id").limit(20)


@query(
    """WITH p AS (SELECT source, lang, doc_id, sha256(text) AS sha FROM documents), q AS (SELECT *, lag(sha) OVER (PARTITION BY source, lang ORDER BY doc_id) AS before FROM p)
       SELECT source, lang, doc_id, before IS NOT NULL AND before = sha AS unchanged, CAST(sum(CASE WHEN before IS NOT NULL AND before = sha THEN 0 ELSE 1 END) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM q"""
)
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts of one file for each (source, lang); a put of what is already there changes nothing."""
    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = read(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.sha2("text", 256).alias("sha"))
    rows = rows.withColumn("unchanged", F.coalesce(F.lag("sha").over(order) == F.col("sha"), F.lit(False)))
    return rows.withColumn("version", F.sum(F.when(F.col("unchanged"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("sha")


@query(
    """WITH k AS (SELECT page_id, page_id * 2 + u AS object FROM pages, unnest([0, 1, 2]) t(u) WHERE page_id * 1000 + 5000 <= (SELECT max(page_id) FROM pages) * 500)
       SELECT page_id, object FROM k WHERE object NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)"""
)
def sweep_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of due intents that no record refers to."""
    pages = read(spark, sf_dir, "pages")
    now = pages.agg((F.max("page_id") * 500).alias("now"))  # half of the intents are due
    due = pages.join(F.broadcast(now)).where("page_id * 1000 + 5000 <= now")
    keys = due.select("page_id", F.explode(F.array(*(F.col("page_id") * 2 + i for i in range(3)))).alias("object"))
    return FS.unreferenced(keys, read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("object")), ["object"]).select("page_id", "object")


@query("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def reconcile_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without a registration."""
    return FS.unreferenced(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), ["doc_id"])


@query(
    """WITH f AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0), o AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0), r AS (SELECT doc_id FROM labels)
       SELECT 'dangling' AS problem, doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM o)
       UNION ALL SELECT 'orphan', doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM f)
       UNION ALL SELECT 'leaked_registration', doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM o)"""
)
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    records, objects, registered = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 7 <> 0"), read(spark, sf_dir, "labels").select("doc_id")
    checks = (("dangling", records, objects), ("orphan", objects, records), ("leaked_registration", registered, objects))
    parts = [FS.unreferenced(a, b, ["doc_id"]).select(F.lit(name).alias("problem"), "doc_id") for name, a, b in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, source || '/' || doc_id AS object_key, l.doc_id IS NOT NULL AS registered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("registered", F.lit(True))
    rows = read(spark, sf_dir, "documents").join(known, "doc_id", "left")
    return rows.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("object_key"), F.coalesce("registered", F.lit(False)).alias("registered"))


# --- documents as logs of framed updates


@query("SELECT base, count(*) AS frames, CAST(sum(size - 4) AS BIGINT) AS bytes FROM log_entries GROUP BY base", "log_entries")
def frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries framed as length and bytes, several to a record, and read back."""
    rows = log_entries(spark, sf_dir).select("base", "seq", frames.frame(F.coalesce("body", F.lit("")).cast("binary")).alias("data"))
    records = rows.groupBy("base", F.expr("seq div 3").alias("record")).agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    records = records.select("base", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))
    parsed = records.select("base", F.explode(frames.parse_frames("data")).alias("f")).where("f.error IS NULL")
    return parsed.groupBy("base").agg(F.count("*").alias("frames"), F.sum(F.octet_length("f.data")).cast("long").alias("bytes"))


@query("SELECT event_id, user_id AS client_id, event_id AS clock, props AS state FROM events")
def awareness_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    coded = events.select("event_id", frames.encode_awareness("user_id", "event_id", "props").alias("data"))
    return coded.select("event_id", F.explode(frames.decode_awareness("data")).alias("a")).where("a.error IS NULL").select("event_id", "a.client_id", "a.clock", "a.state")


@query(
    """WITH l AS (SELECT user_id AS client_id, max(event_id) AS clock, arg_max(CASE WHEN event_type <> 'error' THEN props END, event_id) AS state, arg_max(event_type, event_id) AS kind, arg_max(epoch_us(ts) // 1000, event_id) AS ms FROM events GROUP BY user_id)
       SELECT client_id, clock, ms FROM l WHERE kind <> 'error' AND ms >= (SELECT max(epoch_us(ts) // 1000) - 86400000 FROM events)"""
)
def awareness_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each client; a null state removes it, and so does silence (a day here, 30 seconds in the service)."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", ms.alias("ms"))
    last = events.groupBy(F.col("user_id").alias("client_id")).agg(F.max("event_id").alias("clock"), F.max_by("event_type", "event_id").alias("kind"), F.max_by("ms", "event_id").alias("ms"))
    now = events.agg((F.max("ms") - DAY_MS).alias("since"))
    return last.join(F.broadcast(now)).where("kind <> 'error' AND ms >= since").select("client_id", "clock", "ms")


@query(
    """WITH c AS (SELECT base, max(snapshot_offset) AS f FROM log_snapshots GROUP BY base)
       SELECT e.base, count(*) FILTER (entry_offset >= coalesce(f, 0)) AS updates, CAST(coalesce(sum(size - 4) FILTER (entry_offset >= coalesce(f, 0)), 0) AS BIGINT) AS update_bytes, max(f) AS snapshot_offset
       FROM log_entries e LEFT JOIN c ON c.base = e.base GROUP BY e.base""",
    "log_snapshots",
)
def doc_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = log_snapshots(spark, sf_dir).groupBy("base").agg(F.max("snapshot_offset").alias("from"))
    rows = log_entries(spark, sf_dir).join(current, "base", "left").withColumn("in_tail", F.col("entry_offset") >= F.coalesce("from", F.lit(0)))
    return rows.groupBy("base").agg(F.count_if("in_tail").alias("updates"), F.coalesce(F.sum(F.when(F.col("in_tail"), F.col("size") - 4)), F.lit(0)).cast("long").alias("update_bytes"), F.max("from").alias("snapshot_offset"))


@query(
    """WITH c AS (SELECT base, max(snapshot_offset) AS f FROM log_snapshots GROUP BY base),
       b AS (SELECT e.base, coalesce(max(f), 0) AS snapshot_bytes, CAST(coalesce(sum(size) FILTER (entry_offset >= coalesce(f, 0)), 0) AS BIGINT) AS tail_bytes FROM log_entries e LEFT JOIN c ON c.base = e.base GROUP BY e.base)
       SELECT base, snapshot_bytes, tail_bytes, tail_bytes >= greatest(256, snapshot_bytes // 2) AS due FROM b""",
    "log_snapshots",
)
def doc_compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due when the updates since the snapshot reach half of it, 256 bytes at least (1 MiB in the service)."""
    current = log_snapshots(spark, sf_dir).groupBy("base").agg(F.max("snapshot_offset").alias("from"))
    rows = log_entries(spark, sf_dir).join(current, "base", "left")
    tail = F.coalesce(F.sum(F.when(F.col("entry_offset") >= F.coalesce("from", F.lit(0)), F.col("size"))), F.lit(0)).cast("long")
    sums = rows.groupBy("base").agg(F.coalesce(F.max("from"), F.lit(0)).alias("snapshot_bytes"), tail.alias("tail_bytes"))
    return sums.withColumn("due", F.col("tail_bytes") >= F.greatest(F.lit(256).cast("long"), F.expr("snapshot_bytes div 2")))


@query("SELECT DISTINCT '/docs/yjs/main/docs/' || conv_id AS path, CAST(conv_id AS VARCHAR) AS doc FROM conversations")
def doc_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "conversations").select(F.concat(F.lit("/docs/yjs/main/docs/"), F.col("conv_id")).alias("path")).distinct()
    return paths.select("path", F.regexp_extract("path", "/yjs/[^/]+/docs/(.+)$", 1).alias("doc"))


@query("SELECT base, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN sum(size) > 4096 THEN 'too_many_bytes' WHEN count(*) > 12 THEN 'too_many_entries' ELSE 'ok' END AS outcome FROM log_entries GROUP BY base", "log_entries")
def reconstruct_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of 4 KiB and 12 entries, small so that some documents exceed them."""
    sums = log_entries(spark, sf_dir).groupBy("base").agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"))
    return sums.withColumn("outcome", F.when(F.col("bytes") > 4096, "too_many_bytes").when(F.col("entries") > 12, "too_many_entries").otherwise("ok"))
