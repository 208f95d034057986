"""Scalar codecs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, text
from ledgerloom.operators import checks as C
from ledgerloom.sources.tables import files, kv_log, messages, read

from .registry import query


@query(
    """SELECT event_id, CAST(i AS INTEGER) AS i, CASE i WHEN 0 THEN props WHEN 1 THEN '2.50' WHEN 2 THEN '"a, \\"b] "' ELSE '[1 , [2]]' END AS item FROM events, unnest([0, 1, 2, 3]) t(i)"""
)
def json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays that are written with spaces, escapes and nesting, split one level deep with their own bytes."""
    array = F.concat(F.lit(" [ "), F.col("props"), F.lit(' ,\n2.50 , "a, \\"b] " , [1 , [2]] ] '))
    rows = read(spark, sf_dir, "events").select("event_id", text.json_items(array).alias("j"))
    return rows.select("event_id", F.posexplode("j.items").alias("i", "item"))


@query("SELECT sid, msg_offset // 200 AS page_no, '[' || string_agg(body, ',' ORDER BY seq) || ']' AS page FROM messages GROUP BY sid, msg_offset // 200", "messages")
def json_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page (messages that start in the same 200 bytes) as one JSON array."""
    page = messages(spark, sf_dir).groupBy("sid", F.expr("msg_offset div 200").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("m"))
    return page.select("sid", "page_no", F.concat(F.lit("["), F.array_join(F.transform("m", lambda x: x["body"]), ","), F.lit("]")).alias("page"))


_TYPES = "CASE event_id % 5 WHEN 0 THEN ' Application/JSON; charset=utf-8' WHEN 1 THEN 'text/plain' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'IMAGE/PNG ;x=1' END"


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/plain' WHEN 4 THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM events")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", codecs.media_type(F.expr(_TYPES)).alias("media_type"))


_DURATIONS = "CASE event_id % 6 WHEN 0 THEN event_id || 'ms' WHEN 1 THEN event_id || 's' WHEN 2 THEN event_id || 'm' WHEN 3 THEN event_id || 'h' WHEN 4 THEN event_id || 'd' ELSE '-1s' END"


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1000 WHEN 2 THEN event_id * 60000 WHEN 3 THEN event_id * 3600000 END AS ms FROM events")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", codecs.duration_ms(F.expr(_DURATIONS)).alias("ms"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("SELECT doc_id, translate(rtrim(to_base64(encode(text)), '='), '+/', '-_') AS coded, sha256(text) AS sha256 FROM documents")
def base64url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded without padding, and the hash of what decoding gives back."""
    coded = read(spark, sf_dir, "documents").select("doc_id", codecs.base64url(F.col("text").cast("binary")).alias("coded"))
    return coded.select("doc_id", "coded", F.sha2(codecs.unbase64url(F.col("coded")), 256).alias("sha256"))


@query("SELECT source AS partition, translate(rtrim(to_base64(encode(source)), '='), '+/', '-_') AS coded FROM documents GROUP BY source")
def files_partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as files-ns:<namespace>:record:<partition>, built and parsed."""
    names = read(spark, sf_dir, "documents").select(F.concat(F.lit("files-ns:"), codecs.base64url(F.col("source").cast("binary")), F.lit(":record:x")).alias("name")).distinct()
    coded = F.regexp_extract("name", "^files-ns:([A-Za-z0-9_-]*):(?:record:.*|intent:\\d+|object:\\d+)$", 1)
    return names.select(F.decode(codecs.unbase64url(coded), "UTF-8").alias("partition"), coded.alias("coded"))


@query("SELECT partition, key FROM kv_log GROUP BY partition, key", "kv_log")
def kv_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition and key, encoded as stored and parsed again."""
    raw = kv_log(spark, sf_dir).select(codecs.kv_key(F.col("partition"), F.col("key")).alias("raw")).distinct()
    return raw.select(codecs.parse_kv_key(F.col("raw")).alias("p")).select("p.partition", "p.key")


@query(
    """SELECT 'message' AS kind, CAST(sid AS VARCHAR) AS sid, CAST(msg_offset AS VARCHAR) AS at, CAST(NULL AS VARCHAR) AS path FROM messages
       UNION ALL SELECT DISTINCT 'meta', NULL, NULL, path FROM messages""",
    "messages",
)
def stream_key_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two families, built as stored and parsed: unsigned 64-bit numbers come back whole, as decimals in text."""
    rows = messages(spark, sf_dir)
    message = F.concat(F.lit("04"), codecs.u64_hex(F.col("sid")), codecs.u64_hex(F.col("msg_offset")), F.lit("0000"))
    meta = F.concat(F.lit("01"), F.lower(F.hex(F.col("path").cast("binary"))))
    raw = rows.select(message.alias("raw")).unionByName(rows.select(meta.alias("raw")).distinct())
    is_message = F.col("raw").startswith("04")
    number = lambda at: F.when(is_message, F.conv(F.substring("raw", at, 16), 16, 10))
    path = F.when(~is_message, F.decode(F.unhex(F.expr("substring(raw, 3)")), "UTF-8"))
    return raw.select(F.when(is_message, "message").otherwise("meta").alias("kind"), number(3).alias("sid"), number(19).alias("at"), path.alias("path"))


@query()
def shard_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH64 (seed 0) of each path, modulo 16 shards, the hash read as unsigned."""
    paths = messages(spark, sf_dir).select("path").distinct().withColumn("h", codecs.xxh64(F.col("path")))
    return paths.select("path", codecs.unsigned_mod(F.col("h"), 16).cast("int").alias("shard"))


@query()
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 shards on the nodes that the nations' names stand for."""
    nodes = [r.n_name for r in read(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]  # a list of nodes
    return spark.createDataFrame(sorted(C.placement(64, nodes).items()), "shard int, node string")


@query("SELECT CAST(i AS INTEGER) AS shard, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range(64) t(i)")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = max(3, len(str(64 - 1)))
    return spark.range(64).select(F.col("id").cast("int").alias("shard"), F.concat(F.lit("shard-"), F.lpad(F.col("id").cast("string"), width, "0")).alias("name"))


@query()
def bytes_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of bodies, cut to whole characters, and raw cuts rendered on one line."""
    raw = F.expr("substring(CAST(body AS BINARY), 4, 24)")
    rows = files(spark, sf_dir).select("id", text.trim_partial(raw).alias("whole"), text.render_bytes(raw).alias("rendered"))
    return rows.select("id", F.decode("whole", "UTF-8").alias("whole"), "rendered")


@query(
    """SELECT id, CASE WHEN strlen(id) > 10 THEN 'oversized_key' WHEN strlen(body) > 4096 THEN 'truncated_value' WHEN NOT starts_with(body, upper(substr(body, 1, 1))) THEN 'malformed_record' END AS diagnostic FROM files""",
    "files",
)
def row_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a row can't be decoded; null if it can. A body counts as malformed here if it starts with a small letter."""
    malformed = F.substring("body", 1, 1) != F.upper(F.substring("body", 1, 1))
    diagnostic = F.when(F.octet_length("id") > 10, "oversized_key").when(F.octet_length("body") > 4096, "truncated_value").when(malformed, "malformed_record")
    return files(spark, sf_dir).select("id", diagnostic.alias("diagnostic"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'bad_op' WHEN event_id % 4 = 2 THEN 'bad_version' ELSE 'ok' END AS outcome,
              CASE WHEN event_id % 4 < 2 THEN 'k' || event_id END AS key, CASE WHEN event_id % 4 = 1 THEN event_id END AS if_version FROM events"""
)
def kv_batch_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON operations decoded by an explicit schema and validated column by column."""
    op = F.when(F.col("event_id") % 4 == 3, "move").otherwise("put")
    version = F.when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 2, F.lit("-5")).otherwise("null")
    body = F.concat(F.lit('{"op":"'), op, F.lit('","key":"k'), F.col("event_id"), F.lit('","if_version":'), version, F.lit("}"))
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json(body, "op string, key string, if_version bigint").alias("o"))
    outcome = F.when(~F.col("o.op").isin("put", "delete", "check"), "bad_op").when(F.col("o.if_version") < 0, "bad_version").otherwise("ok")
    ok = outcome == "ok"
    return rows.select("event_id", outcome.alias("outcome"), F.when(ok, F.col("o.key")).alias("key"), F.when(ok, F.col("o.if_version")).alias("if_version"))


@query(
    """SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type
       UNION ALL SELECT 'event_ids_total{type="' || event_type || '"} ' || sum(event_id) FROM events GROUP BY event_type"""
)
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events_total"), F.sum("event_id").alias("event_ids_total"))
    label = F.replace(F.replace(F.col("event_type"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    lines = [F.concat(F.lit(f'{name}{{type="'), label, F.lit('"} '), F.col(name)) for name in ("events_total", "event_ids_total")]
    return sums.select(F.explode(F.array(*lines)).alias("line"))


@query("""SELECT DISTINCT '{"key":"' || key || '","value":"' || value || '"}' AS row FROM kv_log WHERE partition = 'RF'""", "kv_log")
def json_page_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kv_log(spark, sf_dir).where("partition = 'RF'").select("key", "value").distinct()
    return rows.select(text.json_row(F.col("key").cast("binary"), F.col("value").cast("binary")).alias("row"))


_LES = ", ".join(f"('{b}', {b})" for b in C.BUCKETS)


@query(
    f"""WITH b(le, bound) AS (VALUES {_LES}) SELECT event_type, le, count(*) FILTER (value / 1000 <= bound) AS n FROM events, b GROUP BY event_type, le
       UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type"""
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.histogram(read(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 1000), ["event_type"], "seconds")


@query(
    """SELECT event_type, p, v FROM (SELECT event_type, unnest([50.0::DOUBLE, 90.0, 99.0]) AS p, unnest(quantile_disc(value, [0.5, 0.9, 0.99])) AS v FROM events GROUP BY event_type)"""
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.percentiles(read(spark, sf_dir, "events"), ["event_type"], "value", [50.0, 90.0, 99.0])
