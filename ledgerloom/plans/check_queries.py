"""History checkers, replays of commands, and the live versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import checks as C
from ledgerloom.operators import replay as R
from ledgerloom.sources.tables import kv_log, messages, producer_commands, read, streams
from ledgerloom.streaming import live

from .registry import query

_TRANSFERS = "t AS (SELECT c_nationkey AS bank, o_custkey % 4 AS source, (o_custkey + 1 + o_orderkey % 3) % 4 AS destination, o_orderkey % 10 AS amount FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(
    f"""WITH {_TRANSFERS}, a AS (SELECT b.bank, i AS account FROM (SELECT DISTINCT bank FROM t) b, range(4) r(i)),
       m AS (SELECT bank, source AS account, -amount AS d FROM t UNION ALL SELECT bank, destination, amount FROM t),
       e AS (SELECT a.bank, a.account, CAST(1000 + coalesce(sum(d), 0) AS BIGINT) AS expected FROM a LEFT JOIN m ON m.bank = a.bank AND m.account = a.account GROUP BY a.bank, a.account)
       SELECT CAST(bank AS BIGINT) AS bank, CAST(account AS BIGINT) AS account, expected, expected + CASE WHEN bank % 5 = 0 AND account = 2 THEN 1 ELSE 0 END AS actual, NOT (bank % 5 = 0 AND account = 2) AND expected >= 0 AS ok FROM e"""
)
def bank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances that receipts explain; every fifth bank has an account that is off by one."""
    owners = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("bank"))
    transfers = read(spark, sf_dir, "orders").join(owners, "o_custkey").select(
        "bank", (F.col("o_custkey") % 4).alias("source"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 3) % 4).alias("destination"), (F.col("o_orderkey") % 10).alias("amount")
    )
    rows = C.bank_balances(transfers)
    actual = F.col("expected") + F.when((F.col("bank") % 5 == 0) & (F.col("account") == 2), 1).otherwise(0)
    return rows.withColumn("actual", actual).withColumn("ok", (F.col("actual") == F.col("expected")) & (F.col("actual") >= 0))


@query("SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS requests FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def retry_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same id must always carry the same request."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.countDistinct("o_orderpriority").alias("requests")).where("requests > 1")


@query(
    """WITH k AS (SELECT DISTINCT user_id FROM events), p AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT k.user_id, p.event_type, coalesce(n, 0) AS reads FROM k, p LEFT JOIN c ON c.user_id = k.user_id AND c.event_type = p.event_type WHERE coalesce(n, 0) <> 1"""
)
def final_read_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that some process did not read exactly once."""
    events = read(spark, sf_dir, "events")
    wanted = events.select("user_id").distinct().crossJoin(events.select("event_type").distinct())
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return wanted.join(counts, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).cast("long").alias("reads")).where("reads <> 1")


@query(
    """WITH r AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS final, list(o_orderkey ORDER BY CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END, o_orderkey) AS seen FROM orders GROUP BY o_custkey)
       SELECT o_custkey, len(seen) AS n FROM r WHERE seen <> final"""
)
def array_order_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose order differs from the final one (every third customer's list was read in another order)."""
    place = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderkey") % 7).otherwise(0)
    of = Window.partitionBy("o_custkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(of.orderBy("o_orderkey")).alias("final"), F.row_number().over(of.orderBy(place, "o_orderkey")).alias("seen"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("seen") != F.col("final")).alias("moved")).where("moved > 0").select("o_custkey", "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lost_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledged additions that the final read lacks."""
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """WITH r AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3] AS b FROM orders GROUP BY o_custkey)
       SELECT o_custkey FROM r WHERE a[1:len(b)] <> b"""
)
def list_prefix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two reads of an append-only list the shorter must be a prefix of the longer."""
    of = Window.partitionBy("o_custkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(of.orderBy("o_orderkey")).alias("a"), F.row_number().over(of.orderBy("o_orderdate", "o_orderkey")).alias("b"))
    return rows.where("b <= 3 AND a <> b").select("o_custkey").distinct()


@query("SELECT sid, tail - tail * (sid % 4) // 4 AS lag, CASE WHEN sid % 9 = 8 THEN 'missing' WHEN sid % 4 > 0 THEN 'lagging' ELSE 'ok' END AS state FROM streams", "streams")
def follower_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers that stand at part of their stream; every ninth is missing."""
    rows = streams(spark, sf_dir)
    followers = rows.where("sid % 9 <> 8").select("sid", F.expr("tail - tail * (sid % 4) div 4").alias("behind"))
    joined = rows.join(followers, "sid", "left")
    lag = F.expr("tail - tail * (sid % 4) div 4")
    return joined.select("sid", lag.alias("lag"), F.when(F.col("behind").isNull(), "missing").when(F.col("sid") % 4 > 0, "lagging").otherwise("ok").alias("state"))


@query("SELECT event_type AS name, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query(
    """WITH s AS (SELECT sid, seq, msg_offset FROM messages WHERE seq % 50 <> 0 UNION ALL SELECT sid, seq, msg_offset FROM messages WHERE seq % 75 = 0),
       c AS (SELECT m.sid, m.seq, count(s.seq) AS n FROM messages m LEFT JOIN s ON s.sid = m.sid AND s.seq = m.seq AND s.msg_offset = m.msg_offset WHERE m.seq % 3 = 0 GROUP BY m.sid, m.seq)
       SELECT sid, seq, n, CASE WHEN n = 0 THEN 'lost' ELSE 'repeated' END AS problem FROM c WHERE n <> 1""",
    "messages",
)
def acked_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledged appends (every third) must be stored once, at their offset; some are missing or repeated on purpose."""
    rows = messages(spark, sf_dir).select("sid", "seq", "msg_offset")
    stored = rows.where("seq % 50 <> 0").unionByName(rows.where("seq % 75 = 0")).groupBy("sid", "seq", "msg_offset").agg(F.count("*").alias("n"))
    acked = rows.where("seq % 3 = 0").join(stored, ["sid", "seq", "msg_offset"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return acked.where("n <> 1").select("sid", "seq", "n", F.when(F.col("n") == 0, "lost").otherwise("repeated").alias("problem"))


@query(
    """WITH l AS (SELECT c_nationkey % 5 AS node, count(*) AS shards, count(*) FILTER (c_acctbal < 0) AS expired FROM customer GROUP BY c_nationkey % 5)
       SELECT CAST(node AS BIGINT) AS node, shards, expired, shards - expired AS live, CAST(ceil((SELECT sum(shards) FROM l) / (SELECT count(*) FROM l)) AS BIGINT) AS fair,
              shards > CAST(ceil((SELECT sum(shards) FROM l) / (SELECT count(*) FROM l)) AS BIGINT) AS over FROM l"""
)
def lease_fair_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leases: nodes that hold more than ceil(shards / nodes), and how many leases ran out."""
    held = read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).cast("long").alias("node")).agg(F.count("*").alias("shards"), F.count_if(F.col("c_acctbal") < 0).alias("expired"))
    share = held.agg(F.ceil(F.sum("shards") / F.count("*")).alias("fair"))
    return held.join(F.broadcast(share)).select("node", "shards", "expired", (F.col("shards") - F.col("expired")).alias("live"), "fair", (F.col("shards") > F.col("fair")).alias("over"))


# --- replays: SQL steps through each key's commands by recursion, carrying the state in columns

_PRODUCERS_SQL = """WITH RECURSIVE e AS (SELECT user_id AS producer, event_id AS pos, (day(ts) - 1) // 10 AS epoch FROM events),
       n AS (SELECT *, row_number() OVER (PARTITION BY producer, epoch ORDER BY pos) - 1 AS seq FROM e),
       c AS (SELECT producer, pos * 2 AS moment, epoch, seq FROM n WHERE pos % 37 <> 0 UNION ALL SELECT producer, pos * 2 + 1, epoch, seq FROM n WHERE pos % 10 = 0),
       o AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY moment) AS i FROM c),
       f AS (SELECT DISTINCT producer, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS moment, '' AS outcome, CAST(NULL AS BIGINT) AS carried, CAST(NULL AS BIGINT) AS has_epoch, CAST(NULL AS BIGINT) AS has_seq FROM o
             UNION ALL
             SELECT producer, i, moment, outcome,
                    CASE outcome WHEN 'appended' THEN seq WHEN 'duplicate' THEN has_seq WHEN 'gap' THEN coalesce(has_seq + 1, 0) WHEN 'stale_epoch' THEN has_epoch END,
                    CASE outcome WHEN 'appended' THEN epoch ELSE has_epoch END, CASE outcome WHEN 'appended' THEN seq ELSE has_seq END
             FROM (SELECT o.*, has_epoch, has_seq,
                          CASE WHEN has_epoch IS NULL THEN CASE seq WHEN 0 THEN 'appended' ELSE 'gap' END WHEN epoch < has_epoch THEN 'stale_epoch'
                               WHEN epoch > has_epoch THEN CASE seq WHEN 0 THEN 'appended' ELSE 'bad_request' END
                               WHEN seq <= has_seq THEN 'duplicate' WHEN seq > has_seq + 1 THEN 'gap' ELSE 'appended' END AS outcome
                   FROM f JOIN o ON o.producer = f.producer AND o.i = f.i + 1))
       SELECT producer, moment AS "at", outcome, carried FROM f WHERE i > 0"""


@query(_PRODUCERS_SQL)
def producer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold(producer_commands(spark, sf_dir), ["producer"], ["at"], ["epoch", "seq"], R.producer_step, "outcome string, carried long")


@query(
    """WITH e AS (SELECT user_id AS producer, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
       c AS (SELECT producer, pos * 2 AS moment, seq FROM e UNION ALL SELECT producer, pos * 2 + 1, seq FROM e WHERE pos % 10 = 0)
       SELECT producer, moment, seq, CASE WHEN row_number() OVER (PARTITION BY producer, seq ORDER BY moment) = 1 THEN 'appended' ELSE 'duplicate' END AS outcome FROM c"""
)
def producer_dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One epoch and no gaps: the replay then equals the first row of each number."""
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("producer"), (F.col("event_id") * 2).alias("moment"), seq.alias("seq"), F.lit(0).cast("long").alias("epoch"))
    again = rows.where("moment div 2 % 10 = 0").withColumn("moment", F.col("moment") + 1)
    found = R.fold(rows.unionByName(again), ["producer"], ["moment"], ["epoch", "seq"], R.producer_step, "outcome string, seq long")
    return found.select("producer", "moment", "seq", "outcome")


@query(_PRODUCERS_SQL)
def producer_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.run_to_end(producer_commands(spark, sf_dir), live.producer_dedup, "producer-dedup")


@query(
    """WITH t AS (SELECT user_id AS sid, event_id AS "at", epoch_us(ts) // 1000 AS ms, user_id % 5 * 86400000 AS ttl, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)
       SELECT sid, "at", coalesce(ttl > 0 AND ms >= last + ttl, false) AS expired FROM t"""
)
def stream_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    touches = read(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("at"), ms.alias("ms"), (F.col("user_id") % 5 * 86_400_000).alias("ttl_ms"))
    return live.run_to_end(touches, live.sliding_expiry, "sliding-expiry")


@query(
    """WITH RECURSIVE c AS (SELECT partition, key, seq, op, amount % 3 AS kind, seq - amount * 50 AS expected, row_number() OVER (PARTITION BY partition, key ORDER BY seq) AS i FROM kv_log),
       f AS (SELECT DISTINCT partition, key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, '' AS outcome, CAST(NULL AS BIGINT) AS has FROM c
             UNION ALL
             SELECT c.partition, c.key, c.i, c.seq,
                    CASE WHEN (kind = 0 AND has IS NOT NULL) OR (kind = 1 AND has IS DISTINCT FROM expected) THEN 'conflict' ELSE 'ok' END,
                    CASE WHEN (kind = 0 AND has IS NOT NULL) OR (kind = 1 AND has IS DISTINCT FROM expected) THEN has WHEN op = 'put' THEN c.seq END
             FROM f JOIN c ON c.partition = f.partition AND c.key = f.key AND c.i = f.i + 1)
       SELECT partition, key, seq, outcome, has AS current FROM f WHERE i > 0""",
    "kv_log",
)
def kv_cas_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    condition = F.when(F.col("amount") % 3 == 0, "absent").when(F.col("amount") % 3 == 1, "version").otherwise("none")
    commands = kv_log(spark, sf_dir).select("partition", "key", "seq", "op", condition.alias("condition"), (F.col("seq") - F.col("amount") * 50).alias("expected"), F.col("seq").alias("version"))
    return R.fold(commands, ["partition", "key"], ["seq"], ["op", "condition", "expected", "version"], R.cas_step, "outcome string, current long")


@query(
    """WITH RECURSIVE r AS (SELECT supplier AS partition, batch // 64 AS batch, seq, CASE WHEN amount % 9 = 0 THEN 'check' ELSE op END AS op, amount % 16 AS slot, amount % 5 = 0 AS absent FROM kv_log),
       l AS (SELECT partition, batch, slot, max(seq) AS seq FROM r WHERE op <> 'check' GROUP BY 1, 2, 3),
       w AS (SELECT r.partition, r.batch, list(r.slot) FILTER (r.op = 'put') AS puts, list(r.slot) AS written FROM l JOIN r ON r.partition = l.partition AND r.seq = l.seq GROUP BY 1, 2),
       b AS (SELECT partition, batch, coalesce(list(slot ORDER BY seq) FILTER (absent), []) AS wanted FROM r GROUP BY 1, 2),
       c AS (SELECT b.*, coalesce(puts, []) AS puts, coalesce(written, []) AS written, row_number() OVER (PARTITION BY b.partition ORDER BY b.batch) AS i FROM b LEFT JOIN w ON w.partition = b.partition AND w.batch = b.batch),
       f AS (SELECT DISTINCT partition, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS batch, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS version, CAST([NULL FOR k IN range(16)] AS BIGINT[]) AS has FROM c
             UNION ALL
             SELECT partition, i, batch, bad, CASE WHEN bad IS NULL THEN batch ELSE has[bad + 1] END,
                    CASE WHEN bad IS NOT NULL THEN has ELSE [CASE WHEN list_contains(puts, k) THEN batch WHEN NOT list_contains(written, k) THEN has[k + 1] END FOR k IN range(16)] END
             FROM (SELECT c.*, has, [k FOR k IN wanted IF has[k + 1] IS NOT NULL][1] AS bad FROM f JOIN c ON c.partition = f.partition AND c.i = f.i + 1))
       SELECT partition, batch, CASE WHEN slot IS NULL THEN 'ok' ELSE 'conflict' END AS outcome, CAST(slot AS VARCHAR) AS key, version FROM f WHERE i > 0""",
    "kv_log",
)
def kv_batch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each supplier's rows that share a shipping batch; conditions on what earlier batches left."""
    kind = F.when(F.col("amount") % 9 == 0, "check").otherwise(F.col("op"))
    op = F.struct(kind.alias("op"), F.expr("cast(amount % 16 as string)").alias("key"), F.lit(None).cast("long").alias("if_version"), (F.col("amount") % 5 == 0).alias("if_absent"), F.col("seq").alias("place"))
    batches = kv_log(spark, sf_dir).groupBy(F.col("supplier").alias("partition"), F.expr("batch div 64").alias("batch")).agg(F.array_sort(F.collect_list(op), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("ops"))
    return R.fold(batches.withColumn("seq", F.col("batch")), ["partition"], ["batch"], ["ops", "seq"], R.batch_step, "outcome string, key string, version long")


def _stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    op = F.when(first | (F.col("event_id") % 40 == 7), "create").when(F.col("event_id") % 60 == 11, "close").otherwise("append")
    content = F.when(F.col("event_id") % 23 == 0, "text/plain").otherwise("application/json")
    # producers number their own appends; some numbers are repeated or skipped
    own = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 2 - F.when(F.col("event_id") % 29 == 0, 1).otherwise(0)).cast("long")
    return events.withColumn("own", own).select(
        F.col("user_id").alias("sid"), F.col("event_id").alias("at"), op.alias("op"), content.alias("content_type"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("p"), F.col("event_id") % 2)).alias("producer"),
        F.when(F.col("user_id") % 2 == 0, F.lit(0)).cast("long").alias("epoch"), F.when(F.col("user_id") % 2 == 0, F.expr("cast(own div 2 as long)")).alias("producer_seq"),
        F.when(F.col("user_id") % 3 == 0, F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("stream_seq"),
        F.when(F.col("event_id") % 31 == 5, 0).otherwise(F.octet_length("props")).cast("long").alias("bytes"), (F.col("event_id") % 90 == 13).alias("close"),
    )


FIELDS = ["op", "content_type", "producer", "epoch", "producer_seq", "stream_seq", "bytes", "close"]


@query(
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
       c AS (SELECT user_id AS sid, event_id AS "at", i, i = 1 OR event_id % 40 = 7 AS creates, (i > 1 AND event_id % 40 <> 7 AND event_id % 60 = 11) OR event_id % 90 = 13 AS closes,
                    CASE WHEN event_id % 60 = 11 OR event_id % 31 = 5 THEN 0 ELSE strlen(props) END AS size, CASE WHEN event_id % 23 = 0 THEN 'text/plain' ELSE 'application/json' END AS content,
                    CASE WHEN user_id % 2 = 0 THEN event_id % 2 END AS sender, (i - 2 - CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END) // 2 AS num,
                    CASE WHEN user_id % 3 = 0 THEN lpad(CAST(event_id AS VARCHAR), 8, '0') END AS stream_seq FROM e),
       f AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS "at", '' AS outcome, CAST(NULL AS BIGINT) AS tail, CAST(NULL AS BIGINT) AS echo, CAST(NULL AS VARCHAR) AS has_content, false AS closed,
                    CAST(NULL AS BIGINT) AS by_sender, CAST(NULL AS BIGINT) AS by_num, CAST(NULL AS BIGINT) AS last0, CAST(NULL AS BIGINT) AS last1, CAST(NULL AS VARCHAR) AS has_seq FROM c
             UNION ALL
             SELECT sid, i, "at", outcome, CASE outcome WHEN 'created' THEN 0 WHEN 'appended' THEN tail + 4 + size ELSE tail END,
                    CASE WHEN outcome = 'duplicate' AND closed THEN num WHEN outcome = 'duplicate' THEN last WHEN outcome = 'gap' THEN coalesce(last + 1, 0) WHEN sender IS NOT NULL AND outcome IN ('appended', 'closed_now') THEN num END,
                    CASE outcome WHEN 'created' THEN content ELSE has_content END, closed OR (done AND closes),
                    CASE WHEN done AND closes THEN sender ELSE by_sender END, CASE WHEN done AND closes THEN num ELSE by_num END,
                    CASE WHEN done AND sender = 0 THEN num ELSE last0 END, CASE WHEN done AND sender = 1 THEN num ELSE last1 END, CASE WHEN outcome = 'appended' THEN coalesce(stream_seq, has_seq) ELSE has_seq END
             FROM (SELECT *, outcome IN ('appended', 'closed_now') AS done FROM (
               SELECT *, CASE WHEN creates AND has_content IS NULL THEN 'created' WHEN creates AND has_content = content AND NOT closed THEN 'exists' WHEN creates THEN 'conflict' WHEN has_content IS NULL THEN 'not_found'
                              WHEN size = 0 AND NOT closes THEN 'bad_request' WHEN closed AND sender = by_sender AND num = by_num THEN 'duplicate' WHEN closed AND size = 0 AND sender IS NULL THEN 'already_closed' WHEN closed THEN 'closed'
                              WHEN size > 0 AND content <> has_content THEN 'content_type_mismatch' WHEN sender IS NOT NULL AND num <= last THEN 'duplicate' WHEN sender IS NOT NULL AND num <> coalesce(last + 1, 0) THEN 'gap'
                              WHEN size > 0 AND stream_seq <= has_seq THEN 'stream_seq_conflict' WHEN size > 0 THEN 'appended' ELSE 'closed_now' END AS outcome
               FROM (SELECT c.*, tail, has_content, closed, by_sender, by_num, last0, last1, has_seq, CASE sender WHEN 0 THEN last0 WHEN 1 THEN last1 END AS last FROM f JOIN c ON c.sid = f.sid AND c.i = f.i + 1))))
       SELECT sid, "at", outcome, tail, echo FROM f WHERE i > 0"""
)
def stream_append_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold(_stream_commands(spark, sf_dir), ["sid"], ["at"], FIELDS, R.append_step, "outcome string, tail long, echo long")


_LIFECYCLE_SQL = """c AS (SELECT user_id AS sid, event_id AS "at", epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 5 = 0 THEN 'text/plain' ELSE 'application/json' END AS content,
                    CASE WHEN user_id % 3 > 0 THEN user_id % 3 * 400000 END AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
                    CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 41 = 3 THEN 'delete' WHEN event_id % 13 = 4 THEN 'fork' WHEN event_id % 13 = 9 THEN 'unfork' ELSE 'read' END AS op FROM events)"""


def lifecycle_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sid, at, op, ms, content_type, ttl_s: events as commands on 50 paths or more."""
    event = F.col("event_id")
    op = F.when(event % 7 == 0, "create").when(event % 41 == 3, "delete").when(event % 13 == 4, "fork").when(event % 13 == 9, "unfork").otherwise("read")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"), event.alias("at"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.when(event % 5 == 0, "text/plain").otherwise("application/json").alias("content_type"), F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3 * 400_000).cast("long").alias("ttl_s"),
    )


@query(
    f"""WITH RECURSIVE {_LIFECYCLE_SQL},
       f AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS "at", '' AS outcome, CAST(0 AS BIGINT) AS shown, 'none' AS kind, CAST(0 AS BIGINT) AS forks, CAST(NULL AS VARCHAR) AS has_content, CAST(NULL AS BIGINT) AS has_ttl, CAST(NULL AS BIGINT) AS seen FROM c
             UNION ALL
             SELECT sid, i, "at", outcome, CASE outcome WHEN 'unforked' THEN forks - 1 WHEN 'forked' THEN forks + 1 WHEN 'not_found' THEN 0 WHEN 'reclaimed' THEN 0 ELSE forks END,
                    CASE outcome WHEN 'created' THEN 'live' WHEN 'soft_deleted' THEN 'gone' WHEN 'deleted' THEN 'none' WHEN 'reclaimed' THEN 'none' ELSE kind END,
                    CASE outcome WHEN 'created' THEN 0 WHEN 'unforked' THEN forks - 1 WHEN 'reclaimed' THEN 0 WHEN 'forked' THEN forks + 1 ELSE forks END,
                    CASE outcome WHEN 'created' THEN content ELSE has_content END, CASE outcome WHEN 'created' THEN ttl ELSE has_ttl END, CASE WHEN outcome IN ('created', 'read', 'forked') THEN ms ELSE seen END
             FROM (SELECT *, CASE WHEN op = 'unfork' THEN CASE WHEN kind = 'none' OR forks = 0 THEN 'not_found' WHEN kind = 'gone' AND forks = 1 THEN 'reclaimed' ELSE 'unforked' END
                                  WHEN op = 'create' THEN CASE WHEN kind = 'none' THEN 'created' WHEN kind = 'live' AND content = has_content AND ttl IS NOT DISTINCT FROM has_ttl THEN 'exists' ELSE 'conflict' END
                                  WHEN kind = 'none' THEN 'not_found' WHEN kind = 'gone' THEN 'gone' WHEN op = 'delete' THEN CASE WHEN forks > 0 THEN 'soft_deleted' ELSE 'deleted' END WHEN op = 'fork' THEN 'forked' ELSE 'read' END AS outcome
                   FROM (SELECT c.*, forks, has_content, has_ttl, seen, CASE WHEN kind = 'live' AND ms >= seen + has_ttl * 1000 THEN CASE WHEN forks > 0 THEN 'gone' ELSE 'none' END ELSE kind END AS kind
                         FROM f JOIN c ON c.sid = f.sid AND c.i = f.i + 1)))
       SELECT sid, "at", outcome, shown AS forks FROM f WHERE i > 0"""
)
def stream_lifecycle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold(lifecycle_commands(spark, sf_dir), ["sid"], ["at"], ["op", "ms", "content_type", "ttl_s"], R.lifecycle_step, "outcome string, forks long")


@query(
    f"""WITH RECURSIVE {_LIFECYCLE_SQL},
       f AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS "at", false AS moved, CAST(NULL AS BIGINT) AS due FROM c WHERE ttl IS NOT NULL
             UNION ALL
             SELECT c.sid, c.i, c."at", due IS NULL OR ms + ttl * 1000 - due >= ttl * 100, CASE WHEN due IS NULL OR ms + ttl * 1000 - due >= ttl * 100 THEN ms + ttl * 1000 ELSE due END
             FROM f JOIN c ON c.sid = f.sid AND c.i = f.i + 1)
       SELECT sid, "at", moved, due FROM f WHERE i > 0"""
)
def expiry_index_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = lifecycle_commands(spark, sf_dir).where("ttl_s IS NOT NULL")
    return R.fold(touches, ["sid"], ["at"], ["ms", "ttl_s"], R.expiry_index_step, "moved boolean, due long")


@query(
    """WITH c AS (SELECT event_id % 97 AS client, event_id AS "at", 'c' || event_id % 11 AS connection, 'p' || user_id % 3 AS principal FROM events),
       f AS (SELECT *, first_value(principal) OVER (PARTITION BY client ORDER BY "at") AS own FROM c),
       g AS (SELECT *, last_value(CASE WHEN principal = own THEN connection END IGNORE NULLS) OVER (PARTITION BY client ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM f)
       SELECT client, "at", CASE WHEN principal <> own THEN 'refused' WHEN held IS NULL THEN 'granted' WHEN held = connection THEN 'renewed' ELSE 'taken_over' END AS outcome,
              CASE WHEN principal <> own THEN held ELSE connection END AS owner FROM g"""
)
def owner_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = read(spark, sf_dir, "events").select((F.col("event_id") % 97).alias("client"), F.col("event_id").alias("at"), F.concat(F.lit("c"), F.col("event_id") % 11).alias("connection"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("principal"))
    return R.fold(claims, ["client"], ["at"], ["connection", "principal"], R.claim_step, "outcome string, owner string")


@query(
    """WITH RECURSIVE c AS (SELECT user_id AS sid, event_id AS "at", epoch_us(ts) // 1000 // 360000 AS ms, strlen(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
       f AS (SELECT DISTINCT sid, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS "at", CAST(-1 AS BIGINT) AS number, CAST(NULL AS BIGINT) AS first_ms, CAST(NULL AS BIGINT) AS held FROM c
             UNION ALL
             SELECT sid, i, "at", CASE WHEN opens THEN number + 1 ELSE number END, CASE WHEN opens THEN ms ELSE first_ms END, CASE WHEN opens THEN size ELSE held + size END
             FROM (SELECT c.*, number, first_ms, held, first_ms IS NULL OR ms - first_ms >= 10 OR held >= 262144 AS opens FROM f JOIN c ON c.sid = f.sid AND c.i = f.i + 1))
       SELECT sid, "at", number AS batch FROM f WHERE i > 0"""
)
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a stream batched by time (here an hour) or bytes."""
    updates = read(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("at"), F.expr("unix_millis(cast(ts as timestamp)) div 360000").alias("ms"), F.octet_length("props").cast("long").alias("bytes"))
    return R.fold(updates, ["sid"], ["at"], ["ms", "bytes"], R.batching_step, "batch long")
