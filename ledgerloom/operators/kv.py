"""Ordered key-value logs: states, scans, pages, merges and compaction as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import latest, running_total

KEY = ["partition", "key"]
TWO_64 = "18446744073709551616"
TWO_63 = "9223372036854775808"


def state(log: DataFrame) -> DataFrame:
    """The live rows: each key's last write, unless it deletes."""
    return latest(log, KEY, ["seq"]).where("op <> 'delete'")


def state_as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live rows as a snapshot of sequence number seq sees them."""
    return state(log.where(F.col("seq") <= seq))


def scan(rows: DataFrame, partition: str, gte: str | None = None, gt: str | None = None, lt: str | None = None, lte: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows of a partition within bounds. All conditions are comparisons, which reach Parquet statistics."""
    from .sequences import prefix_filter

    rows = rows.where(F.col("partition") == partition)
    for bound, test in ((gte, "__ge__"), (gt, "__gt__"), (lt, "__lt__"), (lte, "__le__")):
        if bound is not None:
            rows = rows.where(getattr(F.col("key"), test)(F.lit(bound)))
    return rows if prefix is None else rows.where(prefix_filter("key", prefix))


def page(rows: DataFrame, limit: int) -> DataFrame:
    """The first limit rows by key, with cursor: the last key if a further row exists, else null. One row more is read, no more."""
    numbered = rows.orderBy("key").limit(limit + 1).withColumn("_place", F.row_number().over(Window.orderBy("key")))
    last = F.max(F.when(F.col("_place") == limit, F.col("key"))).over(Window.partitionBy())
    more = F.max("_place").over(Window.partitionBy()) > limit
    return numbered.withColumn("cursor", F.when(more, last)).where(F.col("_place") <= limit).drop("_place")


def bounded_page(rows: DataFrame, limit: int, target_bytes: int) -> DataFrame:
    """Rows by key until limit rows or target_bytes bytes; the row that crosses the target is included."""
    first = rows.orderBy("key").limit(limit).withColumn("size", (F.octet_length("key") + F.octet_length("value")).cast("long"))
    order = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") < target_bytes).drop("before")


def merge_tail(log: DataFrame) -> DataFrame:
    """What counts for each key (key, seq, op, amount): operands after the last put or delete, and that put."""
    base = log.groupBy("key").agg(F.max(F.when(F.col("op") != "merge", F.col("seq"))).alias("base"))
    return log.join(base, "key").where((F.col("seq") >= F.coalesce("base", F.lit(0))) & (F.col("op") != "delete")).drop("base")


def merge_fold(tail: DataFrame, operator: str) -> DataFrame:
    """key and merged for one of the associative operators u64_add, i64_add, u64_max, u64_min, append.

    Sums wrap as 64-bit integers do; they are taken as decimals, so no partial sum overflows. All but append combine before the shuffle.
    """
    total = F.sum(F.col("amount").cast("decimal(38,0)"))
    wrapped = (total % F.lit(TWO_64).cast("decimal(38,0)") + F.lit(TWO_64).cast("decimal(38,0)")) % F.lit(TWO_64).cast("decimal(38,0)")
    folds = {
        "u64_add": wrapped.cast("string"),
        "i64_add": F.when(wrapped >= F.lit(TWO_63).cast("decimal(38,0)"), wrapped - F.lit(TWO_64).cast("decimal(38,0)")).otherwise(wrapped).cast("long"),
        "u64_max": F.max("amount"),
        "u64_min": F.min("amount"),
        "append": F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("amount").cast("string").alias("a")))), lambda x: x["a"]), ""),
    }
    return tail.groupBy("key").agg(folds[operator].alias("merged"))


def reduced_prefixes(prefixes: list[str]) -> list[str]:
    """prefixes without those that another covers, sorted."""
    kept: list[str] = []
    for p in sorted(set(prefixes)):
        if not kept or not p.startswith(kept[-1]):
            kept.append(p)
    return kept


def compact(rows: DataFrame, prefixes: list[str]) -> DataFrame:
    """Rows whose key starts with none of the prefixes (a list that a user gives), by range conditions."""
    from functools import reduce

    from .sequences import prefix_filter

    conditions = [prefix_filter("key", p) for p in reduced_prefixes(prefixes)]
    return rows.where(~reduce(lambda a, b: a | b, conditions, F.lit(False)))


def in_flight(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, load: the sum of bytes of (begin, end, bytes) intervals open after each change. Ends come before begins of the same time."""
    changes = intervals.select(*keys, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.col("bytes").alias("delta")), F.struct(F.col("end").alias("at"), (-F.col("bytes")).alias("delta")))).alias("c")).select(*keys, "c.*")
    sums = changes.groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))
    return running_total(sums, keys, "at", "delta", "before", chunk=1 << 32).select(*keys, "at", (F.col("before") + F.col("delta")).alias("load"))


def write_conflicts_ww(transactions: DataFrame, touched: DataFrame) -> DataFrame:
    """Transactions that lose under snapshot isolation: a key that they write was written by a commit inside their time."""
    return _conflicts(transactions, touched.where("wrote"), touched)


def write_conflicts_rw(transactions: DataFrame, touched: DataFrame) -> DataFrame:
    """Transactions that lose when serializable: a key that they read or write was written by a commit inside their time."""
    return _conflicts(transactions, touched, touched)


def _conflicts(transactions: DataFrame, mine: DataFrame, others: DataFrame, width: int = 64) -> DataFrame:
    """transactions (tx, begin, commit), touched keys (tx, key, wrote).

    A commit can only fall into transactions of near time: both sides are dealt by key and a range of times, so that a popular key is
    not compared with itself over all time.
    """
    mine = mine.join(transactions, "tx").withColumn("_slot", F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"commit div {width}"))))
    theirs = others.where("wrote").join(transactions, "tx").select(F.col("tx").alias("_other"), "key", F.col("commit").alias("_at"), F.expr(f"commit div {width}").alias("_slot"))
    return mine.join(theirs, ["key", "_slot"]).where("_other <> tx AND begin < _at AND _at < commit").select("tx").distinct()


def deadline_outcome(applied: Column, deadline: Column) -> Column:
    """A write is applied only before its deadline, by the clock of the writer; a null deadline never ends."""
    return F.when(F.coalesce(applied < deadline, F.lit(True)), "ok").otherwise("deadline_exceeded")


def overlaid(rows: DataFrame, overlay: DataFrame) -> DataFrame:
    """State rows (partition, key, value, seq) as a transaction sees them: its uncommitted writes (op, place) hide them and have no seq."""
    mine = latest(overlay, KEY, ["place"])
    kept = rows.join(mine.select(*KEY), KEY, "left_anti")
    return kept.unionByName(mine.where("op <> 'delete'").select(*KEY, "value", F.lit(None).cast("long").alias("seq")))
