"""Ordered computations over keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that one task's part of a key spans.
CHUNK = 1 << 20


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """df with out: the sum of value over earlier rows (by the integer column order) of the same keys, 0 for the first."""
    return running_totals(df, keys, order, {out: value}, chunk)


def running_totals(df: DataFrame, keys: list[str], order: str, values: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """df with a running total for each name: column of values, all in one pass.

    A key is cut into ranges of the order column. Ranges are summed first (aggregated before the shuffle), their prefix sums are a few
    rows a key, and rows are only sorted inside their range: a key with a third of all rows spreads over many tasks.
    """
    rows = df.withColumn("_part", F.expr(f"`{order}` div {chunk}"))
    sums = rows.groupBy(*keys, "_part").agg(*(F.sum(v).alias(f"_sum_{o}") for o, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", *(F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_start_{o}") for o in values))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = {o: (F.col(f"_start_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).cast("long") for o, v in values.items()}
    return rows.join(starts, [*keys, "_part"]).withColumns(totals).drop("_part", *(f"_start_{o}" for o in values))


def global_places(df: DataFrame, first: str, order: str, ties: list[str], out: str, chunk: int = CHUNK) -> DataFrame:
    """df with out: the place (from 1) of each row in the order of first, the integer column order, and ties, over the whole table.

    Rows are ranked inside ranges of order within a value of first; the counts of earlier ranges and of earlier values of first come
    from aggregates. first should have few values (a date); their number doesn't bound how many tasks share the work.
    """
    rows = df.withColumn("_part", F.expr(f"`{order}` div {chunk}"))
    counts = rows.groupBy(first, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(first).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # a row for each value of first
    values = counts.groupBy(first).agg(F.sum("_n").alias("_m")).select(first, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    starts = counts.select(first, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")).join(values, first)
    inside = Window.partitionBy(first, "_part").orderBy(order, *ties)
    ranked = rows.withColumn("_rank", F.row_number().over(inside)).join(starts, [first, "_part"])
    return ranked.withColumn(out, F.col("_before") + F.col("_start") + F.col("_rank")).drop("_part", "_before", "_start", "_rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so that hot keys send a row for each task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def page_by_bytes(df: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, up to and with the one that reaches budget; at least one."""
    return running_total(df, keys, order, size, "_used").where(F.col("_used") < budget).drop("_used")


def successor(prefix: str) -> str | None:
    """The least string after all strings that start with prefix; None if there is none. For ASCII and byte-ordered keys."""
    raw = prefix.rstrip("\U0010ffff")
    return raw[:-1] + chr(ord(raw[-1]) + 1) if raw else None


def prefix_filter(column: str, prefix: str):
    """column starts with prefix, as a range that Parquet statistics can prune."""
    end = successor(prefix)
    return (F.col(column) >= prefix) & (F.lit(True) if end is None else F.col(column) < end)
