"""Invariants over recorded histories, and the aggregations of metrics."""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets in seconds, accounts of a bank and what each starts with.
BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 10.0]
ACCOUNTS, START = 4, 1000


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, le, n: cumulative counts for each bound, and +Inf; one pass, whatever the number of bounds."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)), F.count("*").alias("b_inf"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit("+Inf").alias("le"), F.col("b_inf").alias("n"))]
    return counts.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.le", "r.n")


def percentiles(df: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """keys, p, v: the value at rank ceil(p / 100 * n), for each point."""
    found = df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{i}") for i, p in enumerate(points)))
    return found.select(*keys, F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"p{i}").alias("v")) for i, p in enumerate(points)))).alias("r")).select(*keys, "r.p", "r.v")


def bank_balances(transfers: DataFrame) -> DataFrame:
    """bank, account, expected: the start plus what transfers (bank, source, destination, amount) moved."""
    moves = transfers.select("bank", F.explode(F.array(F.struct(F.col("source").alias("account"), (-F.col("amount")).alias("delta")), F.struct(F.col("destination").alias("account"), F.col("amount").alias("delta")))).alias("m")).select("bank", "m.*")
    start = transfers.select("bank").distinct().select("bank", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ACCOUNTS - 1).cast("long"))).alias("account"))
    sums = moves.groupBy("bank", "account").agg(F.sum("delta").alias("delta"))
    return start.join(sums, ["bank", "account"], "left").select("bank", "account", (START + F.coalesce("delta", F.lit(0))).cast("long").alias("expected"))


def placement(shards: int, nodes: list[str]) -> dict[int, str]:
    """Rendezvous placement with a cap of ceil(shards / nodes) for each node; a configuration-sized fold in shard order."""
    cap, load, out = -(-shards // len(nodes)) if nodes else 0, dict.fromkeys(nodes, 0), {}
    for n in range(shards if nodes else 0):
        ranked = sorted(nodes, key=lambda node: (xxhash.xxh64_intdigest(f"{n}/{node}"), node), reverse=True)
        out[n] = next(node for node in ranked if load[node] < cap)
        load[out[n]] += 1
    return out
