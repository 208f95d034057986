"""Files: storage classes, byte ranges, and the anti-joins that find what nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bodies up to this many bytes lie in the record.
INLINE_BYTES = 16_384


def storage_class(size: Column) -> Column:
    return F.when(size <= INLINE_BYTES, "inline").otherwise("object")


def clamp_range(first: Column, last: Column, suffix: Column, size: Column) -> Column:
    """struct(outcome, first, last) of an inclusive range: {first, last}, {first, to the end} (last null) or the last `suffix` bytes."""
    lo = F.when(suffix.isNotNull(), F.greatest(size - suffix, F.lit(0))).otherwise(first)
    hi = F.when(suffix.isNotNull() | last.isNull(), size - 1).otherwise(F.least(last, size - 1))
    invalid = (first < 0) | (last < first) | (suffix < 0)
    outcome = F.when(F.coalesce(invalid, F.lit(False)), "invalid_range").when((lo >= size) | F.coalesce(suffix == 0, F.lit(False)), "range_not_satisfiable").otherwise("ok")
    ok = outcome == "ok"
    return F.struct(outcome.alias("outcome"), F.when(ok, lo).alias("first"), F.when(ok, hi).alias("last"))


def unreferenced(keys: DataFrame, referenced: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(referenced.select(*on).distinct(), on, "left_anti")


def deleted_bodies(deleted: DataFrame, retention_ms: int) -> DataFrame:
    """deleted (size, deleted_ms) files whose body is an object, and when that may go (due_ms)."""
    return deleted.where(storage_class(F.col("size")) == "object").withColumn("due_ms", F.col("deleted_ms") + retention_ms)
