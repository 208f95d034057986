"""Exact de-duplication by content sort, with DataFrame functions only.

Texts are equal when their bytes are after each run of white space became one space. A range exchange, whose splitters
Spark samples, deals rows by (first characters, digest); the external sort of the window puts equal texts side by side, and
the window's grouping compares neighbours in full and gives each the smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, free_name, materialise

SPACE_RUN = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 512, lead_chars: int = 24) -> DataFrame:
    """docs, with keep_id, group_size, kept and text_sha256 for every row.

    A group of over hot_rows copies is counted beforehand by a partial aggregate and dealt out in runs of about hot_rows
    rows, so that no task sorts a whole group; runs of one group are told to be equal by SHA-256, rows of a run by full
    comparison. Only the leading lead_chars characters and the digest serve as splitters, whatever a text's length.

    Null text counts as empty. Null identifiers sort last: they stay only if the whole group has none. Of rows that also
    share the identifier, one stays. An empty table gives an empty result. Columns of docs with the names of results are
    replaced by the results.
    """
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    norm, lead, salt, runs, least, size, place = (free_name(n, docs.columns) for n in ("norm", "lead", "salt", "runs", "least", "size", "place"))
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ")

    groups = docs.select(F.col(id_col), F.sha2(text, 256).alias("text_sha256")).groupBy("text_sha256").agg(F.count("*").alias(size), F.min(id_col).alias(least))
    hot = materialise(groups.where(F.col(size) > hot_rows).select("text_sha256", size, least, F.ceil(F.col(size) / hot_rows).cast("int").alias(runs)), "exact-hot")

    rows = docs.select(*names, text.alias(norm)).withColumn("text_sha256", F.sha2(F.col(norm), 256)).withColumn(lead, F.substring(norm, 1, lead_chars))
    rows = rows.join(checked_broadcast(hot), "text_sha256", "left")
    rows = rows.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(id_col), F.col(runs)), F.lit(0)).cast("int"))
    rows = rows.repartitionByRange(lead, "text_sha256", salt)

    equal = Window.partitionBy(lead, "text_sha256", salt, norm)
    ordered = equal.orderBy(F.col(id_col).asc_nulls_last())
    rows = rows.withColumn(place, F.row_number().over(ordered)).withColumn("keep_id", F.first(id_col).over(ordered)).withColumn("group_size", F.count("*").over(equal))
    rows = rows.withColumn("keep_id", F.when(F.col(size).isNotNull(), F.col(least)).otherwise(F.col("keep_id")))
    rows = rows.withColumn("group_size", F.coalesce(size, "group_size"))
    rows = rows.withColumn("kept", (F.col(place) == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
    return rows.select(*names, "keep_id", "group_size", "kept", "text_sha256")
