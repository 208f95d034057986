"""From raw documents to packed training sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir), works on every row that the one before kept, and returns a DataFrame
that is written as Parquet and read again. All but the last return the columns of documents.

Every stage judges rows by themselves, not by identifier: null and repeated identifiers do no harm, and rows that are equal in identifier
and text are judged alike. Null texts have no letters, no words and no ids; they are dropped by the first stage, and kept as empty ones
by the others but for exact copies. An empty table gives an empty result. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, materialise
from ledgerloom.llm.decontaminate import contamination
from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.language_id import held_out, identify_language, language_dictionaries
from ledgerloom.llm.ngram_join import similar_documents
from ledgerloom.llm.packing import pack_documents


def keyed(docs: DataFrame) -> DataFrame:
    """A key (as doc_id) and text of each row. Operators carry it, so that each row is judged by itself, whatever its doc_id.

    Only rows of equal doc_id and text share a key, and those are judged alike.
    """
    return docs.select(_key().alias("doc_id"), "text")


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose key is not in gone (key)."""
    name = free_name("key", docs.columns)
    return docs.withColumn(name, _key()).join(gone.select(F.col("key").alias(name)), name, "left_anti").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language was told; those without letters or with too narrow a margin go."""
    judged = identify_language(keyed(docs), language_dictionaries(docs.where(~held_out())))
    return without(docs, judged.where("rejected").select(F.col("doc_id").alias("key")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of equal texts: that of the least identifier, of those one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in rest), F.lit(0).alias(free_name("none", rest))).alias("rest"))
    kept = exact_dedup(rows).where("kept")
    return kept.select(*(F.col("rest")[c].alias(c) if c in rest else F.col(c) for c in docs.columns))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that links of similarity 0.8 or more over five-word shingles connect.

    The first has the least identifier (null comes last), of equal ones the least key. Texts without words link with nothing.
    """
    judged = similar_documents(keyed(docs), k=5, percent=80)
    linked = materialise(judged.where("doc_id <> component_id").select(F.col("doc_id").alias("key"), "component_id"), "similar-linked")
    members = linked.unionByName(linked.select(F.col("component_id").alias("key"), "component_id")).distinct()
    # the first: of the least doc_id, null after all others
    members = docs.select(_key(), "doc_id").join(members, "key").withColumn("place", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    first = members.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = members.join(first, "component_id").where(F.col("key") != F.col("first.key")).select("key")
    return without(docs, gone)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a window of benchmark words; null texts have none."""
    judged = contamination(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, judged.where("n_hit > 0").select(F.col("doc_id").alias("key")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 ids; a null text is one piece, the end id."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", similar_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither compression nor the tokenizer; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
