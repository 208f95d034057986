"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination, contamination_report
from .exact_dedup import exact_dedup
from .language_id import held_out, identify_language, language_dictionaries
from .line_dedup import delete_repeated_lines
from .ngram_join import similar_documents
from .packing import pack_documents
from .suffix_dedup import removal_report, remove_repeats
from .toxicity import score_toxicity, train_chain
from .training_order import materialise_order, order_path
from .url_filter import url_verdicts


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train_chain(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = language_dictionaries(docs.where(~held_out()))
    return identify_language(docs, dictionaries).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_report(contamination(docs, table(spark, sf_dir, "benchmark")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise_order(table(spark, sf_dir, "documents").select("doc_id", "text"), order_path(spark))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language_id": op2_language_id,
        "op3_decontamination": op3_decontamination,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_training_order": op5_training_order,
        "op6_ngram_join": op6_ngram_join,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_url_filter": op10_url_filter,
    }


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM u),
p AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') AS path
  FROM s),
r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
b(name) AS (SELECT n || '.example.' || z FROM (VALUES ('spam-farm'), ('cheap-pills'), ('ads-track')) a(n),
            (VALUES ('com'), ('net'), ('org')) c(z)),
best AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC, rule) AS k
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE host = name OR ends_with(host, '.' || name))
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM best WHERE k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op10_url_filter": OP10_SQL}
