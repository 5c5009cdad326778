"""The queries op1 to op10 over the tables of a folder; ORACLE_SQL has SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, langid, line_dedup, near_dups, packing, quality, secret_scan, token_store, url_filters
from .common import scratch, table
from .oracles import ORACLE_SQL as ORACLE_SQL

#: The rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"))
    scored = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"), learn=~out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_store.read(spark, path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=1)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return found.select("doc_id", F.col("_cg_lines").alias("n_lines"), F.col("_cg_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.rules_table(spark, URL_RULES))
    return judged.select("page_id", F.col("_cg_host").alias("host"), F.col("_cg_path").alias("path"), F.col("_cg_rule").alias("rule"), F.col("_cg_verdict").alias("verdict"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"))
    found = langid.predicted(docs, langid.fit(docs, learn=~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_ids": op2_token_ids,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_fingerprints": op5_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_language": op8_language,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secret_scan": op10_secret_scan,
}
