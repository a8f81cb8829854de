"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_path
from . import decontaminate, filter_audit, hard_negatives, html_extract, langid, materialise, ngram_join, oracles, packing, quality, simhash, suffix_dedup, token_rollup, url_filters
from .common import materialise as written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("row")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("row")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come, change and stay: the totals are those of the whole table, for two tokenizers.

    The first batch inserts every document with its number of characters as a provisional count; the second revises all
    of them to their tokens; the third deletes all; the first two are then sent again, which changes
    nothing; the batches are compacted; and the fourth brings every document back.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted, _ = written(token_rollup.count_tokens(docs), "token_counts")
    rough = docs.select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, token_rollup.VERSIONS))).alias("version"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    none = counted.where("false")
    store = new_path(spark, "token_rollup")
    batches = {
        "insert": token_rollup.signed(none, rough), "revise": token_rollup.signed(rough, counted),
        "delete": token_rollup.signed(counted, none), "restore": token_rollup.signed(none, counted),
    }
    for batch in ("insert", "revise", "delete", "insert", "revise"):
        token_rollup.commit(spark, store, batch, batches[batch])
    token_rollup.compact(spark, store)
    token_rollup.commit(spark, store, "restore", batches["restore"])
    return token_rollup.totals(spark, store).select("source", "lang", "version", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_benchmark_decontamination,
        op3_suffix_array_dedup,
        op4_language_id,
        op5_url_filters,
        op6_quality_rules,
        op7_token_counts,
        op8_simhash_near_dedup,
        op9_token_id_output,
        op10_html_extraction,
        op11_filter_interaction_audit,
        op12_ngram_jaccard_join,
        op13_hard_negative_mining,
    )
}
ORACLE_SQL = oracles.ORACLE_SQL
