"""Cleaning pipeline over ``documents``: language, near copies, repeated strings, benchmark passages, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.

Results for unusual input: null and empty texts and those without letters go with the first stage; rows are judged by row, so
null or repeated ids take no others with them; of near copies the smallest id stays (null after all others); for repeated
strings a null id is earlier than all others; texts are cut by 100-byte strings however long they are; with nothing to learn
languages from, every text is rejected; an empty table gives an empty result; columns that ``documents`` doesn't have are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, langid, packing, suffix_dedup
from ledgerlake.llm import near_copies as shingle_copies
from ledgerlake.llm.common import materialise, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go; the rest stay as they are.

    The verdict is added to each row in one pass, without a join.
    """
    prepare(spark)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return langid.keep(docs.select(*COLUMNS), langid.fit(typed))


def placed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``place``, an identity of each row: ids may be null or repeat.  It is written before it is used."""
    return materialise(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("place")), name)[0]


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one of smallest id."""
    rows = placed(docs, "near_copies_rows")
    return rows.join(shingle_copies.survivors(rows), "place", "left_semi").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur earlier are cut from the text; documents of which nothing is left go."""
    found = suffix_dedup.dedup(docs.select("doc_id", "text", "lang", "source"), keep_text=True, carry=("lang", "source"))
    return found.where("n_bytes = 0 or n_removed < n_bytes").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = placed(docs, "benchmark_rows")
    hit = decontaminate.decontaminate(rows.select(F.col("place").alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("place"))
    return rows.join(hit, "place", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces placed in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: Hashes of shingles and centroids aren't expressible in SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
