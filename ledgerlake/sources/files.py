"""File sources and sinks: JSON maps and record lists, tab-separated and JSON artifacts, incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reaches has ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str, *alternatives: str) -> DataFrame:
    """One JSON document per file, from the first of the paths that exists; an empty table of the same schema without any."""
    found = next((p for p in (path, *alternatives) if exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(found)


def read_json_map(spark: SparkSession, path: str, field: str, value: str, key: str = "name") -> DataFrame:
    """The entries of a JSON map ``field`` as rows of ``key`` and the columns of the struct type ``value``."""
    doc = read_json(spark, path, f"`{field}` map<string, struct<{value}>>")
    return doc.select(F.explode(field).alias(key, "x")).select(key, "x.*")


def read_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Rows of ``{"records": [{"fields": {...}}]}``, of a bare list, or of a single object."""
    if not exists(spark, path):
        return spark.createDataFrame([], fields)
    t = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("t"))
    wrapped = F.from_json("t", f"records array<struct<fields: struct<{fields}>>>")["records"]
    bare = F.when(F.col("t").startswith("["), F.from_json("t", f"array<struct<{fields}>>")).otherwise(F.array(F.from_json("t", f"struct<{fields}>")))
    return t.select(F.explode(F.coalesce(F.transform(wrapped, lambda x: x["fields"]), bare)).alias("x")).select("x.*")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, as many files as the result has partitions."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated text with a header; files follow each other in the order of a sorted ``df``."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys aren't in the Parquet table at ``path`` yet, one per key; the rows appended.

    The new rows are written beside the table first, so that what is returned is what was appended.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    staged = new_path(spark, "append")
    fresh.write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    rows.write.mode("append").parquet(path)
    return rows
