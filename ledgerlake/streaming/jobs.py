"""Structured Streaming versions of the ingestion steps.

A job belongs to a root folder, which holds its checkpoint and its results.  Every call reads a table as a stream, from where
the checkpoint stands to the end of what is there (``availableNow``), so a scheduler can call it again, in another session
too: what has been read isn't read again.  A batch writes the folder ``b<epoch>`` whole, so one that is run again replaces
itself and no other.  Results are found by listing the root; the driver remembers nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_path

COMPACT = 16


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table as a stream with its own schema; ``ts`` as a timestamp, which watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    return follow(spark, path + "*", spark.read.parquet(path).schema, files_per_batch)


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def drain(stream: DataFrame, mode: str, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``stream`` over all that is available now."""
    q = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _found(spark: SparkSession, root: str, kind: str) -> list[int]:
    """The epochs of the finished folders of a kind under ``root``; compaction keeps them few."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}[0-9]*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in done)


def _paths(spark: SparkSession, root: str) -> list[str]:
    """The newest compacted table and the batches after it."""
    base = _found(spark, root, "v")[-1:]
    return [f"{root}/v{e}" for e in base] + [f"{root}/b{e}" for e in _found(spark, root, "b") if not base or e > base[0]]


def _read(spark: SparkSession, root: str, schema) -> DataFrame:
    paths = _paths(spark, root)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def appended(stream: DataFrame, root: str | None = None, mode: str = "append") -> DataFrame:
    """All rows that a streaming query has emitted under ``root``."""
    spark, schema = stream.sparkSession, stream.schema
    root = root or new_path(spark, "stream")
    drain(stream, mode, lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/b{epoch}"), f"{root}/checkpoint")
    return _read(spark, root, schema)


def merged(stream: DataFrame, keys: list[str], order: str, root: str | None = None, mode: str = "append") -> DataFrame:
    """The last row of each key by ``order`` (the later batch counts where it is equal).

    A batch writes one row for each of its own keys and leaves the others alone; after ``COMPACT`` batches they are
    merged into one table.
    """
    spark, rest = stream.sparkSession, [c for c in stream.columns if c not in keys]
    root = root or new_path(spark, "stream")
    kept = stream.withColumn("_epoch", F.lit(0).cast("long"))

    def last(df: DataFrame) -> DataFrame:
        best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_epoch"), F.struct(order, "_epoch")).alias("x"))
        return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in [*rest, "_epoch"])).select(*kept.columns)

    drain(stream, mode, lambda df, epoch: last(df.withColumn("_epoch", F.lit(epoch).cast("long"))).write.mode("overwrite").parquet(f"{root}/b{epoch}"), f"{root}/checkpoint")
    result = last(_read(spark, root, kept.schema))
    batches = _found(spark, root, "b")
    if len(_paths(spark, root)) > COMPACT:
        result.write.mode("overwrite").parquet(f"{root}/v{batches[-1]}")
        result = _read(spark, root, kept.schema)
    return result.drop("_epoch")


def windowed(events: DataFrame, window: Column, *keys: str, late: str = "2 days") -> DataFrame:
    """Counts and totals by window and keys; what is later than ``late`` is dropped, and so is the state of older windows.

    In ``update`` mode a window comes again whenever it grows; ``merged`` by start and keys has its last state.
    """
    value = F.sum(F.col("value").cast("decimal(20,4)")).cast("double")
    g = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(value, 2).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *keys, "n", "total")


def complete(stream: DataFrame, root: str | None = None) -> DataFrame:
    """A streaming aggregation as it stands at the end.  Its state is never dropped: for session windows, which have no
    ``update`` mode, and only over keys and spans that are bounded."""
    spark, schema = stream.sparkSession, stream.schema
    root = root or new_path(spark, "stream")
    drain(stream, "complete", lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/v{epoch}"), f"{root}/checkpoint")
    return _read(spark, root, schema)


def changes(docs: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, version, order, content) whenever the content of a key is another than before, at any age.

    The state of a key is its last content and version.  Rows of a batch are taken by ``order``; one that comes after a
    later one is no change, and equal orders go by content.  Null keys are one key, null content is content like any other.
    """
    names, form = [key, order, content], "version long, at long, content string"
    typed = docs.select(F.col(key), F.col(order).cast("long").alias(order), F.col(content).cast("string").alias(content))
    out = f"{key} {typed.schema[key].dataType.simpleString()}, version long, {order} long, {content} string"

    def step(found: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, at, last = state.get if state.exists else (0, None, None)
        rows = []
        new = pd.concat(list(batches))
        for when, value in sorted(zip(new[names[1]].tolist(), new[names[2]].tolist(), strict=True), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if at is not None and when < at:
                continue
            at = when
            if not version or value != last:
                version, last = version + 1, value
                rows.append((found[0], version, when, value))
        state.update((version, at, last))
        yield pd.DataFrame(rows, columns=[names[0], "version", names[1], names[2]])

    return typed.groupBy(key).applyInPandasWithState(step, out, form, "append", "NoTimeout")


def subscribed(subscriptions: DataFrame, events: DataFrame, back: str = "3 days", late: str = "2 days") -> DataFrame:
    """What had happened to an item in the time before it was subscribed to: (sub_id, event_id, lag_s).

    Both streams (item, ts and an id) have watermarks, so the state of either is dropped once no partner can come.
    """
    s = subscriptions.withWatermark("ts", late).select("sub_id", F.col("item").alias("watched"), F.col("ts").alias("since"))
    e = events.withWatermark("ts", late).select("event_id", "item", "ts")
    hit = s.join(e, F.expr(f"item = watched and ts <= since and ts >= since - interval {back}"))
    return hit.select("sub_id", "event_id", (F.unix_timestamp("since") - F.unix_timestamp("ts")).alias("lag_s"))
