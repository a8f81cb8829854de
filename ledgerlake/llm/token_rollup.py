"""Token totals by source, language and tokenizer version, maintained from signed changes.

A batch of inserts, deletes and revised counts is reduced to one signed row per (source, lang, version) and written to a
folder of its own; it counts from the moment a small file ``commits/<batch id>`` that names the folder exists.  That file
is created only where none is, so a batch is there whole and once, or not at all, under retries and replays.  Totals are
the sums of all committed rows; since they only add, the order of batches doesn't matter.

``compact`` writes a list of the committed ids first, folds exactly the batches of that list into a snapshot, and then
publishes it by a file ``snapshots/<number>``, again created only where none is.  A batch committed in between isn't on
the list and counts on top of the snapshot; of two compactions at once, one is published and the other discards its work.
Lists of ids are tables, joined by Spark; the driver holds none.  The snapshot keeps the ids of all that it folds, so
``vacuum``, while no reader or writer is at work, folds what is left and then deletes the folders of batches and commits as
a whole; a batch that is replayed after that is still known.  Only snapshots are listed by name, one for each compaction
since the last ``vacuum``.

The store must be a file system whose creation of a file fails if the file exists (HDFS, local; not every object store).

Results for unusual input: null or empty texts count no tokens but one document; null source or lang are groups of
their own; repeated rows count each time; an empty batch commits no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import _fs, exists, prepare, remove

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"
VERSIONS = ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")


def count_tokens(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """doc_id, source, lang, version, n_tokens: a row for each document and tokenizer."""
    prepare(docs.sparkSession)

    def work(batches):
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            for v in versions:
                encode = tokens.encoder(v)
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([v] * len(texts), pa.string()), pa.array([len(encode(t)) for t in texts], pa.int64())], names=["doc_id", *KEYS, "n_tokens"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
    return docs.select(*cols).mapInArrow(work, "doc_id long, source string, lang string, version string, n_tokens long")


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes that turn counts ``before`` into ``after``: deletes as -1, inserts as +1, revisions as both."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


def deltas(changes: DataFrame) -> DataFrame:
    """One additive row per group from changes (source, lang, version, n_tokens, sign)."""
    rows = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("tokens"))
    return rows.where("docs <> 0 or tokens <> 0")


def _name(batch_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch_id):
        raise ValueError(f"batch id {batch_id!r}: letters and digits first, then also '.', '_' and '-'")
    return batch_id


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file if there is none: False if there is."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if not x.getPath().getName().startswith((".", "_"))) if fs.exists(p) else []


def _file_name() -> F.Column:
    return F.col("_metadata.file_name")


def commit(spark: SparkSession, store: str, batch_id: str, changes: DataFrame) -> bool:
    """Commit a batch once.  False if it was there already."""
    mark = f"{store}/commits/{_name(batch_id)}"
    if exists(spark, mark) or _folded(spark, store, batch_id):
        return False
    folder = uuid.uuid4().hex
    deltas(changes).write.parquet(f"{store}/data/{folder}")  # a row a group
    if _create(spark, mark, folder):
        return True
    remove(spark, f"{store}/data/{folder}")
    return False


def _folded(spark: SparkSession, store: str, batch_id: str) -> bool:
    """Whether the newest snapshot holds the batch."""
    at = _snapshot(spark, store)
    return at is not None and not spark.read.parquet(f"{at}/ids").where(F.col("id") == batch_id).isEmpty()


def committed(spark: SparkSession, store: str) -> DataFrame:
    """(id, folder) of the batches that were committed since the last ``vacuum``."""
    if not exists(spark, f"{store}/commits"):
        return spark.createDataFrame([], "id string, folder string")
    return spark.read.text(f"{store}/commits").select(_file_name().alias("id"), F.col("value").alias("folder"))


def _snapshots(spark: SparkSession, store: str) -> list[str]:
    return _children(spark, f"{store}/snapshots")


def _snapshot(spark: SparkSession, store: str) -> str | None:
    """Folder of the newest published snapshot."""
    found = _snapshots(spark, store)
    return f"{store}/folded/{spark.read.text(f'{store}/snapshots/{found[-1]}').first()['value']}" if found else None


def _batches(spark: SparkSession, store: str, ids: DataFrame) -> DataFrame:
    """Rows of the batches in ``ids`` (id, folder)."""
    if not exists(spark, f"{store}/data"):
        return spark.createDataFrame([], DELTA)
    rows = spark.read.schema(DELTA).option("recursiveFileLookup", True).parquet(f"{store}/data")
    rows = rows.select(*rows.columns, F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
    return rows.join(ids, "folder", "left_semi").drop("folder")


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """source, lang, version, docs and tokens over all committed batches, groups without documents left out."""
    at = _snapshot(spark, store)
    ids = committed(spark, store)
    if not at:
        return _sum(_batches(spark, store, ids))
    rest = _batches(spark, store, ids.join(spark.read.parquet(f"{at}/ids"), "id", "left_anti"))
    return _sum(rest.unionByName(spark.read.schema(DELTA).parquet(f"{at}/totals")))


def compact(spark: SparkSession, store: str) -> bool:
    """Fold the batches committed so far into a snapshot.  False if another compaction was published meanwhile."""
    found, at = _snapshots(spark, store), _snapshot(spark, store)
    number = int(found[-1]) + 1 if found else 0
    to = f"{store}/folded/{uuid.uuid4().hex}"
    ids = committed(spark, store)
    if at:
        ids = ids.unionByName(spark.read.parquet(f"{at}/ids")).distinct()
    ids.sort("id").write.parquet(f"{to}/ids")  # from here on this list decides, not the folder
    ids = spark.read.parquet(f"{to}/ids")
    if at:
        rows = _batches(spark, store, ids.join(spark.read.parquet(f"{at}/ids"), "id", "left_anti")).unionByName(spark.read.schema(DELTA).parquet(f"{at}/totals"))
    else:
        rows = _batches(spark, store, ids)
    _sum(rows).write.parquet(f"{to}/totals")
    if _create(spark, f"{store}/snapshots/{number:09d}", to.rsplit("/", 1)[1]):
        return True
    remove(spark, to)
    return False


def vacuum(spark: SparkSession, store: str) -> None:
    """Fold all committed batches, then delete their folders, those never committed, and all older snapshots.

    Only while nothing reads or commits: a writer's folder isn't committed until its file is there.  If it is interrupted
    anywhere, totals stay right: whatever is left of a folded batch is on the snapshot's list.
    """
    compact(spark, store)
    remove(spark, f"{store}/data", f"{store}/commits")
    newest, at = _snapshots(spark, store)[-1], _snapshot(spark, store)
    remove(spark, *(f"{store}/folded/{x}" for x in _children(spark, f"{store}/folded") if x != at.rsplit("/", 1)[1]))
    remove(spark, *(f"{store}/snapshots/{x}" for x in _snapshots(spark, store) if x != newest))
