"""Hard negatives by blocked matrix products.

Anchors are dealt to blocks whose number of rows and bytes is checked before a block is broadcast.  Each task multiplies
the block by its candidates, some thousand at a time, in float64: components are integers, so products are exact while the
largest magnitudes of both sides and the number of components bound them below 2**53; blocks beyond that use integers of any
size.  The first pass keeps each anchor's best positives; tasks keep a running best, so an anchor has a few rows a
task to merge.  The merged scores of a block's positives, at most ``ROWS`` times ``POSITIVES``, are broadcast as windows, and
the second pass keeps the best negatives of each window in the same way.

Scale: a block costs two scans of the candidates, without a shuffle of vectors; its results are appended to the result
table before the next block starts.  No pair of rows is emitted but the best of a task.

Results for unusual input: rows with a null label or vector, or with a null or non-finite component, take no part, nor
do those with a component that 256 times its value isn't finite; the shorter of two vectors counts as padded with zeros, an
empty one scores 0; a null vec_id is no anchor and comes last in ties; rows that repeat a vec_id are separate rows, each an
anchor of its own if its id is one; scores beyond a long are held at its limits; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_path, prepare, remove

ANCHOR_EVERY = 100
FLIP_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
WINDOW = (80, 100)
ROWS = 4096
BYTES = 1 << 25
CANDIDATES = 4096
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


# --- the rows that take part --------------------------------------------------------------------------------------


def _scaled(batches):
    """vec_id, label, and the components times ``SCALE``, rounded down, as the bytes of float64."""
    for b in batches:
        vectors = b.column(1)
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(values * SCALE)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # a null component is read as nan
        fine = (bad[ends] == bad[ends - size]) & vectors.is_valid().to_numpy(zero_copy_only=False) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
        raw = [x[e - n : e].tobytes() for n, e in zip(size[fine].tolist(), ends[fine].tolist(), strict=True)]
        keep = pa.array(fine)
        yield pa.record_batch([b.column(0).filter(keep), b.column(2).filter(keep), pa.array(raw, pa.binary())], names=["vec_id", "label", "x"])


def rows_of(vectors: DataFrame) -> DataFrame:
    """The rows that take part (row, vec_id, label, x), as a table with an identity of each row."""
    flipped = F.when(F.col("vec_id") % FLIP_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), flipped.cast("long").alias("label"))
    return materialise(typed.mapInArrow(_scaled, "vec_id long, label long, x binary").select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")[0]


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors as rows, padded with zeros to the longest."""
    sizes = [len(r) // 8 for r in raw]
    width = max(sizes, default=0)
    if all(s == width for s in sizes):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        out[i, : sizes[i]] = np.frombuffer(r, np.float64)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, exact, as int64."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(abs(a).max()) * int(abs(b).max()) * width < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def best(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest fitting scores of each row, the first columns of equal ones; rows rise."""
    n = score.shape[1]
    bits = max(1, (n - 1).bit_length())
    if n and -(1 << (62 - bits)) < int(score.min()) and int(score.max()) < 1 << (62 - bits):
        key = np.where(fits, (score << bits) + (n - 1 - np.arange(n)), LEAST)  # one number for the score and the place
        top = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), score.shape)
        r, c = np.nonzero(np.take_along_axis(fits, top, 1))
        return r, top[r, c]
    r, c = np.nonzero(fits)
    order = np.lexsort((c, ~score[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
    return r[first], c[first]


def _merged(k: int, held: tuple, new: tuple) -> tuple:
    """The ``k`` best of each group among both (group, score, vec_id, absent) columns."""
    group, score, ids, absent = (np.concatenate(x) for x in zip(held, new, strict=True))
    order = np.lexsort((ids, absent, ~score, group))  # ~: larger scores first, without overflow
    group, score, ids, absent = group[order], score[order], ids[order], absent[order]
    first = np.arange(len(group)) - np.searchsorted(group, group, "left") < k
    return group[first], score[first], ids[first], absent[first]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _candidates(batches):
    """Candidates (row, vec_id, absent, label, matrix), ``CANDIDATES`` or ``BYTES`` at a time, sorted by vec_id."""
    held, count, size = [], 0, 0

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        ids, absent = pc.fill_null(t.column(1), 0).to_numpy(), t.column(1).is_null().to_numpy()
        order = np.lexsort((ids, absent))
        return t.column(0).to_numpy()[order], ids[order], absent[order], t.column(2).to_numpy()[order], matrix(t.column(3).take(pa.array(order)).to_pylist())

    for b in batches:
        at = 0
        while at < b.num_rows:
            some = b.slice(at, CANDIDATES - count)
            at += some.num_rows
            held.append(some)
            count, size = count + some.num_rows, size + some.nbytes
            if count == CANDIDATES or size >= BYTES:
                yield out()
                held, count, size = [], 0, 0
    if held:
        yield out()


def _positives(block):
    """Best positives (anchor, score, vec_id) of the anchors of a block within a task."""

    def work(batches):
        rows, labels, a = block.value
        found = _NONE
        for row, ids, absent, label, x in _candidates(batches):
            s = scores(a, x)
            r, c = best(s, (labels[:, None] == label[None, :]) & (rows[:, None] != row[None, :]), POSITIVES)
            found = _merged(POSITIVES, found, (r, s[r, c], ids[c], absent[c]))
        yield _rows(found)

    return work


def _negatives(block, windows):
    """Best negatives (window, score, vec_id) of the windows (anchor, least, most) of a block within a task."""

    def work(batches):
        _, labels, a = block.value
        anchor, low, high = windows.value
        found = _NONE
        for _, ids, absent, label, x in _candidates(batches):
            s = scores(a, x)
            other = labels[:, None] != label[None, :]
            step = max(1, (1 << 20) // max(1, len(ids)))
            for w in range(0, len(anchor), step):
                at = anchor[w : w + step]
                part = s[at]
                r, c = best(part, other[at] & (part >= low[w : w + step, None]) & (part <= high[w : w + step, None]), NEGATIVES)
                found = _merged(NEGATIVES, found, (r + w, part[r, c], ids[c], absent[c]))
        yield _rows(found)

    return work


_FOUND = "at int, score long, vec_id long"


def _rows(found: tuple) -> pa.RecordBatch:
    group, score, ids, absent = found
    return pa.record_batch([pa.array(group, pa.int32()), pa.array(score), pa.array(ids, mask=absent)], names=["at", "score", "vec_id"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each group over all tasks, with their rank."""
    order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- blocks of anchors ----------------------------------------------------------------------------------------------


def blocks_of(anchors: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, int]:
    """``anchors`` with ``block``, and the number of blocks: none has over ``most_rows`` rows or ``most_bytes`` bytes, but for
    a single vector beyond them.  The sizes are counted, and the number of blocks is doubled until they hold."""
    n, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    count = max(1, -(-2 * n // most_rows), -(-2 * size // most_bytes))
    while True:
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("size"))
        if sizes.where((F.col("n") > most_rows) | (F.col("n") > 1) & (F.col("size") > most_bytes)).isEmpty():
            return dealt, count
        count *= 2


def mine(vectors: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors: (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = rows_of(vectors)
    dealt, count = blocks_of(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0), most_rows, most_bytes)
    path = new_path(spark, "anchors")
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    anchors = spark.read.schema(dealt.schema).parquet(path)
    result = new_path(spark, "hard_negatives")
    form = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], form).write.parquet(result)
    for b in range(count):
        mine_block(anchors.where(F.col("block") == b), rows, result)
    remove(spark, path)
    return spark.read.schema(form).parquet(result)


def mine_block(anchors: DataFrame, rows: DataFrame, result: str) -> None:
    """Append the hard negatives of one block of anchors; the driver holds the block and its positives, both bounded."""
    spark = rows.sparkSession
    held = anchors.select("row", "vec_id", "label", "x").toArrow()
    if not held.num_rows:
        return
    ids, label = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
    block = spark.sparkContext.broadcast((held.column("row").to_numpy(), label, matrix(held.column("x").to_pylist())))
    candidates = rows.select("row", "vec_id", "label", "x")
    positives = _top(candidates.mapInArrow(_positives(block), _FOUND), POSITIVES).select("at", "score", "vec_id").collect()
    at = np.array([p["at"] for p in positives], np.int64)
    low = np.array([min(MOST, -(-WINDOW[0] * p["score"] // WINDOW[1])) for p in positives], np.int64)
    high = np.array([p["score"] for p in positives], np.int64)
    windows = spark.sparkContext.broadcast((at, low, high))
    known = spark.createDataFrame([(w, int(ids[p["at"]]), p["vec_id"], p["score"]) for w, p in enumerate(positives)], "at int, anchor_id long, positive_id long, positive_score long")
    found = _top(candidates.mapInArrow(_negatives(block, windows), _FOUND), NEGATIVES)
    # at most ROWS * POSITIVES windows: a side of bounded size
    named = found.join(F.broadcast(known), "at")
    named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(result)
    block.destroy()
    windows.destroy()
