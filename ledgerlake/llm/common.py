"""Shared pieces of the operators: shared-folder tables, code shipping, Arrow text chunks, NumPy hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_path

U = np.uint64
CHUNK_BYTES = 1 << 19
BLOCK_BYTES = 1 << 19
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once, and keep Arrow batches of whole texts small."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-"), "ledgerlake_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 512:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no later plan reads."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it again.

    A lost executor costs at most the tasks of the stage that runs; what was written is never recomputed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fold_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- inside tasks -------------------------------------------------------------------------------------------------


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a string column in runs of about ``limit`` bytes: (first row, end row, bounds, bytes).

    Null counts as empty.  A text longer than ``limit`` is a run of its own and stays whole.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, off[a : b + 1] - off[a], data[off[a] : off[b]]
        a = b


_rng = np.random.default_rng(20240229)
BYTE_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
ODD = _rng.integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)
ODD2 = _rng.integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = int(ODD[40])
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow:
        for k, b in (("p", _BASE), ("q", _INV)):
            x = np.full(BLOCK_BYTES + 1, U(b), dtype=np.uint64)
            x[0] = U(1)
            _pow[k] = np.multiply.accumulate(x)
    return _pow["p"], _pow["q"]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes, from one prefix sum over ``data``.

    The sum is taken in blocks and kept at the spans' ends only, so a very long text costs memory by its spans, not bytes.
    ``starts`` and ``ends`` rise.
    """
    p, q = _powers()
    out = np.zeros(len(starts), np.uint64)
    back = np.empty(len(starts), np.uint64)
    before, up, down = U(0), 1, 1
    mask = (1 << 64) - 1
    step, unstep = pow(_BASE, BLOCK_BYTES, 1 << 64), pow(_INV, BLOCK_BYTES, 1 << 64)
    for a in range(0, max(len(data), 1), BLOCK_BYTES):
        part = data[a : a + BLOCK_BYTES]
        last = a + len(part) == len(data)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_TABLE[part] * p[: len(part)] * U(up), out=acc[1:])
        acc += before
        z = a + len(part) + last  # a place at the end of a block belongs to the next, that of the data to the last
        i, j = np.searchsorted(starts, (a, z), "left")
        out[i:j] -= acc[starts[i:j] - a]
        back[i:j] = q[starts[i:j] - a] * U(down)
        i, j = np.searchsorted(ends, (a, z), "left")
        out[i:j] += acc[ends[i:j] - a]
        before, up, down = acc[-1], up * step & mask, down * unstep & mask
    return mix(out * back + (ends - starts).astype(np.uint64) * ODD[41])


def runs(flag: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``flag`` that don't cross the bounds of texts."""
    n = len(flag)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = flag[:-1]
    after = np.zeros(n, bool)
    after[:-1] = flag[1:]
    starts = np.flatnonzero(flag & (~before | cut[:n]))
    ends = np.flatnonzero(flag & (~after | cut[1:])) + 1
    return starts, ends


def gram_hash(h: np.ndarray, k: int, odd: np.ndarray = ODD) -> np.ndarray:
    """Hash of each run of ``k`` values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * odd[0]
    for j in range(1, k):
        out = out + h[j : n + j] * odd[j]
    return mix(out)


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each run of ``w`` values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:n], x[w - size : w - size + n]) if size < w else x[:n]


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
