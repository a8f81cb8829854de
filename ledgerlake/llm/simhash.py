"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of radius + 1 bits.  Table v (each nonzero vector) keeps the bits whose vector
has an odd product with v.  Any ``radius`` differing bits leave at least one v orthogonal to all of them, so every pair
within the radius agrees in some table, always.

Equal fingerprints are one node.  A bucket of two is decided by its least and greatest member inside the aggregation;
buckets of up to ``BLOCK`` members are compared in the task, which emits only a spanning star per component; larger
ones go through midpoints: each member lists the fingerprints within half the radius on the bits its table ignores, and
members that meet at one midpoint are linked to the least of them (at most a few hundred can meet).  No bucket is cut,
and none emits its pairs.

Results for unusual input: null, empty and blank texts have the zero fingerprint and link like any other; fewer words
than a shingle are one shingle; rows that repeat a doc_id are separate rows of the same id; null ids never name a
component unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, remove
from .components import components

SHINGLE = 4
RADIUS = 4
BLOCK = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant bit first: bit set where over half of the shingles' hashes have it."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # both ASCII only, on bytes
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    if len(words) <= shingle:
        hashes = xxh64_digest(joined, 42)
    else:
        hashes = b"".join([xxh64_digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def _fingerprints(batches):
    for b in batches:
        found = b"".join([fingerprint((x.as_py() or "").encode()) for x in b.column(1)])
        yield pa.record_batch([b.column(0), pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))], names=["doc_id", "fp"])


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The kept bits of each covering table."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(radius: int):
    """Links from each member of a bucket to the least of its component inside the bucket."""

    def work(batches):
        for b in batches:
            us, vs = [], []
            for fps in b.column(0):
                x = np.sort(fps.values.to_numpy())
                n, y = len(x), x.view(np.uint64)
                near = np.empty((n, n), bool)
                for a in range(0, n, 256):
                    near[a : a + 256] = np.bitwise_count(y[a : a + 256, None] ^ y[None, :]) <= radius
                left = np.ones(n, bool)
                for i in range(n):
                    if not left[i]:
                        continue
                    left[i] = False
                    front = np.array([i])
                    while len(front):
                        front = np.flatnonzero(near[front].any(axis=0) & left)
                        left[front] = False
                        if len(front):
                            us.append(x[front])
                            vs.append(np.full(len(front), x[i]))
            none = np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(np.concatenate([none, *us])), pa.array(np.concatenate([none, *vs]))], names=["u", "v"])

    return work


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of fingerprints that the radius connects, directly or within a bucket, as a table: enough to connect all."""
    spark = nodes.sparkSession
    kept = masks(radius)
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(kept)]
    tables = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    buckets, buckets_path = materialise(tables.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    two = buckets.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).where("n = 2").select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    members, members_path = materialise(tables.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"]), "members")
    some = members.where(F.col("n") <= block).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_stars(radius), "u long, v long")
    half = [(t, _signed(sum(1 << i for i in c))) for t, m in enumerate(kept) for k in range(radius // 2 + 1) for c in combinations([i for i in range(64) if not m >> i & 1], k)]
    flips = spark.createDataFrame(half, "t int, flip long")  # a fixed table: it depends on the radius only
    at = members.where(F.col("n") > block).join(F.broadcast(flips), "t").select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    many = at.withColumn("v", F.min("fp").over(Window.partitionBy("t", "mid"))).where("fp <> v").select(F.col("fp").alias("u"), "v")
    found, _ = materialise(two.unionByName(some).unionByName(many).distinct(), "links")
    remove(spark, buckets_path, members_path)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (long) and component_id for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    fps, _ = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    nodes, _ = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots, _ = materialise(components(links(nodes, radius, block)).join(nodes.withColumnRenamed("fp", "node"), "node"), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.join(roots.join(least, "root").select(F.col("node").alias("fp"), "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
