"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of ``simhash``, on five words: fingerprints of 64 bits, covering tables, comparison of the bits, components
of what differs in ``RADIUS`` bits or fewer.  The members of such a class are then compared exactly.  A pair at 0.8 differs in
about 10 of 64 bits, though: radius 4 finds 8 % of such pairs, and radius 12, which finds 96 %, takes 8191 tables.  So min-wise
samples of the same shingles complete the candidates: ``BANDS`` keys of ``ROWS`` minima each, of which a pair at 0.8 shares
none with probability (1 - 0.8**4)**24, about 3 in a million, and more similar pairs less often.  Every candidate is decided
by the exact similarity of both sets of 64-bit shingle hashes, and components are taken over the pairs that pass.

Scale: texts with equal shingles are one node; joins with candidates are merges at any size, as both sides grow with the
documents.  Buckets with the same members are decided once.  Members stream into the task that holds their bucket, which
emits only a spanning star per component.  A task holds at most about ``CAP`` shingles and ``BLOCK`` members (twice that for
two parts that meet): a bucket of more is dealt to parts by weight.  The parts share a few members, so copies of one text
come together without meeting in pairs of parts; only what stays outside the bucket's largest component then meets all parts.

Results for unusual input: null, empty and blank texts are copies of each other; fewer words than a shingle are one shingle;
rows that repeat an id are separate rows, told apart by ``place``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, ODD2, U, chunks, gram_hash, materialise, mix, prepare, remove, runs, span_hash, to_signed
from .components import components
from .simhash import RADIUS, masks
from .simhash import links as within_radius

SHINGLE = 5
BANDS = 24
ROWS = 4
#: Members and shingles that a task decides at once: about 60 bytes of memory a shingle.
BLOCK = 20_000
CAP = 1 << 20
#: Members of a crowded bucket that all its parts share.
SHARED = 8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_draw = np.random.default_rng(5)
_TIMES = _draw.integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_FLIP = _draw.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of a run of texts, and the first of each text (with the total at the end): at least one each."""
    low = _FOLD[data]
    starts, ends = runs(_WORD[low], bounds)
    h, first = span_hash(low, starts, ends), np.searchsorted(starts, bounds, "left")
    n = np.diff(first)
    count = np.maximum(1, n - SHINGLE + 1)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    grams = gram_hash(h, SHINGLE)
    text = np.repeat(np.arange(len(n)), np.diff(first))[: len(grams)]
    whole = np.flatnonzero(np.arange(len(grams)) + SHINGLE <= first[text + 1])
    out[at[text[whole]] + whole - first[text[whole]]] = grams[whole]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        if len(short):
            out[at[short]] = gram_hash(h, k)[first[short]]
    return out, at


_MASKS = np.array(masks(RADIUS), np.uint64)


def fingerprints(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each text: bits set in over half of its shingles; ``at`` is the first of its shingles ``v``."""
    size = np.diff(np.append(at, len(v)))
    fp = np.zeros(len(at), np.uint64)
    for b in range(64):
        fp |= (2 * np.add.reduceat((v >> U(b)) & U(1), at) > size).astype(np.uint64) << U(b)
    return fp


def covering_keys(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Key of each text in each covering table, as ``simhash.links`` deals fingerprints; the tests look at single tables by it."""
    fp = fingerprints(v, at)
    return mix((fp[:, None] & _MASKS[None, :]) * ODD2[2] + np.arange(BANDS, BANDS + len(_MASKS), dtype=np.uint64) * ODD2[1])


def _samples(batches):
    """place, number of shingles, SimHash, 128 bits that are equal for equal ones, and the keys of the bands."""
    for b in batches:
        places = b.column(0)
        for x, z, bounds, data in chunks(b.column(1)):
            v, at = shingles(bounds, data)
            at = at[:-1]
            same = [np.add.reduceat(mix(v ^ ODD[48 + i]), at) for i in (0, 1)]
            keys = np.zeros((z - x, BANDS), np.uint64)
            for t in range(BANDS):
                for j in range(t * ROWS, (t + 1) * ROWS):
                    keys[:, t] = mix(keys[:, t] * ODD2[0] + np.minimum.reduceat((v ^ _FLIP[j]) * _TIMES[j], at))
                keys[:, t] = mix(keys[:, t] + U(t) * ODD2[1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(z - x + 1) * keys.shape[1], pa.int32()), pa.array(to_signed(keys.ravel())))
            size = pa.array(np.diff(np.append(at, len(v))))
            yield pa.record_batch([places.slice(x, z - x), size, *(pa.array(to_signed(s)) for s in (fingerprints(v, at), *same)), lists], names=["place", "size", "fp", "a", "b", "keys"])


def _stars(nodes: list[int], sets: list[np.ndarray], seeds: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member that hangs together with a seed to one seed of its component inside the bucket."""
    order = np.argsort(nodes, kind="stable")
    ids = np.array(nodes, np.int64)[order]
    sets, seed = [sets[i] for i in order], np.array(seeds)[order]
    size = np.array([len(s) for s in sets])
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    o = np.argsort(value, kind="stable")
    value, owner = value[o], owner[o]
    left, listed = np.ones(len(sets), bool), len(sets)
    us, vs = [], []
    for i in np.flatnonzero(seed).tolist():
        if not left[i]:
            continue
        left[i] = False
        front, kept = [i], int(left.sum())
        while front and kept:
            if 2 * kept < listed:  # those already linked leave the lists
                on = left[owner]
                value, owner, listed = value[on], owner[on], kept
            s = sets[front.pop()]
            lo = np.searchsorted(value, s, "left")
            n = np.searchsorted(value, s, "right") - lo
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[hit], minlength=len(sets))
            near = np.flatnonzero(left & (5 * both >= 4 * (size + len(s) - both)))
            if len(near):
                left[near] = False
                kept -= len(near)
                front.extend(near.tolist())
                us.append(ids[near])
                vs.append(np.full(len(near), ids[i]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def _decide(batches):
    """Rows sorted by unit (unit, node, seed, size, z): links between members of 0.8 or more."""
    now, nodes, sets, seeds = None, [], [], []

    def out():
        u, v = _stars(nodes, sets, seeds)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    codec = pa.Codec("zstd")
    for b in batches:
        unit, ids, seed = (b.column(i).to_pylist() for i in range(3))
        texts = [codec.decompress(t, n, asbytes=True) for n, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        for x, z, bounds, data in chunks(pa.array(texts, pa.binary())):
            v, at = shingles(bounds, data)
            for i in range(x, z):
                if unit[i] != now:
                    if len(nodes) > 1:
                        yield out()
                    now, nodes, sets, seeds = unit[i], [], [], []
                nodes.append(ids[i])
                seeds.append(seed[i])
                sets.append(np.unique(v[at[i - x] : at[i - x + 1]]))
    if len(nodes) > 1:
        yield out()


def _compress(batches):
    codec = pa.Codec("zstd", 3)
    for b in batches:
        raw = [t.encode() for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["node", "bytes", "z"])


def _parts(members, weight, block: int, cap: int):
    return F.ceil(F.greatest(members / block, weight / cap)).cast("int")


def _deal(parts, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")


def _upto(parts):
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _within(texts: DataFrame, units: DataFrame) -> DataFrame:
    """Links inside units (unit, node, seed), as a table; texts: (node, bytes, z)."""
    rows = texts.join(units.hint("merge"), "node").select("unit", "node", "seed", "bytes", "z")
    return materialise(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_decide, "u long, v long"), "links")[0]


def _outside(crowded: DataFrame, first: DataFrame, own, block: int, cap: int) -> DataFrame:
    """Units in which what ``first`` left outside the largest component of its bucket meets all the bucket's parts.

    Members of that component hang together already, so no pair of them is looked at again.
    """
    roots, _ = materialise(components(first), "roots")
    named, _ = materialise(crowded.join(roots.hint("merge"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "named")
    largest = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("top")).select("key", F.col("top.root").alias("root"))
    rest, _ = materialise(named.join(largest.hint("merge"), ["key", "root"], "left_anti").select("key", "node", "size"), "rest")
    shares = rest.groupBy("key").agg(_parts(F.count("*"), F.sum("size"), block, cap).alias("shares"))
    dealt = crowded.join(shares, "key")
    asked = rest.select("key", "node").join(dealt.select("key", "node", "parts", "shares"), ["key", "node"])
    asked = asked.select("key", _deal(F.col("shares"), 2).alias("share"), _upto(F.col("parts")).alias("part"), "node", F.lit(True).alias("seed"))
    every = dealt.select("key", _upto(F.col("shares")).alias("share"), own.alias("part"), "node", F.lit(False).alias("seed"))
    return asked.unionByName(every).select(F.xxhash64("key", "share", "part").alias("unit"), "node", "seed")


def classes(nodes: DataFrame) -> DataFrame:
    """(node, size, class) of the nodes (node, size, fp): one class for all that fingerprints within the radius connect."""
    roots, _ = materialise(components(within_radius(nodes.select("fp").distinct())), "simhash_roots")
    named = nodes.select("node", "size", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return named.select("node", "size", F.coalesce("root", "fp").alias("class"))


def links(rows: DataFrame, nodes: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """Pairs (u, v) of nodes that connect all near copies; rows: (place, text), nodes: (node, size, fp, keys)."""
    alike, alike_path = materialise(classes(nodes).select("node", "size", F.xxhash64(F.lit("class"), "class").alias("key")), "classes")
    tables = alike.unionByName(nodes.select("node", "size", F.explode("keys").alias("key")))
    buckets = tables.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all"), F.sum("size").alias("weight")).where("n > 1")
    once = buckets.groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key"), F.min("weight").alias("weight"))
    chosen, chosen_path = materialise(once.select("key", _parts(F.col("n"), F.col("weight"), block, cap).alias("parts")), "buckets")
    members, members_path = materialise(tables.join(chosen.hint("merge"), "key").select("key", "node", "size", "parts"), "members")
    texts = rows.select("place", "text").mapInArrow(_compress, "node long, bytes long, z binary")
    seed, own = F.lit(True).alias("seed"), _deal(F.col("parts"), 0)
    units = members.where("parts = 1").select(F.col("key").alias("unit"), "node", seed)
    crowded = members.where("parts > 1")
    if crowded.isEmpty():
        found = _within(texts, units)
    else:
        shared = crowded.groupBy("key", _deal(F.lit(SHARED), 1).alias("s")).agg(F.min("node").alias("node"), F.max("parts").alias("parts"))
        shared = shared.select("key", "node", own.alias("own"), _upto(F.col("parts")).alias("part")).where("part <> own")
        parts = crowded.select("key", own.alias("part"), "node").unionByName(shared.select("key", "part", "node"))
        first = _within(texts, units.unionByName(parts.select(F.xxhash64("key", "part").alias("unit"), "node", seed)))
        found = first.unionByName(_within(texts, _outside(crowded, first, own, block, cap)))
    remove(rows.sparkSession, chosen_path, members_path, alike_path)
    return found


def survivors(rows: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """place of one row of each component of near copies; rows: (place, doc_id, text), a table with a unique ``place``.

    The one of smallest doc_id stays (null after all others), then of smallest text hash, then of smallest place.
    """
    prepare(rows.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("place", F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    sampled, _ = materialise(rows.select("place", "text").mapInArrow(_samples, "place long, size long, fp long, a long, b long, keys array<long>"), "samples")
    ids, _ = materialise(sampled.groupBy("a", "b").agg(F.min("place").alias("node")), "nodes")
    nodes, _ = materialise(sampled.select(F.col("place").alias("node"), "size", "fp", "keys").join(ids.select("node"), "node", "left_semi"), "keys")
    roots, _ = materialise(components(links(rows, nodes, block, cap)), "roots")
    named = sampled.select("place", "a", "b").join(ids, ["a", "b"]).join(roots, "node", "left").select("place", F.coalesce("root", "node").alias("root"))
    order = rows.select("place", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    return named.join(order, "place").groupBy("root").agg(F.min(F.struct("none", "id", "h", "place")).alias("first")).select("first.place")
