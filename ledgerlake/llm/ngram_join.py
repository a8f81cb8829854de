"""Jaccard join on sets of word n-grams by a prefix tree.

All n-grams have one global order: by how often their slot of a fixed count table occurs in the corpus, then by hash, so
n-grams that many texts share come last.  Two sets that link share one of their first p = n - ceil(0.9 n) + 1 n-grams in that
order, and s + 1 of their first p + s; so a set may leave s of those out, if all sets choose by one rule.  Those that most
sets have, by an exact count, are left out, and only sets that meet in one of the others are compared.  A parity bit map of
each set (its Hamming distance never exceeds the size of the symmetric difference) takes members without a possible partner
from small groups.  In the task, the groups of a run are one trie over their ordered sets, paths compressed.  Sets are probed
level by level: the overlap with a shared path is counted once for all sets below it, and a subtree goes when what is left of
the probe or of its longest set can't reach the overlap that its shortest set needs, or when all its sets are linked already.

Scale: equal sets are one node.  The count table has ``SLOTS`` slots at any size: it costs 4 MB to broadcast, and n-grams
whose count stands out from the noise of a slot, the root of its load, sort last.  A group of over ``CAP`` n-grams is dealt
to tasks by weight.  Some of its members go to all of them, so that the parts find the group's main component; only members
outside of it meet all parts after that.  No group is held whole, cut or emitted as pairs: links lead to the first member of
what hangs together inside a task.

Results for unusual input: null, empty and blank texts have the empty set, linked with nothing; texts of fewer words than
``SHINGLE`` are one n-gram; rows that repeat a doc_id are separate rows of the same id; null ids never name a component
unless all its ids are null; other columns are ignored.  Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, U, chunks, gram_hash, materialise, mix, prepare, remove, runs, span_hash, to_signed
from .components import components

SHINGLE = 3
SHARE = (90, 100)
SLOTS = 1 << 20
SLOT_ROWS = 64
SKETCH = 512
CAP = 1 << 20
SMALL = 256
STARS = 8
SEEDS = 64
RUN_BYTES = 1 << 21
LEVEL = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def need(total):
    """Least intersection of two linked sets whose sizes add up to ``total``."""
    return -(-SHARE[0] * total // (SHARE[0] + SHARE[1]))


def least(n: int) -> int:
    """Size of the smallest set that can link with one of ``n``."""
    return -(-SHARE[0] * n // SHARE[1])


def spare(n: int) -> int:
    """How many n-grams a set of ``n`` takes beyond its prefix."""
    return (n - least(n) + 1) // 2


def prefix(n: int) -> int:
    return n - least(n) + 1 + spare(n) if n else 0


def slot(v: np.ndarray) -> np.ndarray:
    return (v >> U(44)).astype(np.int64)


def shingle_sets(bounds: np.ndarray, data: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of the distinct shingles of each text of a run, rising."""
    low = _FOLD[data]
    starts, ends = runs(_WORD[low], bounds)
    h, first = span_hash(low, starts, ends), np.searchsorted(starts, bounds, "left")
    grams = gram_hash(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hash(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


# --- the global order -----------------------------------------------------------------------------------------------


def _slot_counts(batches):
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        for _, _, bounds, data in chunks(b.column(0)):
            total += np.bincount(slot(np.concatenate(list(shingle_sets(bounds, data)))), minlength=SLOTS)
    if total.any():
        codec, parts = pa.Codec("zstd"), total.reshape(SLOT_ROWS, -1)
        yield pa.record_batch([pa.array(range(SLOT_ROWS), pa.int32()), pa.array([codec.compress(p.tobytes(), asbytes=True) for p in parts], pa.binary())], names=["part", "counts"])


def _slot_sums(batches):
    codec, sums = pa.Codec("zstd"), {}
    for b in batches:
        for part, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = np.frombuffer(codec.decompress(z, SLOTS // SLOT_ROWS * 8, asbytes=True), np.int64)
            sums[part] = sums[part] + got if part in sums else got
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])


def slot_ranks(texts: DataFrame) -> np.ndarray:
    """Rank of each slot by the n-grams of all ``texts`` (one column) that fall into it: fixed size."""
    form = "part int, counts binary"
    sums = texts.mapInArrow(_slot_counts, form).repartition("part").mapInArrow(_slot_sums, form)
    total = np.zeros((SLOT_ROWS, SLOTS // SLOT_ROWS), np.int64)
    for r in sums.collect():
        total[r["part"]] = np.frombuffer(r["counts"], np.int64)
    ranks = np.empty(SLOTS, np.int32)
    ranks[np.argsort(total.ravel(), kind="stable")] = np.arange(SLOTS, dtype=np.int32)
    return ranks


def _sets(ranks):
    """doc_id, text, size of the set, how many of its n-grams may be left out, 128 bits that are equal for equal sets, parity
    bits, and the first n-grams."""

    def work(batches):
        rank = ranks.value
        for b in batches:
            for x, z, bounds, data in chunks(b.column(1)):
                size, same, bits, keys = [], [], [], []
                for v in shingle_sets(bounds, data):
                    size.append(len(v))
                    same.append([int(mix(v ^ ODD[48 + i]).sum(dtype=np.uint64)) for i in (0, 1)])
                    bits.append(np.packbits(np.bincount((v & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes())
                    keys.append(v[np.argsort(rank[slot(v)], kind="stable")[: prefix(len(v))]])
                same = to_signed(np.array(same, np.uint64).reshape(-1, 2).T.copy())
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(to_signed(np.concatenate(keys))))
                columns = [b.column(0).slice(x, z - x), b.column(1).slice(x, z - x), pa.array(size, pa.int64()), pa.array([spare(least(n)) for n in size], pa.int32()), pa.array(same[0]), pa.array(same[1]), pa.array(bits, pa.binary()), lists]
                yield pa.record_batch(columns, names=["doc_id", "text", "size", "spare", "a", "b", "bits", "keys"])

    return work


# --- groups ---------------------------------------------------------------------------------------------------------


def whole_groups(batches, most: int) -> Iterator[pa.Table]:
    """Runs of rows, sorted by their first column, that hold whole groups and about ``most`` bytes."""
    held, size, limit = [], 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < limit:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t.column(0).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield t.slice(0, cut)
        held = [pa.record_batch(c, schema=b.schema) for c in [[x.combine_chunks().take(pa.array(range(cut, len(k)))) for x in t.columns]]]
        size = held[0].nbytes
        limit = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _possible(batches):
    """Rows sorted by key (key, node, size, bits): members with a partner in their group that sizes and parity bits allow."""
    for t in whole_groups(batches, RUN_BYTES):
        key, size = t.column(0).to_numpy(), t.column(2).to_numpy()
        bits = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint64).reshape(len(key), -1)
        found = np.zeros(len(key), bool)
        i, d = np.arange(len(key) - 1), 1
        while len(i):
            i = i[key[i] == key[i + d]]
            both = size[i] + size[i + d]
            most = both - 2 * need(both)  # of the symmetric difference
            ok = i[(np.bitwise_count(bits[i] ^ bits[i + d]).sum(1, dtype=np.int64) <= most) & (abs(size[i] - size[i + d]) <= most)]
            found[ok] = found[ok + d] = True
            d += 1
            i = i[i + d < len(key)]
        kept = t.filter(pa.array(found))
        yield from kept.select(["key", "node", "size"]).to_batches()


# --- the trie -------------------------------------------------------------------------------------------------------


class Trie:
    """A compressed prefix tree over the ordered sets of several groups; a set's first element is its group.

    ``sets`` are hashes, ``group`` numbers from 0 in rising order, ``rank`` the slots' ranks.  Sets are renumbered in
    lexicographic order; ``order`` has the given place of each.
    """

    def __init__(self, sets: list[np.ndarray], group: np.ndarray, rank: np.ndarray) -> None:
        names, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        place, groups = np.empty(len(names), np.int64), int(group[-1]) + 1
        place[np.lexsort((names, rank[slot(names)]))] = np.arange(groups, groups + len(names))
        count = np.array([len(s) for s in sets])
        ends = np.cumsum(count)
        rows = [np.concatenate([[g], np.sort(place[inverse[e - n : e]])]) for g, n, e in zip(group.tolist(), count.tolist(), ends.tolist(), strict=True)]
        text = [r.astype(">u4").tobytes() for r in rows]
        self.order = np.array(sorted(range(len(rows)), key=text.__getitem__))
        rows = [rows[i] for i in self.order]
        self.group, self.size = group[self.order], count[self.order]
        self.off = np.concatenate([[0], np.cumsum(self.size + 1)])
        self.items = np.concatenate(rows)
        self.flat = np.repeat(np.arange(len(rows)), self.size + 1) << 32 | self.items
        self._build(rows)

    def _build(self, rows: list[np.ndarray]) -> None:
        depth, low, high, parent, stack = [0], [0], [len(rows)], [-1], [0]

        def add(d: int, first: int, up: int) -> int:
            depth.append(d)
            low.append(first)
            high.append(0)
            parent.append(up)
            return len(depth) - 1

        for t in range(len(rows) + 1):
            shared = 0
            if 0 < t < len(rows):
                a, b = rows[t - 1], rows[t]
                m = min(len(a), len(b))
                differ = a[:m] != b[:m]
                shared = int(differ.argmax()) if differ.any() else m
            while depth[stack[-1]] > shared:
                last = stack.pop()
                high[last] = t
                if depth[stack[-1]] < shared:
                    parent[last] = new = add(shared, low[last], stack[-1])
                    stack.append(new)
                else:
                    parent[last] = stack[-1]
            if t < len(rows):
                stack.append(add(len(rows[t]) + 1, t, stack[-1]))  # a leaf is one deeper than its set, so that none lies inside another
        self.low, self.high, up = np.array(low), np.array(high), np.array(parent)
        depth = np.array(depth)
        self.leaf = depth == self.size[np.minimum(self.low, len(rows) - 1)] + 2
        self.start, self.end = depth[up], depth - self.leaf
        self.start[0] = 0
        spans = np.ravel([self.low, self.high], "F")
        self.least = np.minimum.reduceat(np.append(self.size, 0), spans)[::2]
        self.most = np.maximum.reduceat(np.append(self.size, 0), spans)[::2]
        self.children = np.argsort(up, kind="stable")[1:]
        self.child_at = np.searchsorted(up[self.children], np.arange(len(up) + 1), "left")
        self.top = self.children[self.child_at[0] : self.child_at[1]]  # one for each group, in their order
        self.weight = np.bincount(self.group[self.low], weights=self.end - self.start, minlength=len(self.top))

    def near(self, probes: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) for all sets that are open and linked with a probe of their group."""
        ps, ts = [], []
        load = np.cumsum(self.weight[self.group[probes]]) // LEVEL
        for some in np.split(probes, np.flatnonzero(np.diff(load)) + 1):
            for p, t in self._walk(some, np.concatenate([[0], np.cumsum(open_)])):
                hit = open_[t] & (p != t)
                ps.append(p[hit])
                ts.append(t[hit])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *ps]), np.concatenate([none, *ts])

    def _walk(self, p: np.ndarray, opened: np.ndarray):
        node, overlap = self.top[self.group[p]], np.full(len(p), -1)  # the group is in both
        while len(p):
            on = opened[self.high[node]] > opened[self.low[node]]
            p, node, overlap = p[on], node[on], overlap[on]
            n = self.end[node] - self.start[node]
            upto = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(self.off[self.low[node]] + self.start[node] - upto[:-1], n) + np.arange(upto[-1])
            asked = np.repeat(p << 32, n) | self.items[at]
            place = np.minimum(np.searchsorted(self.flat, asked), len(self.flat) - 1)
            hits = np.concatenate([[0], np.cumsum(self.flat[place] == asked)])
            overlap = overlap + hits[upto[1:]] - hits[upto[:-1]]
            last = self.items[self.off[self.low[node]] + self.end[node] - 1]
            mine = self.off[p + 1] - np.searchsorted(self.flat, p << 32 | last, "right")
            theirs = self.most[node] - (self.end[node] - 1)
            on = overlap + np.minimum(mine, theirs) >= need(self.size[p] + self.least[node])
            leaf = on & self.leaf[node]
            yield p[leaf], self.low[node[leaf]]
            on &= ~leaf
            p, node, overlap = p[on], node[on], overlap[on]
            n = self.child_at[node + 1] - self.child_at[node]
            upto = np.concatenate([[0], np.cumsum(n)])
            node = self.children[np.repeat(self.child_at[node] - upto[:-1], n) + np.arange(upto[-1])]
            p, overlap = np.repeat(p, n), np.repeat(overlap, n)

    def links(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets that connect what hangs together within each group and holds a seed; both by their given place.

        Seeds and what they reach are probed against all that nothing has reached, until no seed is left.
        """
        seed = seed[self.order]
        open_, label = np.ones(len(seed), bool), np.arange(len(seed))
        front, most = np.zeros(0, np.int64), 1
        us, vs = [], []
        while True:
            ready = np.flatnonzero(open_ & seed)
            of = self.group[ready]
            fresh = ready[np.arange(len(ready)) - np.searchsorted(of, of, "left") < most]
            if not len(fresh) and not len(front):
                break
            p, t = self.near(np.concatenate([front, fresh]), open_)
            pair = np.unique(label[p] << 32 | t)
            first, t = pair >> 32, pair & 0xFFFFFFFF
            us.append(t)
            vs.append(first)
            open_[fresh] = False
            new = np.flatnonzero(np.bincount(t[open_[t]], minlength=len(seed)))
            front = new
            label[t[::-1]] = np.where(open_[t[::-1]], first[::-1], label[t[::-1]])
            open_[new] = False
            most = min(2 * most, SEEDS)
        none = np.zeros(0, np.int64)
        return self.order[np.concatenate([none, *us])], self.order[np.concatenate([none, *vs])]


def _joined(ranks):
    """Rows sorted by unit (unit, node, seed, bytes, z): links within each unit."""

    def work(batches):
        rank, codec = ranks.value, pa.Codec("zstd")
        for t in whole_groups(batches, RUN_BYTES):
            node = t.column(1).to_numpy()
            texts = [codec.decompress(z, n, asbytes=True) for n, z in zip(t.column(3).to_pylist(), t.column(4).to_pylist(), strict=True)]
            sets = [s for _, _, bounds, data in chunks(pa.array(texts, pa.binary())) for s in shingle_sets(bounds, data)]
            u, v = Trie(sets, np.unique(t.column(0).to_numpy(), return_inverse=True)[1], rank).links(t.column(2).to_numpy(zero_copy_only=False))
            yield pa.record_batch([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

    return work


def _compress(batches):
    codec = pa.Codec("zstd", 3)
    for b in batches:
        raw = [t.encode() for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["node", "bytes", "z"])


def _deal(node, parts, salt: int = 0):
    return F.pmod(F.xxhash64(node, F.lit(salt)), parts).cast("int")


class Join:
    """The join over a written table of sets (place, text, size, spare, a, b, bits, keys), one node for equal sets."""

    def __init__(self, sets: DataFrame, nodes: DataFrame, ranks, cap: int) -> None:
        self.spark, self.nodes, self.ranks, self.cap = sets.sparkSession, nodes, ranks, cap
        self.texts = sets.where("size > 0").select("place", "text").mapInArrow(_compress, "node long, bytes long, z binary")

    def members(self) -> DataFrame:
        """(key, node, size) of the members of all groups that may hold a link."""
        tables = self.nodes.select(F.explode("keys").alias("key"), "node")
        groups = tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared = tables.join(groups.hint("merge"), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("met"))
        rare = F.slice("met", F.lit(1), F.greatest(F.size("met") - F.col("spare"), F.lit(0)))  # n-grams of one set come before all
        met = shared.join(self.nodes.select("node", "size", "spare", "bits").hint("merge"), "node").select("node", "size", "bits", F.explode(rare).alias("k")).select("k.key", "k.n", "node", "size", "bits")
        met, path = materialise(met, "met")
        few = met.where(F.col("n") <= SMALL).select("key", "node", "size", "bits").repartition("key").sortWithinPartitions("key").mapInArrow(_possible, "key long, node long, size long")
        kept, _ = materialise(few.unionByName(met.where(F.col("n") > SMALL).select("key", "node", "size")), "members")
        remove(self.spark, path)
        return kept

    def within(self, units: DataFrame) -> DataFrame:
        """Links inside units (unit, node, seed), as a table."""
        rows = self.texts.join(units.hint("merge"), "node").select("unit", "node", "seed", "bytes", "z")
        return materialise(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_joined(self.ranks), "u long, v long").distinct(), "links")[0]

    def links(self) -> DataFrame:
        kept = self.members()
        groups = kept.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all"), F.sum("size").alias("weight"))
        once = groups.where("n > 1").groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key"), F.min("weight").alias("weight"))
        chosen, _ = materialise(once.select("key", F.ceil(F.col("weight") / self.cap).cast("int").alias("parts")), "groups")
        members, _ = materialise(kept.join(chosen.hint("merge"), "key").select("key", "node", "size", "parts"), "chosen")
        seed = F.lit(True).alias("seed")
        units = members.where("parts = 1").select(F.col("key").alias("unit"), "node", seed)
        crowded = members.where("parts > 1")
        if crowded.isEmpty():
            return self.within(units)
        return self.crowded(crowded, units)

    def crowded(self, crowded: DataFrame, units: DataFrame) -> DataFrame:
        """Groups beyond ``cap``: parts with some common members first, then those outside the main component with all parts."""
        seed, own = F.lit(True).alias("seed"), _deal(F.col("node"), F.col("parts"))
        common = crowded.groupBy("key", _deal(F.col("node"), F.lit(STARS), 1).alias("s")).agg(F.min("node").alias("node"), F.max("parts").alias("parts"))
        common = common.select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("part <> own")
        parts = crowded.select("key", own.alias("part"), "node").unionByName(common.select("key", "part", "node"))
        first = self.within(units.unionByName(parts.select(F.xxhash64("key", "part").alias("unit"), "node", seed)))
        roots, _ = materialise(components(first), "roots")
        named, _ = materialise(crowded.join(roots.hint("merge"), "node", "left").select("key", "node", "size", "parts", F.coalesce("root", "node").alias("root")), "named")
        main = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main")).select("key", F.col("main.root").alias("root"))
        rest, _ = materialise(named.join(main.hint("merge"), ["key", "root"], "left_anti"), "rest")
        shares = rest.groupBy("key").agg(F.ceil(F.sum("size") / self.cap).cast("int").alias("shares"))
        theirs = rest.join(shares, "key").select("key", _deal(F.col("node"), F.col("shares"), 2).alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", seed)
        every = crowded.join(shares, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), own.alias("part"), "node", F.lit(False).alias("seed"))
        second = self.within(theirs.unionByName(every).select(F.xxhash64("key", "share", "part").alias("unit"), "node", "seed"))
        return first.unionByName(second)


def join(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = spark.sparkContext.broadcast(slot_ranks(rows.select("text")))
    sets = rows.mapInArrow(_sets(ranks), "doc_id long, text string, size long, spare int, a long, b long, bits binary, keys array<long>")
    sets, _ = materialise(sets.select("*", F.monotonically_increasing_id().alias("place")), "sets")
    ids, _ = materialise(sets.where("size > 0").groupBy("a", "b").agg(F.min("place").alias("node"), F.min("doc_id").alias("first")), "nodes")
    nodes, _ = materialise(sets.select(F.col("place").alias("node"), "size", "spare", "bits", "keys").join(ids.select("node").hint("merge"), "node", "left_semi"), "keys")
    roots, _ = materialise(components(Join(sets, nodes, ranks, cap).links()), "roots")
    named = ids.join(roots.hint("merge"), "node", "left").select("a", "b", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names, _ = materialise(named.join(least.hint("merge"), "root").select("a", "b", "component_id"), "names")
    linked = sets.where("size > 0").select("doc_id", "size", "a", "b").join(names.hint("merge"), ["a", "b"])
    alone = sets.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone.withColumnRenamed("size", "n_shingles"))
