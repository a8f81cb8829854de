"""Removal of repeated byte strings by bucket-pointer refinement over a sparse suffix array.

Initial buckets: suffixes are put in buckets by the identifier of their first 32 bytes, built by doubling from the
identifiers at later offsets.  Only anchors are kept: in each window of 100 bytes the suffix of smallest identifier.
Equal windows choose equal anchors at equal places, so two equal windows always meet in a bucket, and buckets of one
suffix are final at once.

Refinement: a bucket is sorted on the identifier of everything a window through its anchor can touch (68 bytes before, 100
from it).  Anchors that agree there with an earlier one are repeats in full.  What is left, one anchor for each distinct
surrounding, is refined by halves: the windows of a bucket, those that start 68 to 0 bytes before the anchor, are split into
the earlier and the later half, and each half's bucket identifier is that of its bucket with the identifiers of the bytes
that all windows of the half hold besides (34 bytes at an earlier or later offset, then 17 more, and so on).  In each new
bucket, anchors that agree in all bytes of the half are repeats for that half, the first of them goes on, and a bucket of
one is final.  After seven splits a bucket is one window.  Identifiers are names of contents by 64-bit hash instead of
places in a sorted array, so that a split needs no global sort.

Scale: every split deals a bucket anew by its contents, so a passage that a third of all rows hold is spread after one or
two splits, each of which is a map, a partial minimum and a join.  A task refines buckets of up to ``BLOCK`` anchors to the
end on its own, with the same halves, as they need no more splitting to fit.  Copies inside a task are combined before the
first shuffle, and sorted buckets are streamed with state of a few rows.  Texts cross the network twice, compressed.

Results for unusual input: null is empty; texts under 100 bytes stay whole; a null doc_id is earlier than all others;
rows that repeat doc_id and text are one document and each gets its result, rows that repeat only doc_id are told
apart and ordered by a 64-bit hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_TABLE, ODD, U, chunks, materialise, mix, prepare, remove, sliding, span_hash, to_signed

LENGTH = 100
GRAM = 32
#: Anchors of one bucket that a task refines on its own.
BLOCK = 1024
NULL_ID = -(1 << 63)
LEFT = LENGTH - GRAM  # bytes before an anchor that its windows can touch


def name_level(h: np.ndarray, step: int, k: int) -> np.ndarray:
    """Identifiers of strings twice as long (or overlapping) from those at offsets 0 and ``step``, on the last axis."""
    x = h[..., :-step] * ODD[2 * k] + h[..., step:] * ODD[2 * k + 1]
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def name_grams(data: np.ndarray) -> np.ndarray:
    """Identifiers of all strings of GRAM bytes."""
    h, size, k = BYTE_TABLE[data], 1, 0
    while size < GRAM:
        if h.shape[-1] <= size:
            return h[..., :0]
        h = name_level(h, size, k)
        size, k = 2 * size, k + 1
    return h


def name_windows(contexts: np.ndarray) -> np.ndarray:
    """Identifiers of the strings of LENGTH bytes in rows of contexts, made from those of 32 and 64."""
    h = name_level(name_grams(contexts), 32, 8)
    return name_level(h, LENGTH - 64, 9)


def anchors(bounds: np.ndarray, data: np.ndarray):
    """text, place, bytes before, bytes after, bucket and surrounding identifier of every anchor of a run of texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    h = name_grams(data)
    low = sliding(h, LEFT + 1, np.minimum).copy()
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low[np.arange(len(low)) + LENGTH > bounds[text[: len(low)] + 1]] = 0
    pad = np.zeros(LEFT, np.uint64)
    at = np.flatnonzero((sliding(np.concatenate([pad, low, pad]), LEFT + 1, np.maximum) == h) & (h > 0))
    text = text[at]
    before = np.minimum(LEFT, at - bounds[text])
    after = np.minimum(LENGTH, bounds[text + 1] - at)
    # where the surrounding is cut by the text's ends, its place around the anchor is part of what must agree
    around = span_hash(data, at - before, at + after) + (before * 256 + after).astype(np.uint64) * ODD[51]
    return text, at - bounds[text], before, after, h[at], around


ROW = "h long, around long, doc long, sub long, a int, b int"
_NAMES = ["h", "around", "doc", "sub", "a", "b"]


def _rows(h, around, doc, sub, a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(to_signed(h)), pa.array(to_signed(around)), pa.array(doc), pa.array(sub.astype(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=_NAMES)


def _combine(parts):
    """Of anchors that agree in bucket and surrounding, the first stays; the rest become merged spans (b < 0: -end)."""
    h, around, doc, sub, at, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.lexsort((at, sub, doc, around, h))
    h, around, doc, sub, at, before, after = (x[o] for x in (h, around, doc, sub, at, before, after))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (around[1:] == around[:-1])
    f = ~same
    yield _rows(h[f], around[f], doc[f], sub[f], at[f], before[f] * 256 + after[f])
    # a repeated row meets itself: only what has an earlier, different place is a repeat
    lead = np.maximum.accumulate(np.where(f, np.arange(len(h)), 0))
    same &= (doc != doc[lead]) | (sub != sub[lead]) | (at != at[lead])
    o = np.flatnonzero(same)
    o = o[np.lexsort((at[o], sub[o], doc[o]))]  # by place: both ends of the spans of a text then rise
    doc, sub, a, b = doc[o], sub[o], (at - before)[o], (at + after)[o]
    if len(a):
        new = np.ones(len(a), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (a[1:] > b[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(a)) - 1
        yield _rows(span_key(doc[i]), np.zeros(len(i), np.uint64), doc[i], sub[i], a[i], -b[j])


def span_key(doc: np.ndarray) -> np.ndarray:
    return doc.astype(np.int64).view(np.uint64) * ODD[50]


def _anchor_rows(limit: int = 300_000):
    def work(batches):
        parts, n = [], 0
        for b in batches:
            ids, subs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, _, bounds, data in chunks(b.column(2)):
                text, at, before, after, h, around = anchors(bounds, data)
                if len(at):
                    parts.append((h, around, ids[a + text], subs[a + text], at, before, after))
                    n += len(at)
            if n >= limit:
                yield from _combine(parts)
                parts, n = [], 0
        if parts:
            yield from _combine(parts)

    return work


def _arrays(b: pa.RecordBatch):
    h, around, doc, sub, a, c = (b.column(i).to_numpy() for i in range(6))
    return h, around, doc, sub.astype(np.int64), a.astype(np.int64), c.astype(np.int64)


def _first_refinement(batches):
    """Stream buckets sorted by (h, around, doc, sub, a): repeats in full become spans, the rest edges.

    Out: h, doc, sub, a, b with b < 0 for spans (a start, -b end) and b >= 0 for edges of buckets with several
    surroundings.  State: the last row, the first of its class, and the last class not yet known to share its bucket.
    """
    last = None  # (h, around, doc, sub, at) of the first of the running class
    wait = None  # that row, if nothing in its bucket has differed so far
    for batch in batches:
        h, around, doc, sub, a, b = _arrays(batch)
        span = b < 0
        if span.any():
            yield _edges(h[span], doc[span], sub[span], a[span], b[span])
            h, around, doc, sub, a, b = (x[~span] for x in (h, around, doc, sub, a, b))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
        if last is not None:
            new[0] = h[0] != last[0] or around[0] != last[1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        if last is None:
            moved = (doc != doc[lead]) | (sub != sub[lead]) | (a != a[lead])
        else:
            own = lead >= 0
            moved = np.where(own, doc[lead], last[2]) != doc
            moved |= np.where(own, sub[lead], last[3]) != sub
            moved |= np.where(own, a[lead], last[4]) != a
        full = ~new & moved
        if full.any():
            yield _edges(h[full], doc[full], sub[full], (a - (b >> 8))[full], -(a + (b & 255))[full])
        # rows that are first of their class, with the last one that still waits
        i = np.flatnonzero(new)
        if len(i):
            last = (h[i[-1]], around[i[-1]], doc[i[-1]], sub[i[-1]], a[i[-1]])
            rows = [x[i] for x in (h, doc, sub, a, b)]
            shared_before = np.zeros(len(i), bool)
            shared_before[1:] = rows[0][1:] == rows[0][:-1]
            if wait is not None:
                if wait[0][0] == rows[0][0]:
                    shared_before[0] = True
                    if not wait[1]:
                        yield _edges(*(np.array([x]) for x in wait[0]))
            shared = shared_before.copy()
            shared[:-1] |= shared_before[1:]
            if shared.any():
                yield _edges(*(x[shared] for x in rows))
            wait = (tuple(x[-1] for x in rows), bool(shared[-1]))


def _edges(h, doc, sub, a, b) -> pa.RecordBatch:
    return pa.record_batch([pa.array(h), pa.array(doc), pa.array(sub.astype(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["h", "doc", "sub", "a", "b"])


def _compress(batches):
    codec = pa.Codec("zstd", 3)
    for b in batches:
        z = [codec.compress(x.as_py() or b"", asbytes=True) for x in b.column(2)]
        n = [len(x.as_py() or b"") for x in b.column(2)]
        more = b.schema.names[3:]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(z, pa.binary()), *(b.column(3 + i) for i in range(len(more)))], names=["doc", "sub", "n", "z", *more])


def _inflate(n: int, z: bytes) -> bytes:
    return pa.Codec("zstd").decompress(z, n, asbytes=True)


def _contexts(batches):
    """The bytes around each edge, padded to LEFT before the anchor and LENGTH from it."""
    for b in batches:
        ids, subs, sizes, zs, hs, places = (b.column(i) for i in range(6))
        for i in range(b.num_rows):
            h, at = hs[i].values.to_numpy(), places[i].values.to_numpy().astype(np.int64)
            size = sizes[i].as_py()
            data = np.zeros(size + LEFT + LENGTH, np.uint8)
            data[LEFT : LEFT + size] = np.frombuffer(_inflate(size, zs[i].as_py()), np.uint8)
            for k in range(0, len(at), 4096):
                p = at[k : k + 4096]
                rows = np.lib.stride_tricks.sliding_window_view(data, LEFT + LENGTH)[p]
                m = len(p)
                around = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((np.arange(m + 1) * (LEFT + LENGTH)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])
                reach = np.minimum(LEFT, p) * 256 + np.minimum(LENGTH, size - p)
                yield pa.record_batch([pa.array(h[k : k + 4096]), pa.array(np.full(m, ids[i].as_py())), pa.array(np.full(m, subs[i].as_py(), np.int64)), pa.array(p.astype(np.int32)), pa.array(reach.astype(np.int32)), around], names=["h", "doc", "sub", "a", "b", "bytes"])


CONTEXT = "h long, doc long, sub long, a int, b int, bytes binary"
NODE = CONTEXT + ", lo int, hi int"
_NODE_NAMES = ["h", "doc", "sub", "a", "b", "bytes", "lo", "hi"]


def _context_arrays(batch: pa.RecordBatch):
    """h, doc, sub, a, b, lo, hi and the bytes around, a row each; lo and hi are the windows asked for that lie in the text."""
    h, doc, sub, a, b, lo, hi = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 2, 3, 4, 6, 7))
    raw = batch.column(5)
    flat = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) else np.zeros(0, np.uint8)
    start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] if len(raw) else 0
    wide = LEFT + LENGTH
    lo, hi = np.maximum(lo, LEFT - (b >> 8)), np.minimum(hi, (b & 255) - GRAM)  # window i starts LEFT - i before the anchor
    return h, doc, sub, a, b, lo, hi, flat[start : start + len(raw) * wide].reshape(-1, wide)


def _repeats(rows) -> pa.RecordBatch | None:
    """Spans of the windows that are not the first of their class; rows in order of bucket and place."""
    h, doc, sub, a, b, lo, hi, around = rows
    names = name_windows(around)
    k = len(h)
    place = np.zeros(k, np.int64)
    place[1:] = np.cumsum((doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (a[1:] != a[:-1]) | (h[1:] != h[:-1]))
    first_, last_ = np.full(k, LEFT + 1), np.full(k, -1)
    names += mix(h.view(np.uint64))[:, None]  # buckets may share bytes and differ in windows
    for i in range(LEFT + 1):
        r = np.flatnonzero((lo <= i) & (i <= hi))
        if len(r) < 2:
            continue
        o = r[np.argsort(names[r, i], kind="stable")]
        s = names[o, i]
        new = np.ones(len(o), bool)
        new[1:] = s[1:] != s[:-1]
        first = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        again = o[place[o] != place[first]]
        first_[again] = np.minimum(first_[again], i)
        last_[again] = np.maximum(last_[again], i)
    f = last_ >= 0
    # windows of one anchor always overlap, so their union is one span
    return _edges(h[f], doc[f], sub[f], (a - LEFT + first_)[f], -(a - LEFT + last_ + LENGTH)[f]) if f.any() else None


def _whole_buckets(batches):
    """Nodes sorted by (h, doc, sub, a): refine whole buckets, several thousand rows at a time."""
    held: list = []
    n = 0

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        if batch.num_rows:
            held.append(_context_arrays(batch))
            n += batch.num_rows
        if n >= 4096:
            rows = joined()
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                if (out := _repeats([x[:cut] for x in rows])) is not None:
                    yield out
                held = [[x[cut:] for x in rows]]
                n -= cut
            else:
                held = [rows]
    if n and (out := _repeats(joined())) is not None:
        yield out


def _halves(batches):
    """Each node as two: the windows of either half, in the bucket of the bytes that all windows of that half hold.

    ``around`` names all bytes of the half's windows that lie in the text, and how many these are.
    """
    for batch in batches:
        h, doc, sub, a, b, lo, hi, around = _context_arrays(batch)
        if not len(h):
            continue
        asked_lo, asked_hi = (batch.column(i).to_numpy().astype(np.int64) for i in (6, 7))
        mid = (asked_lo + asked_hi) // 2
        wide = LEFT + LENGTH
        flat = np.ascontiguousarray(around).ravel()
        row = np.arange(len(h)) * wide
        for start, end in ((asked_lo, mid), (mid + 1, asked_hi)):
            l, r = np.maximum(lo, start), np.minimum(hi, end)
            f = np.flatnonzero((start <= end) & (l <= r))
            if not len(f):
                continue
            s, e, l, r = start[f], end[f], l[f], r[f]
            # window i holds the context's bytes i to i + LENGTH
            core = span_hash(flat, row[f] + e, row[f] + s + LENGTH)
            key = mix(h[f].view(np.uint64) * ODD[52] + core + (s * 128 + e).astype(np.uint64) * ODD[53])
            whole = span_hash(flat, row[f] + l, row[f] + r + LENGTH) + (l * 128 + r).astype(np.uint64) * ODD[54]
            take = pa.array(f)
            yield pa.record_batch([pa.array(to_signed(key)), *(batch.column(i).take(take) for i in range(1, 6)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(to_signed(whole)), pa.array(l.astype(np.int32)), pa.array(r.astype(np.int32))], names=[*_NODE_NAMES, "around", "from_", "to_"])


def refine(contexts: DataFrame, block: int = BLOCK) -> tuple[list[DataFrame], list[str]]:
    """Tables of the spans (doc, sub, a, b) that repeat, with b = -end, and the paths of what may go once they are read."""
    nodes, spans, paths = contexts.select("*", F.lit(0).alias("lo"), F.lit(LEFT).alias("hi")), [], []
    while True:
        sizes, path = materialise(nodes.groupBy("h").count().where(F.col("count") > block).select("h"), "large_buckets")
        paths.append(path)
        done = sizes.isEmpty()
        whole = nodes if done else nodes.join(sizes, "h", "left_anti")
        spans.append(whole.select(_NODE_NAMES).repartition("h").sortWithinPartitions("h", "doc", "sub", "a").mapInArrow(_whole_buckets, "h long, doc long, sub long, a int, b int").select("doc", "sub", "a", "b"))
        if done:
            return spans, paths
        halves, path = materialise(nodes.join(sizes, "h", "left_semi").select(_NODE_NAMES).mapInArrow(_halves, NODE + ", around long, from_ int, to_ int"), "halves")
        paths.append(path)
        place = F.struct("doc", "sub", "a")
        first = halves.groupBy("h", "around").agg(F.min(place).alias("first"))
        told, path = materialise(halves.join(first, ["h", "around"]).withColumn("again", place != F.col("first")).drop("first", "around"), "told")
        paths.append(path)
        spans.append(told.where("again").select("doc", "sub", (F.col("a") - LEFT + F.col("from_")).alias("a"), (-(F.col("a") - LEFT + F.col("to_") + LENGTH)).alias("b")))
        nodes = told.where("not again").select(_NODE_NAMES)


def _finish(text: bool):
    def work(batches):
        for b in batches:
            ids, subs, sizes, zs, starts, ends = (b.column(i) for i in range(6))
            more = b.schema.names[6:]
            out: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                n = sizes[i].as_py()
                raw = _inflate(n, zs[i].as_py())
                spans = 0
                if starts[i].is_valid and len(starts[i]):
                    cov = np.zeros(n + 1, np.int64)
                    np.add.at(cov, starts[i].values.to_numpy(), 1)
                    np.add.at(cov, ends[i].values.to_numpy(), -1)
                    gone = np.cumsum(cov)[:n] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for x, v in zip(out, (ids[i].as_py(), subs[i].as_py(), n - len(raw), spans, hashlib.sha256(raw).hexdigest(), raw.decode(errors="ignore") if text else None), strict=True):
                    x.append(v)
            yield pa.record_batch([*(pa.array(x, t) for x, t in zip(out[:2], (pa.int64(), pa.int64()), strict=True)), sizes.cast(pa.int64()), *(pa.array(x, t) for x, t in zip(out[2:], (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)), *(b.column(6 + i) for i in range(len(more)))], names=["doc", "sub", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *more])

    return work


def _ddl(fixed: str, more: list) -> str:
    return ", ".join([fixed, *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)])


def dedup(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, and ``carry``) for every row of ``docs`` (doc_id, text).

    ``kept`` is what stays; a character whose bytes were partly removed is left out of it, but not of the hash.
    ``carry`` names further columns that stay with their rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    again = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    sub = (F.xxhash64(text) if again else F.lit(0).cast("long")).alias("sub")
    src = docs.select(doc, sub, text.alias("text"))
    more = docs.select(*(F.col(c).alias(f"carried_{c}") for c in carry)).schema.fields
    texts = docs.select(doc, sub, text.cast("binary").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry)).mapInArrow(_compress, _ddl("doc long, sub long, n int, z binary", more))

    rows = src.mapInArrow(_anchor_rows(), ROW).repartition("h").sortWithinPartitions("h", "around", "doc", "sub", "a")
    found, found_path = materialise(rows.mapInArrow(_first_refinement, "h long, doc long, sub long, a int, b int"), "buckets")

    asked = found.where("b >= 0").groupBy("doc", "sub").agg(F.collect_list("h").alias("h"), F.collect_list("a").alias("a"))
    once = texts.dropDuplicates(["doc", "sub"]) if again else texts
    contexts, contexts_path = materialise(once.join(asked, ["doc", "sub"]).select("doc", "sub", "n", "z", "h", "a").mapInArrow(_contexts, CONTEXT), "contexts")
    spans, paths = refine(contexts, block)
    each = found.where("b < 0").select("doc", "sub", "a", "b")
    for x in spans:
        each = each.unionByName(x)
    each, _ = materialise(each.groupBy("doc", "sub").agg(F.collect_list("a").alias("starts"), F.collect_list(-F.col("b")).alias("ends")), "spans")
    remove(spark, found_path, contexts_path, *paths)
    joined = texts.join(each, ["doc", "sub"], "left").select("doc", "sub", "n", "z", "starts", "ends", *(f.name for f in more))
    done = joined.mapInArrow(_finish(keep_text), _ddl("doc long, sub long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string", more))
    kept = ["kept"] if keep_text else []
    return done.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *kept, *(F.col(f"carried_{c}").alias(c) for c in carry))
