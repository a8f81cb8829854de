"""Best-fit packing of token pieces into sequences.

A configuration linear program over the histogram of piece lengths (at most ``seq_len`` classes, whatever the size of
the corpus) is solved by multiplicative weights: each step prices lengths, a knapsack dynamic program finds the best
configuration for those prices, and covered lengths get cheaper.  The prices of every step bound the least number of
sequences, so the plan's distance from the optimum is known, and the steps end when it is small.  The fractional
solution is rounded to whole copies of its configurations; pieces that are left go best-fit, longest first, into the
rooms of those and into new sequences.  Best fit alone is taken only where it needs fewer sequences.  The driver only
ever holds the histogram and the patterns.
Every piece then finds its place from its rank within its length class, which Spark computes in hash buckets so that a
length that holds a third of all pieces is still spread over many tasks.

Results for unusual input: a null or empty text is the single end token; repeated rows and repeated ids are packed as
separate documents; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, prepare

SEQ_LEN = 2048
#: Most pricing steps, steps between two roundings, the share of a length covered by a step, how fast prices fall, and
#: the distance from the bound (a share) that ends the steps.
STEPS, ROUND, LEAST_STEP, RATE, GAP = 360, 40, 0.03, 4.0, 0.0005
#: Rows of one length class that are ranked together.
GROUP = 20_000
#: A length class is ranked in at least so many groups, so that a frequent length is spread even on small tables.
LEAST_BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``n`` tokens: only the first may be shorter."""
    if n <= seq_len:
        return [(0, n)]
    first = n % seq_len or seq_len
    return [(0, first), *((a, seq_len) for a in range(first, n, seq_len))]


def tokenise(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """One row per piece, with the CRC of its ids.  The ids themselves stay in the task."""

    def work(batches):
        encode = tokens.encoder(tokenizer)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4")
                for k, (a, n) in enumerate(cut_points(len(ids), seq_len)):
                    for x, v in zip(out, (doc, k, a, n, zlib.crc32(raw[a : a + n])), strict=True):
                        x.append(v)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, PIECES)


def best_configuration(lengths: np.ndarray, prices: np.ndarray, seq_len: int) -> np.ndarray:
    """Knapsack dynamic program over capacities: how often each length is in the configuration of highest price."""
    best = np.zeros(seq_len + 1)
    took = np.full(seq_len + 1, -1)
    for c in range(1, seq_len + 1):
        best[c], took[c] = best[c - 1], -1
        m = int(np.searchsorted(lengths, c, "right"))
        if m:
            v = best[c - lengths[:m]] + prices[:m]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], took[c] = v[j], j
    counts = np.zeros(len(lengths), dtype=np.int64)
    c = seq_len
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(lengths[took[c]])
    return counts


def configurations(hist: dict[int, int], seq_len: int) -> tuple[list[tuple[list[tuple[int, int]], int]], int, list[tuple[list[tuple[int, int]], int]]]:
    """The configuration linear program: (best whole plan, least number of sequences that it proves, plan of best fit alone).

    Multiplicative weights: a length's price falls by ``exp(-RATE * share of its pieces covered)``.  Any prices bound the
    number of sequences from below (value of all pieces over the value of the best configuration).  Every ``ROUND`` steps
    the fractional plan is rounded and completed; the loop ends when the plan is within ``GAP`` of the bound.
    """
    plain = best_fit(hist, seq_len)
    lengths = np.array(sorted(x for x in hist if x < seq_len), dtype=np.int64)
    whole = hist.get(seq_len, 0)
    if not len(lengths):
        return plain, whole, plain
    demand = np.array([hist[int(x)] for x in lengths], dtype=np.float64)
    # the first prices are lengths: their bound is the number of tokens over ``seq_len``
    price = lengths.astype(np.float64)
    step_share = min(1.0, max(LEAST_STEP, len(lengths) / (4 * STEPS)))
    covered = np.zeros(len(lengths))
    found: dict[bytes, float] = {}
    best, bound = None, whole + -(-int(demand @ lengths) // seq_len)
    for step in range(1, STEPS + 1):
        a = best_configuration(lengths, price, seq_len)
        used = a > 0
        bound = max(bound, whole + math.ceil(float(demand @ price) / float(a @ price) - 1e-6))
        n = step_share * float((demand[used] / a[used]).min())
        found[a.tobytes()] = found.get(a.tobytes(), 0.0) + n
        covered += n * a / demand
        price = lengths * np.exp(-RATE * (covered - covered.min()))
        if step % ROUND == 0 or step == STEPS:
            scale = 1 / max(1.0, float(covered.min()))
            plan = rounded(hist, lengths, {k: x * scale for k, x in found.items()}, seq_len)
            if best is None or total(plan) < total(best):
                best = plan
            if total(best) <= bound * (1 + GAP):
                break
    return best, bound, plain


def rounded(hist: dict[int, int], lengths: np.ndarray, found: dict[bytes, float], seq_len: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole copies of each configuration, the most used first, rounded up while pieces are left; best fit fills the rooms."""
    left = np.array([hist[int(x)] for x in lengths])
    chosen = [([(seq_len, 1)], hist[seq_len])] if hist.get(seq_len) else []
    for trim in (math.floor, math.ceil):
        for key, x in sorted(found.items(), key=lambda kv: (-kv[1], kv[0])):
            a = np.frombuffer(key, dtype=np.int64)
            used = a > 0
            n = int(min(trim(x), (left[used] // a[used]).min()))
            if trim is math.ceil:
                n = min(n, 1)
            if n > 0:
                left[used] -= n * a[used]
                chosen.append(([(int(lengths[i]), int(a[i])) for i in np.flatnonzero(used)[::-1]], n))
    return best_fit({int(x): int(k) for x, k in zip(lengths, left, strict=True) if k > 0}, seq_len, chosen)


def total(patterns: list[tuple[list[tuple[int, int]], int]]) -> int:
    return sum(copies for _, copies in patterns)


def best_fit(hist: dict[int, int], seq_len: int, begun: list[tuple[list[tuple[int, int]], int]] = ()) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, over counts, into the rooms of ``begun`` and new sequences.

    Equal sequences are one entry, so cost follows lengths, not pieces.
    """
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def push(room: int, pattern: list[tuple[int, int]], copies: int) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((pattern, copies))

    def fill(room: int, pattern: list[tuple[int, int]], copies: int, n: int, length: int) -> int:
        """Put pieces of one length into ``copies`` equal sequences; how many of ``n`` are left."""
        q = room // length
        full = min(copies, n // q)
        if full:
            push(room - q * length, [*pattern, (length, q)], full)
            n -= full * q
            copies -= full
        if copies and n:
            k = min(n, q)
            push(room - k * length, [*pattern, (length, k)], 1)
            n -= k
            copies -= 1
        if copies:
            push(room, pattern, copies)
        return n

    for pattern, copies in begun:
        push(seq_len - sum(a * b for a, b in pattern), pattern, copies)
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n > 0:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                break
            room = rooms[i]
            groups = open_.pop(room)
            rooms.pop(i)
            while groups and n > 0:
                n = fill(room, *groups.pop(), n, length)
            for g in groups:
                push(room, *g)
        if n > 0:
            fill(seq_len, [], -(-n // (seq_len // length)), n, length)
    return [g for r in rooms for g in open_[r]]


def plan(hist: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[list[tuple[int, int]], int]]:
    """All sequences as (pattern, copies): the rounded linear program, or best fit alone where that takes fewer."""
    best, _, plain = configurations({k: v for k, v in hist.items() if v > 0}, seq_len)
    return plain if total(plain) < total(best) else best


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, count in a sequence, first offset), by length and rank."""
    rows, taken, base = [], {}, 0
    for pattern, copies in patterns:
        at = 0
        for length, k in pattern:
            lo = taken.get(length, 0)
            rows.append((length, lo, base, k, at))
            taken[length] = lo + k * copies
            at += k * length
        base += copies
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, seq_len: int = SEQ_LEN, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces, ranked in groups of about ``group`` rows.

    Groups go by ``row``, an identity of each piece, so that equal pieces are dealt to all of them.
    """
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most seq_len rows
    buckets = max(LEAST_BUCKETS, 1 + max(hist.values(), default=0) // group)
    table = slots(plan(hist, seq_len))
    shared = spark.sparkContext.broadcast(table)  # bounded by the patterns over seq_len lengths
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = (
        keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("nth", F.row_number().over(within)).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)

    def work(batches):
        t = shared.value
        wide = np.int64(1) << np.int64(50)
        keys = t[:, 0] * wide + t[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            s = t[np.searchsorted(keys, length * wide + rank, "right") - 1]
            r = rank - s[:, 1]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(k)) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(s[:, 2] + r // s[:, 3]), pa.array(s[:, 4] + r % s[:, 3] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(work, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its sequence and place.  Texts are tokenised once."""
    prepare(docs.sparkSession)
    pieces, _ = materialise(tokenise(docs, seq_len, tokenizer, end_id).select("*", F.monotonically_increasing_id().alias("row")), "pieces")
    return place(pieces, seq_len)
