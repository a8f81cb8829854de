"""Benchmark decontamination by winnowing.

Of the word k-grams in each window of a text only the one of smallest hash (of equals the first) is selected, so neighbouring
windows mostly select the same place: about 2 of w + 1 places, w the k-grams of a window.  Equal windows select equal k-grams
at equal places, so two texts that share a window meet in a selected fingerprint.  Places of documents are joined with the
benchmark's on fingerprints alone, and a hit is extended to the windows around its place: a place carries the hashes of the words
that they can hold.  A window of the document that is one of the benchmark's, by 128 bits of its words, is a shared span.

Document fingerprints that can't be in the benchmark are dropped in the task by a bit table of fixed size (it only
saves rows; a full table would pass all of them).  A window of the benchmark names the set of its items, and a document's
sets are united, so a passage that many documents and many items share still costs each document few rows.

Results for unusual input: null texts and texts without words have no hits; items without words are no items; what
items without id hold is hit, but they are neither counted nor named; rows that repeat an item id count as one item; repeated document rows are judged one by one; an empty benchmark
leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, chunks, gram_hash, materialise, mix, prepare, runs, span_hash, to_signed

WINDOW = 10
GRAM = 5
TABLE_BITS = 23

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a run of texts, and the first word of each text (with the total at the end)."""
    low = _FOLD[data]
    starts, ends = runs(_WORD[low], bounds)
    return span_hash(low, starts, ends), np.searchsorted(starts, bounds, "left")


def selected(h: np.ndarray, first: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that the windows of ``length`` words select, the text of each, and its fingerprint."""
    k = min(gram, length)
    grams = gram_hash(h, k)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: max(0, len(h) - length + 1)]
    at = np.flatnonzero(np.arange(len(text)) + length <= first[text + 1])
    low, place = grams[at], at.copy()
    for j in range(1, length - k + 1):
        other = grams[at + j]
        less = other < low
        low[less], place[less] = other[less], at[less] + j
    place, once = np.unique(place, return_index=True)
    return place, text[at[once]], mix(low[once])


def around(h: np.ndarray, first: np.ndarray, place: np.ndarray, text: np.ndarray, length: int, gram: int = GRAM) -> pa.Array:
    """The hashes of the words from which a window of ``length`` can hold the k-gram at each place; 0 beyond the text."""
    side = length - min(gram, length)
    at = place[:, None] + np.arange(-side, length)
    inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
    near = np.where(inside, h[np.clip(at, 0, max(0, len(h) - 1))] | U(1), U(0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * near.shape[1], pa.int32()), pa.array(to_signed(near.ravel())))


KEY = ["size", "fingerprint", "near"]


def _item_places(batches):
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        for a, _, bounds, data in chunks(texts):
            h, first = words(bounds, data)
            n = np.diff(first)
            for length in np.unique(np.minimum(n[n > 0], WINDOW)).tolist():
                place, text, low = selected(h, first, length)
                keep = (n[text] >= WINDOW) if length == WINDOW else n[text] == length
                place, text, low = place[keep], text[keep], low[keep]
                yield pa.record_batch([ids.take(pa.array(text + a)), pa.array(np.full(len(place), length, np.int32)), pa.array(to_signed(low)), around(h, first, place, text, length)], names=["item_id", *KEY])


def item_places(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(_item_places, "item_id string, size int, fingerprint long, near array<long>").distinct()


def _bit_table(items: DataFrame) -> np.ndarray:
    """Bits of the fingerprints present: at most 2**(TABLE_BITS - 6) words reach the driver, however many items there are."""
    slot = F.shiftrightunsigned("fingerprint", 64 - TABLE_BITS)
    rows = items.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fingerprint, {64 - TABLE_BITS}) & 63 as int))")).alias("bits")).collect()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for r in rows:
        table[r["w"]] = r["bits"]
    return table.view(np.uint64)


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (row, doc_id, n_words) of all documents with start null, and a row for each place whose fingerprint may be an item's."""
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW rows
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(items))

    def work(batches):
        table = shared.value
        none = pa.nulls
        for b in batches:
            rows, ids, texts = b.column(0), b.column(1), b.column(2)
            for a, z, bounds, data in chunks(texts):
                h, first = words(bounds, data)
                m = z - a
                yield pa.record_batch([rows.slice(a, m), ids.slice(a, m), pa.array(np.diff(first)), none(m, pa.int32()), none(m, pa.int32()), none(m, pa.int64()), none(m, pa.list_(pa.int64()))], names=NAMES)
                for length in sizes:
                    place, text, low = selected(h, first, length)
                    bit = low >> U(64 - TABLE_BITS)
                    hit = (table[bit >> U(6)] >> (bit & U(63))) & U(1) > 0
                    place, text, low = place[hit], text[hit], low[hit]
                    n = len(place)
                    if n:
                        yield pa.record_batch([rows.take(pa.array(text + a)), none(n, pa.int64()), none(n, pa.int64()), pa.array((place - first[text]).astype(np.int32)), pa.array(np.full(n, length, np.int32)), pa.array(to_signed(low)), around(h, first, place, text, length)], names=NAMES)

    NAMES = ["row", "doc_id", "n_words", "start", *KEY]
    return docs.mapInArrow(work, "row long, doc_id long, n_words long, start int, size int, fingerprint long, near array<long>")


WINDOW_KEY = ["size", "window_a", "window_b"]


def windows_of(places: DataFrame, *carry: str) -> DataFrame:
    """The windows that hold each place (size, near), with how many words before the place they start."""
    side = F.col("size") - F.least(F.lit(GRAM), "size")
    every = F.transform(F.sequence(F.lit(0), side), lambda i: F.struct((side - i).alias("before"), F.slice("near", i + 1, F.col("size")).alias("words")))
    w = F.col("w.words")
    rows = places.select(*carry, "size", F.explode(F.filter(every, lambda x: ~F.array_contains(x["words"], 0))).alias("w"))
    return rows.select(*carry, "size", F.col("w.before").alias("before"), F.xxhash64(F.lit(1), w).alias("window_a"), F.xxhash64(F.lit(2), w).alias("window_b"))


def item_sets(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct window with the name of the set of items that hold it, and those sets.

    Windows of one passage hold the same items, so there are about as many sets as items, and a document meets a set once
    however many of its windows it holds: rows follow the documents, not documents times items.
    """
    grouped = windows_of(items, "item_id").groupBy(*WINDOW_KEY).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    grouped, _ = materialise(grouped.select(*WINDOW_KEY, F.sha2(F.to_json(F.struct("ids")), 256).alias("of"), "ids"), "windows")
    return grouped.select(*WINDOW_KEY, "of"), grouped.groupBy("of").agg(F.first("ids").alias("ids"))


def extended(found: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """Shared windows (row, start, size, of): places with a fingerprint of the items, extended to the windows around them."""
    met = found.join(items.select("size", "fingerprint").distinct(), ["size", "fingerprint"], "left_semi")
    hits = windows_of(met, "row", "start").join(windows, WINDOW_KEY)
    return hits.select("row", (F.col("start") - F.col("before")).alias("start"), "size", "of").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and row for every row of ``docs``."""
    prepare(docs.sparkSession)
    items, _ = materialise(item_places(benchmark), "items")
    windows, sets = item_sets(items)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, _ = materialise(candidates(numbered, items), "fingerprints")
    hits, _ = materialise(extended(found.where("start is not null").select("row", "start", *KEY), items, windows), "hits")
    upto = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        hits.select("row", "start", "size")
        .withColumn("seen", F.coalesce(F.max(F.col("start") + F.col("size")).over(upto), F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", "seen"))).alias("n_hit"))
    )
    named = hits.select("row", "of").distinct().join(sets, "of").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    named = named.select("row", F.size("ids").alias("n_items"), F.concat_ws(",", "ids").alias("ids"))
    return (
        found.where("start is null").select("row", "doc_id", "n_words").join(spans, "row", "left").join(named, "row", "left")
        .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )
