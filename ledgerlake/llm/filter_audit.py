"""How filters interact: what each removes in every order in which they can be applied.

A text's failures are a mask of one bit a filter.  Texts are reduced to cells (part, mask) with their counts, so all orders
follow from at most 2**n cells a part.  The orders are visited by adjacent transpositions (each differs from the one before
by one swap); a swap changes what its two steps remove and nothing else, so only those are computed anew.  A filter's total
over all orders grows along the walk: when a swap changes what a filter removes, its old count is added once for each order
that it held in.

Scale: one pass over the texts, one join with the labels by id, and aggregates that combine before they shuffle.  The copies
of a text are reduced to its first id and the number of rows under it, so no row meets its copies.  Parts are walked apart.

Results for unusual input: null texts are empty, null languages the empty string; a null id comes before and after none, so
its row is no later copy and makes none; rows that repeat an id are copies of what lies under smaller ids only; several labels
of an id count as one that has every mark of them; an empty table has no parts and no rows; other columns are ignored.
Texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

FILTERS = "ABCDE"
LATER_COPY = 1 << 4
MEASURES = ("n", "good", "toxic")
_UPPER = bytes(range(65, 91))
_MARK = re.compile(rb"[#$%&*|]")


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, marks."""
    raw = text.encode()
    words = raw.split()  # bytes: ASCII white space only
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | (_MARK.search(raw) is not None) << 3


def _masks(batches):
    """doc_id, part, mask and 128 bits of the text."""
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        same = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in texts), "<i8").reshape(-1, 2)
        yield pa.record_batch([b.column(0), b.column(2), pa.array([failures(t) for t in texts], pa.int32()), pa.array(same[:, 0].copy()), pa.array(same[:, 1].copy())], names=["doc_id", "part", "mask", "a", "b"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of a part that fail just the filters of the mask."""
    form = "doc_id long, part string, mask int, a long, b long"
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    rows = typed.mapInArrow(_masks, form)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    # written, so that the join can split an id that many rows have
    known, _ = materialise(known.select("doc_id", "part", "mask", "a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))), "filter_masks")
    kind = ["a", "b", "part", "mask", "good", "toxic"]
    by_id = known.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    dated = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(dated, F.col("n"))).alias("dated"), F.min(F.when(dated, F.struct("doc_id", "n"))).alias("first"))
    # one row a text and kind: as many as there are languages and labels among its copies
    least = by_text.groupBy("a", "b").agg(F.min("first.doc_id").alias("least"))
    here = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    later = F.coalesce(F.col("dated") - here, F.lit(0))
    split = by_text.join(least, ["a", "b"]).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", (F.col("n") - later).alias("n")), F.struct(F.col("mask").bitwiseOR(LATER_COPY).alias("mask"), later.alias("n")))).alias("c"))
    n = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def transpositions(n: int):
    """The places of the swaps that lead from the first order through all others, each once (Steinhaus, Johnson, Trotter)."""
    order, way = list(range(n)), [-1] * n
    while True:
        for k in range(n - 1, -1, -1):
            at = order.index(k)
            to = at + way[k]
            if 0 <= to < n and order[to] < k:
                break
        else:
            return
        order[at], order[to] = order[to], k
        for larger in range(k + 1, n):
            way[larger] = -way[larger]
        yield min(at, to)


def walk(table: np.ndarray, filters: str = FILTERS) -> list[dict]:
    """Every order's steps from the cells of a part: ``table[mask]`` has the counts of ``MEASURES``."""
    n = len(filters)
    passing = table.copy()  # of each set of filters: what passes all of them
    for f in range(n):
        has = np.flatnonzero(np.arange(1 << n) >> f & 1)
        passing[has] += passing[has ^ (1 << f)]
    passing = passing[::-1]
    fails = [passing[0] - passing[1 << f] for f in range(n)]
    order, removed, since, total = list(range(n)), [None] * n, [0] * n, [0] * n

    def step(place: int) -> dict:
        before = sum(1 << f for f in order[:place])
        f = order[place]
        after = before | 1 << f
        gone = passing[before] - passing[after]
        removed[f] = int(gone[0])
        return {"step": place + 1, "kept": int(passing[after][0]), "removed": int(gone[0]), "redundant": int(fails[f][0] - gone[0]), "unique_fails": int(table[1 << f][0]), "good_lost": int(gone[1]), "toxic_lost": int(gone[2]), "filter": f}

    steps, out, visited = [step(p) for p in range(n)], [], 0
    swaps = transpositions(n)
    while True:
        name = "".join(filters[f] for f in order)
        out += [{"filter_order": name, **s} for s in steps]
        visited += 1
        at = next(swaps, None)
        if at is None:
            break
        for f in order[at : at + 2]:
            total[f] += removed[f] * (visited - since[f])
            since[f] = visited
        order[at], order[at + 1] = order[at + 1], order[at]
        steps = [*steps[:at], step(at), step(at + 1), *steps[at + 2 :]]
    for f in range(n):
        total[f] += removed[f] * (visited - since[f])
    for row in out:
        row["shapley"] = total[row.pop("filter")]
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _walked(part: pd.DataFrame) -> pd.DataFrame:
    table = np.zeros((1 << len(FILTERS), len(MEASURES)), np.int64)
    table[part["mask"].to_numpy()] = part[list(MEASURES)].to_numpy()
    found = pd.DataFrame(walk(table))
    found.insert(0, "part", part["part"].iloc[0])
    return found[["part", "filter_order", "step", *COUNTS]]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order and step; docs: (doc_id, text, lang), labels: (doc_id, quality, toxic)."""
    prepare(docs.sparkSession)
    return cells(docs, labels).groupBy("part").applyInPandas(_walked, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
