"""Language identification by nearest centroid over normalised TF-IDF character n-grams.

Fitting takes at most ``PER_LANGUAGE`` labelled documents of each language, those of smallest id hash (a documented bound:
the classifier doesn't get better with more).  Document frequencies come from them; the vectors of ``1 - CALIBRATION`` of
each language's documents are clustered by spherical k-means in one task per language, and a text is compared with every
centroid by cosine.  The rest of the learned documents, which no centroid has seen, calibrate the rejection: a text is
rejected if it is farther from all centroids than all but ``FALSE_REJECTS`` of the calibration documents of about its size.

Scale: prediction is a map; the model has ``CENTROIDS`` vectors of 64 KB a language and grows with nothing else.

Results for unusual input: null text and text without letters are ``und`` with score 0 and rejected; rows with null
doc_id are predicted but never learned from; with nothing to learn from, every text is ``und``; repeated rows count as
separate rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, materialise, prepare

BITS = 14
DIMENSIONS = 1 << BITS
SIZES = 16
PER_LANGUAGE = 1000
CENTROIDS = 4
#: A table of languages of at most so many rows is broadcast; a longer one is joined as Spark sees fit.
BROADCAST_LANGUAGES = 10_000
ORDERS = (1, 2, 3)
#: Share of the learned documents that only calibrate, and of those that the distance bound may reject.
CALIBRATION = 0.3
FALSE_REJECTS = 0.002
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of each text in hashed dimensions: letters in lower case, all else a word gap."""
    low = [" " + t.lower() + " " for t in texts]
    sizes = np.array([len(t) for t in low])
    x = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), sizes)
    letter = _letter_table()[x]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each run of letters
    first = np.zeros(len(x), bool)
    first[np.cumsum(sizes) - sizes] = True
    keep |= first
    x = np.where(letter, x, np.uint32(32))[keep]
    doc = doc[keep]
    gap = x == 32
    found = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h, none = x[:m], gap[:m]
        for j in range(1, n):
            h = h * np.uint32(0x01000193) + x[j : m + j]
            none = none & gap[j : m + j]
        some = np.flatnonzero(~none & (doc[:m] == doc[n - 1 :]))
        h = (h[some] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(doc[some] * DIMENSIONS + (h >> np.uint32(32 - BITS)))
    return np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=len(low) * DIMENSIONS).reshape(len(low), DIMENSIONS)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(np.arange(int(c.max(initial=0)) + 1)).astype(np.float32)[c] * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def size_class(c: np.ndarray) -> np.ndarray:
    """Texts by size: the power of two of their number of n-grams."""
    return np.minimum(np.log2(c.sum(axis=1) + 1).astype(int), SIZES - 1)


def runs_of_texts(texts: list, limit: int = CHUNK_BYTES):
    """Index ranges of about ``limit`` characters, and at most 128 texts; long texts alone and whole."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and (size + n > limit or i - a >= 128):
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def k_means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from seeds that are far from each other."""
    seeds = [int((v @ v.mean(axis=0)).argmax())]
    far = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(far.argmin()))
        far = np.maximum(far, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def learnable():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> dict | None:
    """Centroids, their languages, IDF and rejection bounds, from labelled ``docs`` (doc_id, text, lang) given."""
    spark = docs.sparkSession
    known = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    drawn = known.withColumn("h", F.xxhash64("doc_id", "text"))  # by content: an id that many rows share is no draw
    sizes = drawn.select("lang", "h").distinct().groupBy("lang").count()
    share, _ = materialise(sizes.select("lang", (2.0 * per_language / F.col("count")).alias("share")), "shares")
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    few = drawn.select("lang", "text", "h", (F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)).alias("u")).join(share, "lang").where("u < share")
    once = few.withColumn("copy", F.row_number().over(Window.partitionBy("lang", "h").orderBy("u"))).where("copy = 1")  # equal rows go in the first task
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))
    sample, _ = materialise(once.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text").repartition(8), "langs")

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in runs_of_texts(texts):
                total += (counts(texts[a:z]) > 0).sum(axis=0)
                n += z - a
        yield pa.record_batch([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    rows = sample.select("text").mapInArrow(frequencies, "n long, df binary").collect()  # a row a task of the bounded sample
    n = sum(r["n"] for r in rows)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + sum(np.frombuffer(r["df"]) for r in rows))).astype(np.float32) + np.float32(1)

    def clusters(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, v, size = list(pdf["text"]), [], []
        for a, z in runs_of_texts(texts):
            c = counts(texts[a:z])
            v.append(vectors(c, idf))
            size.append(size_class(c))
        v, size = np.concatenate(v), np.concatenate(size)
        v, size = v[size > 0], size[size > 0]
        if not len(v):
            return pd.DataFrame({"lang": [], "centroid": [], "reached": [], "sizes": []})
        held = np.arange(len(v)) % 10 < 10 * CALIBRATION if len(v) >= 10 else np.zeros(len(v), bool)
        c = k_means(v[~held], centroids)
        if not held.any():
            held[:] = True
        reached = (v[held] @ c.T).max(axis=1).astype(np.float64)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [x.astype(np.float32).tobytes() for x in c], "reached": reached.tobytes(), "sizes": size[held].astype(np.int64).tobytes()})

    found = sample.groupBy("lang").applyInPandas(clusters, "lang string, centroid binary, reached binary, sizes binary").collect()  # a few rows a language
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    if not found:
        return None
    each = {r["lang"]: r for r in found}.values()
    reached = np.concatenate([np.frombuffer(r["reached"]) for r in each])
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in each])
    floors = np.zeros(SIZES)
    for k in range(SIZES):  # with the nearest smaller and larger sizes where a size is rare
        near = np.abs(sizes - k)
        some = np.sort(reached[near <= np.sort(near)[min(199, len(near) - 1)]])
        # fewer than 1 / FALSE_REJECTS documents can't show so small a share: a step below the least of them
        n = FALSE_REJECTS * len(some)
        floors[k] = some[int(n)] if n >= 1 else some[0] - (1 - n) * (np.median(some) - some[0]) / 4
    return {"idf": idf, "langs": [r["lang"] for r in found], "centroids": np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), "floors": floors}


def judged(texts: list[str], m: dict | None):
    """(languages, scores, rejections) of runs of ``texts``, in order."""
    for a, z in runs_of_texts(texts):
        if m is None:
            yield ["und"] * (z - a), [0.0] * (z - a), [True] * (z - a)
            continue
        c = counts(texts[a:z])
        some = c.any(axis=1)
        sim = vectors(c, m["idf"]) @ m["centroids"].T
        best = sim.argmax(axis=1)
        top = np.clip(sim[np.arange(len(best)), best].astype(float), 0, 1)
        names = [m["langs"][j] if s else "und" for j, s in zip(best, some, strict=True)]
        yield names, np.where(some, top, 0.0).tolist(), (~some | (top < m["floors"][size_class(c)])).tolist()


SCORED = "row long, doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """lang_pred, score and rejected for each row (row, doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            names, scores, bad = (sum(x, []) for x in zip(([], [], []), *judged([t or "" for t in b.column(2).to_pylist()], shared.value), strict=True))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bad, pa.bool_())], names=["row", "doc_id", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(work, SCORED)


def keep(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` (with a string column text) that aren't rejected, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            good = [not x for _, _, bad in judged(texts, shared.value) for x in bad]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and row for each of ``docs`` (doc_id, text, lang)."""
    prepare(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = predict(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), fit(d))
    return scored.select("row", "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
