"""Centroid scores and line clusters against versions written out in plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import html_extract, langid


def plain_vector(text: str, idf) -> dict[int, float]:
    """Normalised log-scaled TF-IDF of the n-grams of letters and gaps, none of gaps alone."""
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            now += c
        elif now:
            words.append(now)
            now = ""
    line = " " + "".join(w + " " for w in words)
    found = Counter()
    for n in langid.ORDERS:
        for i in range(len(line) - n + 1):
            gram = line[i : i + n]
            if gram.strip(" "):
                h = 0
                for k, c in enumerate(gram):
                    h = ord(c) if k == 0 else (h * 0x01000193 + ord(c)) % 2**32
                h = (h + n) * 0x9E3779B1 % 2**32
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
                found[h >> (32 - langid.BITS)] += 1
    v = {d: math.log1p(c) * float(idf[d]) for d, c in found.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {d: x / norm for d, x in v.items()}


def test_nearest_centroid_by_cosine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    texts = [r["text"] for r in docs.select("text").where("text is not null").orderBy("doc_id").limit(60).collect()]
    texts += ["", "123 !?", "a", "Ünïcödé İstanbul ß", "\n\tone  two three--four "]
    langs, scores = [], []
    for a, b, _ in langid.judged(texts, model):
        langs += a
        scores += b
    decided = 0
    for text, lang, score in zip(texts, langs, scores, strict=True):
        v = plain_vector(text, model["idf"])
        if not v:
            assert (lang, score) == ("und", 0.0)
            continue
        cosines = [sum(x * float(c[d]) for d, x in v.items()) for c in model["centroids"]]
        best = max(cosines)
        assert abs(best - score) < 1e-4
        near = {name for name, s in zip(model["langs"], cosines, strict=True) if best - s < 1e-4}
        assert lang in near
        decided += len(near) == 1
    assert decided > 50 and len(set(langs)) > 3


def plain_content(size, tags, open_):
    """Gaussian mean of the ratios around each line, then the upper of two clusters of their logarithms."""
    ratio = [s / max(1, t) if o else 0.0 for s, t, o in zip(size, tags, open_, strict=True)]
    reach, n = max(1, math.ceil(2 * html_extract.SIGMA)), len(ratio)
    weight = lambda d: math.exp(-d * d / (2 * html_extract.SIGMA**2))
    smooth = []
    for i in range(n):
        at = range(max(0, i - reach), min(n, i + reach + 1))
        smooth.append(math.log1p(sum(ratio[j] * weight(i - j) for j in at) / sum(weight(i - j) for j in at)))
    x = [s for s, o in zip(smooth, open_, strict=True) if o]
    lo, hi = min(x), max(x)
    if hi - lo < math.log(2):
        return list(open_)
    for _ in range(20):
        low, high = [s for s in x if s < (lo + hi) / 2], [s for s in x if s >= (lo + hi) / 2]
        lo, hi = sum(low) / len(low), sum(high) / len(high)
    if hi - lo < math.log(2):
        return list(open_)
    return [o and s >= (lo + hi) / 2 for s, o in zip(smooth, open_, strict=True)]


def test_lines_cluster_by_smoothed_ratio():
    r = random.Random(4)
    parted = 0
    for _ in range(300):
        n = r.randint(1, 40)
        size = [r.choice([r.randint(1, 12), r.randint(80, 900)]) for _ in range(n)]
        tags = [r.randint(0, 6) for _ in range(n)]
        open_ = [r.random() < 0.9 for _ in range(n)]
        open_[r.randrange(n)] = True
        want = plain_content(size, tags, open_)
        got = html_extract.content_lines(np.array(size, float), np.array(tags), np.array(open_)).tolist()
        assert got == want
        parted += want != open_
    assert parted > 200
