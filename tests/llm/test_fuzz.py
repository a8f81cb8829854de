"""Texts over small alphabets, periodic and cut at odd places, against the plain versions."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import decontaminate, quality, suffix_dedup

from . import brute


def pieces(seed: int):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(20, 260))) for _ in range(14)] + ["é" * 60, "xyz" * 50, "q" * 130, "".join(r.choice("abcdefgh \n") for _ in range(300))]
    docs = {}
    for _ in range(200):
        t = "".join(r.choice(parts)[r.randint(0, 30) :] for _ in range(r.randint(0, 5)))
        if t and r.random() < 0.4:
            k = r.randint(0, len(t) - 1)
            t = t[:k] + "#" + t[k + 1 :]
        docs[r.randint(0, 10**9)] = t
    return list(docs.items())


@pytest.mark.parametrize("block", [1024, 40, 2])
def test_suffix_dedup(spark, block):
    docs = pieces(11)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, block=block).collect()}
    assert got == brute.suffix_dedup(docs)[0]


def test_words(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.randint(0, 80)))) for i in range(150)]
    items = [(i, " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.choice([1, 3, 4, 5, 6, 9, 10, 11, 25])))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute.decontaminate(docs, items)
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d: want[n] for n, (d, _) in enumerate(docs)}
    longest = {x["doc_id"]: x["longest_repeat"] for x in quality.score(df).collect()}
    assert longest == {d: brute.longest_repeat(t.split()) for d, t in docs}
