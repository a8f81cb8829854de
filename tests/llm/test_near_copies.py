"""The pipeline's near-copy stage against all pairs by brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

pytest.importorskip("ledgerlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlake.llm import near_copies
from ledgerlake.llm.common import materialise

from . import brute


def jaccard_pairs(texts: dict) -> list:
    sets = {}
    for i, t in texts.items():
        w = brute.WORD.findall((t or "").translate(brute.ASCII))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return [(i, j) for i, j in combinations(sorted(sets), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def least(ids, pairs) -> dict:
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited_texts() -> dict:
    """Texts with copies on both sides of 0.8: words replaced, cut off and added."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    texts = []
    for size in (3, 6, 30, 60, 200, 400, 900):
        for _ in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for k in r.sample(range(size), max(1, int(size * r.choice([0.005, 0.01, 0.015, 0.02, 0.03])))):
                    copy[k] = word()
                texts.append(" ".join(copy))
            texts += [" ".join(base + [word() for _ in range(max(1, size // 5))]), " ".join(base[size // 6 :]), " ".join(base).upper()]
    texts += [None, "", " \n\t", "one", "One", "one two three"]
    r.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("block, cap", [(near_copies.BLOCK, near_copies.CAP), (2, near_copies.CAP), (near_copies.BLOCK, 700)])
def test_recall_and_precision_against_all_pairs(spark, block, cap):
    texts = edited_texts()
    pairs = jaccard_pairs(texts)
    assert len(pairs) > 200 and any(texts[i] and texts[j] and texts[i].lower() != texts[j].lower() for i, j in pairs)
    rows, _ = materialise(spark.createDataFrame([(i, i, t) for i, t in texts.items()], "place long, doc_id long, text string").repartition(5), "test_rows")
    got = {r["place"] for r in near_copies.survivors(rows, block, cap).collect()}
    assert got == {i for i, k in least(texts, pairs).items() if i == k}


def test_covering_tables_meet_within_the_radius():
    """Equal fingerprints share all tables; texts whose SimHash differs in up to four bits share one at least."""
    import numpy as np

    from ledgerlake.llm.simhash import RADIUS

    texts = [t or "" for t in edited_texts().values()]
    raw = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    v, at = near_copies.shingles(bounds, np.frombuffer(b"".join(raw), np.uint8))
    keys = near_copies.covering_keys(v, at[:-1])
    fps = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in v[a:z]) > z - a) for a, z in zip(at, at[1:])]
    near = [(i, j, (fps[i] ^ fps[j]).bit_count()) for i, j in combinations(range(len(fps)), 2)]
    assert all((keys[i] == keys[j]).any() for i, j, d in near if d <= RADIUS)
    assert sum(0 < d <= RADIUS for _, _, d in near) > 5 and not all((keys[i] == keys[j]).any() for i, j, _ in near)


def test_stage_on_documents(spark):
    """Of sf0.01: every pair of 0.8 or more is told, and nothing else goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {i for i, k in least(texts, jaccard_pairs(texts)).items() if i == k}
