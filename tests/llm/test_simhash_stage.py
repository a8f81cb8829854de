"""The SimHash step of the pipeline's near-copy stage: bits are compared, and only what they connect is checked by it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")

from pyspark.sql import functions as F

from ledgerlake.llm import near_copies
from ledgerlake.llm.common import materialise, prepare
from ledgerlake.llm.components import components

from .test_near_copies import edited_texts, jaccard_pairs, least


def test_simhash_classes_and_their_exact_check(spark):
    """Without the min-wise keys: classes by Hamming distance at radius 4, links inside them by similarity, no others."""
    texts = {i: t or "" for i, t in edited_texts().items()}
    raw = [t.encode() for t in texts.values()]
    v, at = near_copies.shingles(np.concatenate([[0], np.cumsum([len(b) for b in raw])]), np.frombuffer(b"".join(raw), np.uint8))
    fps = [int(x) for x in near_copies.fingerprints(v, at[:-1])]
    want = least(texts, [(i, j) for i, j in combinations(texts, 2) if (fps[i] ^ fps[j]).bit_count() <= near_copies.RADIUS])
    pairs = jaccard_pairs(texts)
    inside = [(i, j) for i, j in pairs if want[i] == want[j]]
    keys = near_copies.covering_keys(v, at[:-1])
    assert len(inside) < len(pairs) and any(want[i] != want[j] and (keys[i] == keys[j]).any() for i, j in pairs)  # met in a table, too far apart
    prepare(spark)
    rows, _ = materialise(spark.createDataFrame(list(texts.items()), "place long, text string").repartition(3), "test_rows")
    sampled = rows.mapInArrow(near_copies._samples, "place long, size long, fp long, a long, b long, keys array<long>")
    nodes, _ = materialise(sampled.select(F.col("place").alias("node"), "size", "fp", F.array().cast("array<long>").alias("keys")), "test_nodes")
    got = {}
    for r in near_copies.classes(nodes).collect():
        got.setdefault(r["class"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == k) for k in set(want.values()))
    roots = {r["node"]: r["root"] for r in components(near_copies.links(rows, nodes)).collect()}
    assert {i: roots.get(i, i) for i in texts} == least(texts, inside)
