"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import pytest

pytest.importorskip("ledgerlake.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerlake.llm.common import materialise

from . import brute
from .test_near_copies import jaccard_pairs, least


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "123 456", "en", "s", 7), (10**9 + 2, "", "fr", "s", 0)], docs.schema)
    docs, _ = materialise(docs.unionByName(odd), "test_docs")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs, _ = materialise(stage(spark, docs, sf), "test_stage")
        after = docs.collect()
        seen[name] = (before, after)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all((r["lang"], r["source"]) == (before[r["doc_id"]]["lang"], before[r["doc_id"]]["source"]) for r in after)
    before, after = seen["language_id"]
    assert {d for d in before if d not in {r["doc_id"] for r in after}} >= {10**9, 10**9 + 1, 10**9 + 2} and len(after) >= 0.99 * len(before) - 3
    before, after = seen["simhash_near_dedup"]
    texts = {d: r["text"] for d, r in before.items()}  # five words and a similarity of 0.8, as stages on shingles take
    assert {r["doc_id"] for r in after} == {d for d, k in least(texts, jaccard_pairs(texts)).items() if d == k}
    before, after = seen["suffix_array_dedup"]
    stats, kept = brute.suffix_dedup([(d, r["text"]) for d, r in before.items()])
    assert {r["doc_id"]: r["text"] for r in after} == {d: kept[d].decode(errors="ignore") for d, s in stats.items() if s[0] == 0 or s[1] < s[0]}
    before, after = seen["benchmark_decontamination"]
    given = [(d, r["text"]) for d, r in before.items()]
    hit = brute.decontaminate(given, items)
    assert {r["doc_id"] for r in after} == {d for n, (d, _) in enumerate(given) if not hit[n][4]}
    before, after = seen["best_fit_packing"]
    assert {r["doc_id"] for r in after} == set(before)


def test_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()) == sorted(f"op{i}" for i in range(1, 14))
    assert corpus_pipeline.run(spark, sf).count() > 0
