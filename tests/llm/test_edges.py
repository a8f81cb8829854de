"""Repeated and null ids, clashing columns, empty tables and a very long text, for the operators and the whole pipeline."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import decontaminate, langid, packing, quality, simhash, url_filters
from ledgerlake.llm.common import materialise

from . import brute
from .test_operators import prose

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row long, place long, node long, key long, h long, fp long, u long, v long, first long, count long, piece int, again int, model string"


def table(spark, rows):
    """(doc_id, text) with every other column named as some step in between names its own."""
    return spark.createDataFrame([(i, t, None, None, None, *range(12), "z") for i, t in rows], CLASHING).repartition(3)


LONG = prose(31, 120_000)
ROWS = [(None, "one two three"), (None, "one two three"), (None, None), (4, "one two three"), (4, prose(32, 60)), (4, prose(32, 60)), (5, ""), (None, LONG), (6, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ROWS).cache()


def found(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_packing_packs_each_row_of_an_id(odd):
    out = packing.pack(odd).toPandas()
    alone = packing.pack(odd.where("doc_id = 6")).toPandas()
    assert (out.piece == 0).sum() == len(ROWS)
    assert out.length.sum() == 2 * alone.length.sum() + packing.pack(odd.where("length(text) < 1000 or text is null")).toPandas().length.sum()
    g = out.sort_values(["sequence_id", "offset"])
    end = g.offset + g.length
    assert (end <= 2048).all() and (end.groupby(g.sequence_id).shift(1).fillna(0) == g.offset).all()


def test_decontamination_judges_each_row_of_an_id(spark, odd):
    items = spark.createDataFrame([(1, "one two three", 9), (1, "one two three", 9), (2, LONG[5000:5400], 9), (None, "one two", 9), (3, None, 9)], "item_id long, text string, row int")
    got = found(decontaminate.decontaminate(odd, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.decontaminate([(i, t) for i, t in ROWS], [(1, "one two three"), (2, LONG[5000:5400]), (None, "one two")])
    assert got == sorted(((i, *want[n]) for n, (i, _) in enumerate(ROWS)), key=str)


def test_a_leak_without_a_name_is_hit(spark):
    docs = table(spark, [(1, "here is a text of eleven words that nobody named at all today"), (2, "clean")])
    items = spark.createDataFrame([(None, "A text of eleven words that nobody named at all"), (7, "other words")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (10, 0, True), 2: (0, 0, False)}


@pytest.mark.parametrize("ids", ["one", "equal rows"])
def test_no_language_is_lost_to_repeated_ids(spark, ids):
    """One id on every row, and a language that is one row many times over, with a sample smaller than either."""
    learnt = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    r = random.Random(5)
    text = lambda a: " ".join("".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(40))
    rows = [(learnt, t, g) for g, a in alphabets.items() for t in ([text(a)] * 60 if ids == "equal rows" and g == "bb" else [text(a) for _ in range(60)])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), per_language=5, centroids=2)
    assert set(model["langs"]) == set(alphabets)


def test_equal_rows_are_dealt_to_all_buckets(spark):
    pieces = packing.pack(table(spark, [(None, "same")] * 3000))
    assert pieces.count() == 3000 and pieces.select("sequence_id", "offset").distinct().count() == 3000


def test_languages_of_each_row(spark, odd):
    got = found(langid.identify(odd), "doc_id", "lang_pred", "score")
    assert got == sorted(((i, "und", 0.0) for i, _ in ROWS), key=str)  # no row has a language to learn from


def test_quality_of_each_row(odd):
    got = found(quality.score(odd), "doc_id", "n_words", "base_failed")
    words = [len((t or "").split()) for _, t in ROWS]
    assert [g[:2] for g in got] == sorted(((i, n) for (i, _), n in zip(ROWS, words, strict=True)), key=str)
    assert sum(not g[2] for g in got) == sum(n >= 50 for n in words)


def test_simhash_of_each_row(odd):
    got = found(simhash.near_duplicates(odd), "doc_id", "fp", "component_id")
    prints = [int.from_bytes(simhash.fingerprint((t or "").encode()), "big", signed=True) for _, t in ROWS]
    groups = list(range(len(ROWS)))
    for _ in ROWS:
        groups = [min(groups[j] for j in range(len(ROWS)) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4) for i in range(len(ROWS))]
    least = {g: min((i for (i, _), k in zip(ROWS, groups, strict=True) if k == g and i is not None), default=None) for g in groups}
    assert got == sorted(((i, f, least[g]) for (i, _), f, g in zip(ROWS, prints, groups, strict=True)), key=str)


def test_urls_with_clashing_columns(spark):
    rows = [(1, "http://a.com/en/1", "", 1, "x", "y", "z", 2), (1, "http://a.com/en/1", "", 1, "x", "y", "z", 2), (None, "http://b.edu/" + "p" * 200_000, "<link rel=canonical href='http://a.com/en/1'>", 1, "x", "y", "z", 2)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, node long, host string, path string, rule string, u int")
    assert [(r["page_id"], r["verdict"]) for r in url_filters.judge(df).orderBy("page_id").collect()] == [(None, "block"), (1, "block"), (1, "block")]


def pipeline(spark, docs, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, _ = materialise(docs, "test_edges")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = materialise(stage(spark, docs, sf), "test_edges")
        left[name] = docs.collect()
    return left


def test_pipeline_of_nothing(spark, sf):
    left = pipeline(spark, table(spark, []), sf)
    assert all(not x for x in left.values())


def test_pipeline_of_odd_rows(spark, sf):
    """All documents, and under null and repeated ids: copies, a very long text, nulls; other columns clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    twin = max((t for _, t, g in given if g == "en"), key=len)
    long_ = " ".join(t for _, t, g in given if g == "en")
    odd = [(None, long_, "en"), (None, twin, "en"), (None, twin.upper(), "en"), (0, twin, None), (0, "", "en"), (None, None, None)]
    wide = table(spark, [(i, t) for i, t, _ in given + odd]).drop("lang", "source", "n_chars")
    wide = wide.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    langs = spark.createDataFrame([(i, g) for i, _, g in given], "doc_id long, lang string")
    known = docs.select("doc_id", "text", F.lit("s").alias("source"), "n_chars").join(langs, "doc_id")
    rows = wide.join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_anti").unionByName(known, allowMissingColumns=True)
    assert rows.count() == len(given) + len(odd)
    left = pipeline(spark, rows, sf)
    first = [r["text"] for r in left["language_id"]]
    assert first.count(twin) == 3 and first.count(twin.upper()) == 1 and long_ in first and "" not in first and None not in first
    second = [(r["doc_id"], r["text"]) for r in left["simhash_near_dedup"]]
    assert [i for i, t in second if t.upper() == twin.upper()] == [0] and (None, long_) in second
    names = {(i, t): None if i is None else 2 * i + (t == twin) for i, t in second}  # two texts have id 0; a null id is the earliest
    stats, kept = brute.suffix_dedup([(names[x], x[1]) for x in second])
    want = [(i, kept[n].decode(errors="ignore")) for (i, _), n in names.items() if stats[n][0] == 0 or stats[n][1] < stats[n][0]]
    assert sorted(((r["doc_id"], r["text"]) for r in left["suffix_array_dedup"]), key=str) == sorted(want, key=str)
    assert all(r["source"] == "s" for r in left["benchmark_decontamination"])
    assert {r["doc_id"] for r in left["best_fit_packing"]} == {r["doc_id"] for r in left["benchmark_decontamination"]}
