"""The prefix-tree join against all pairs of sets."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import ngram_join
from ledgerlake.llm.oracles import ORACLE_SQL
from ledgerlake.llm.queries import QUERIES

from .brute import ASCII, WORD
from .test_operators import hard_rows, prose
from .test_operators import DOCS as WIDE


def shingles(text):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def plain(rows):
    """[(doc_id, n_shingles, component_id)] by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return sorted(((d, len(sets[i]), names.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def family(seed, n, words, edits):
    """Texts that drift apart: each is an earlier one with a few words changed."""
    r = random.Random(seed)
    out = [prose(seed, words).split()]
    while len(out) < n:
        w = list(r.choice(out))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(["one", "two", "three", "xx"])
        out.append(w)
    return [" ".join(w) for w in out]


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def cases():
    shared = prose(70, 90)
    texts = family(1, 40, 120, 3) + family(2, 30, 40, 2) + family(3, 25, 300, 12) + [shared + " " + prose(80 + i, 30) for i in range(20)] + [prose(90, 9), prose(90, 9) + " x", prose(90, 10), "a b", "A  b", "a", None, "", " \n", "a b c", "A b\tc a b c"]
    return [(i * 7 % 211 if i % 9 else None if i % 2 else 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cap", [ngram_join.CAP, 700, 150])
def test_components_equal_all_pairs(spark, cap):
    rows = cases()
    df = spark.createDataFrame([(i, t, 1, 2, b"z", 3, 4, 5) for i, t in rows], "doc_id int, text string, key int, node int, bits binary, size int, place int, a int").repartition(3)
    assert got(ngram_join.join(df, cap)) == plain(rows)


def test_hard_rows_and_nothing(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    assert got(ngram_join.join(spark.createDataFrame(hard_rows(), WIDE))) == plain(rows)
    assert not ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect()


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_every_link_of_its_groups(seed):
    r = np.random.default_rng(seed)
    rank = r.permutation(ngram_join.SLOTS).astype(np.int32)
    sets, group = [], []
    for g in range(5):
        base = r.integers(0, 2**63, 40).astype(np.uint64)
        for _ in range(int(r.integers(1, 30))):
            s = base[r.random(40) > 0.05] if r.random() < 0.7 else base[: r.integers(1, 40)]
            sets.append(np.unique(np.concatenate([s, r.integers(0, 2**63, r.integers(0, 3)).astype(np.uint64)])))
            group.append(g)
    group = np.array(group)
    trie = ngram_join.Trie(sets, group, rank)
    every = np.arange(len(sets))
    pairs = {(int(trie.order[p]), int(trie.order[t])) for p, t in zip(*trie.near(every, np.ones(len(sets), bool)), strict=True)}
    want = set()
    for i in range(len(sets)):
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i != j and group[i] == group[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    assert pairs == want

    def parts(edges):
        root = list(range(len(sets)))
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    seeds = np.ones(len(sets), bool)
    assert parts(list(zip(*trie.links(seeds), strict=True))) == parts(want)
    some = r.random(len(sets)) < 0.3
    full, part = parts(want), parts(list(zip(*trie.links(some), strict=True)))
    for i in np.flatnonzero(some):
        assert {j for j in every if full[j] == full[i]} == {j for j in every if part[j] == part[i]}


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op12_ngram_jaccard_join"]).df()
    assert got(QUERIES["op12_ngram_jaccard_join"](spark, sf)) == sorted(((r.doc_id, r.n_shingles, r.component_id) for r in want.itertuples()), key=str)
