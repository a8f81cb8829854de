"""The filter audit against applying the filters one by one, order by order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("ledgerlake.llm")

from ledgerlake.llm import filter_audit

from .brute import WORD
from .test_operators import DOCS as WIDE
from .test_operators import hard_rows, prose

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """Rows of the audit; rows: (doc_id, text, lang), labels: (doc_id, quality, toxic)."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and firsts[t] < i,
        }
        good, toxic = (any(k == i and i is not None and x == 1 for k, x in ((r[0], r[c]) for r in labels)) for c in (1, 2))
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, good, toxic))
    out = []
    for part, docs in parts.items():
        own, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                redundant = sum(f in d[0] for d in docs) - len(gone)
                own.append((f, part, "".join(order), step, len(left), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*r[1:], total[r[0]]) for r in own]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def cases():
    long_ = prose(5, 230)
    texts = [long_, long_, long_.upper(), "a b " * 150, "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "x # y", long_ + " |", "", None, "", " \n", "é" * 50, long_, long_ + " |", prose(6, 199), prose(6, 200), "$ " + "a " * 300]
    ids = [3, 3, 5, 6, 7, 8, 9, None, 10, 11, None, 12, 13, None, 2, 14, 15, 1]
    langs = ["en", "en", None, "", "de", "de", "de", "en", "en", "en", "en", None, "", "de", "de", "en", "en", "en"]
    return [(i, t, g) for i, t, g in zip(ids, texts, langs, strict=True)]


LABELS = [(3, 1, 0), (3, 0, 1), (3, 1, 1), (5, 1, 0), (9, 0, 1), (10, None, 1), (2, 1, None), (None, 1, 1), (99, 1, 1), (15, 1, 0), (14, 2, 2)]


def test_audit_equals_applying_the_filters(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, 1, 2, "z", 3) for r in rows], "doc_id int, text string, lang string, mask int, n int, part string, good int").repartition(4)
    labels = spark.createDataFrame([(*r, "z") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    assert got(filter_audit.audit(docs, labels)) == plain(rows, LABELS)


def test_audit_of_hard_rows_and_nothing(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r[0], r[1], r[2]) for r in hard_rows()]
    assert got(filter_audit.audit(spark.createDataFrame(hard_rows(), WIDE), labels)) == plain(rows, LABELS)
    assert got(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels.where("false"))) == plain(rows, [])
    assert got(filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for at in filter_audit.transpositions(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert seen == set(permutations(range(n))) and sum(1 for _ in filter_audit.transpositions(n)) == len(seen) - 1


def test_walk_adds_a_filter_over_all_orders():
    table = np.random.default_rng(1).integers(0, 50, (32, 3))
    rows = filter_audit.walk(table)
    for f in "ABCDE":
        mine = [r for r in rows if r["filter_order"][r["step"] - 1] == f]
        assert len(mine) == 120 and {r["shapley"] for r in mine} == {sum(r["removed"] for r in mine)}
