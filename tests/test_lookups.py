"""Lookups by a column of a table, against plain versions."""

from __future__ import annotations

import random

from ledgerlake.operators.lookups import match_years, resolve


def plain_resolve(q, entities):
    found = []
    for i, name, code in entities:
        low = (name or "").lower()
        kind = 1 if q == str(i) else 2 if name is not None and q == low else 3 if q == code else 4 if q and q.lower() in low else 0
        if kind:
            found.append((kind, i))
    kind, i = min(found, default=(None, None))
    return i, kind


def test_resolve_takes_the_first_kind(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abAB1 ") for _ in range(n))
    entities = [(i, word(r.randint(1, 7)), f"C{i % 9}") for i in range(40)] + [(40, None, None), (41, "", "C1"), (42, "7", "x")]
    asked = [word(r.randint(1, 5)) for _ in range(300)] + ["7", "41", "C1", "c1", "", "nobody", "%", "_", None, "7"]
    got = resolve(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame(entities, "id int, name string, code string")).collect()
    want = {q: plain_resolve(q, entities) for q in asked if q is not None}
    assert len(got) == len(want) and {x["q"]: (x["entity_id"], x["kind"]) for x in got} == want
    assert {k for _, k in want.values()} == {None, 1, 2, 3, 4}


def test_resolve_without_entities(spark):
    got = resolve(spark.createDataFrame([("a",), (None,)], "q string"), spark.createDataFrame([], "id int, name string, code string")).collect()
    assert [tuple(x) for x in got] == [("a", None, None)]


def test_labels_without_a_year_filter_nothing(spark):
    years = spark.createDataFrame([(1999, 3), (2000, 4)], "fy int, lines long")
    asked = spark.createDataFrame([("1999/00",), ("2000",), ("2000",), ("1999-00",), ("*",), (None,)], "q string")
    got = sorted((x["q"], x["fy"], x["lines"]) for x in match_years(asked, years).collect())
    every = [(q, y, n) for q in ("*", "1999-00") for y, n in ((1999, 3), (2000, 4))]
    assert got == sorted([("1999/00", 1999, 3), ("2000", 2000, 4), *every])
