"""Figures of statements against the patterns read plainly, and how often a text is searched."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from ledgerlake.operators import QUERIES
from ledgerlake.operators import parsers as P
from ledgerlake.sources.roles import SURVEYS


def plain_figures(text):
    """Figures by the patterns with all that may surround them, as the SQL has it."""
    x = re.sub(r"[ \t\n\v\f\r]+", " ", text)

    def read(p, n, units):
        m = re.search(P.around(p, n)[4:], x, re.I | re.A | re.S)
        v = m and m[1].replace(",", "")
        return float(v) * next((s for u, s in units if re.search(u, m[0].lower())), 1.0) if v else None

    first = lambda values, low, high: next((v for v in values if v is not None and low <= v <= high), None)
    people = first((v if v is None else math.floor(v) for v in (read(p, 100, [("million| m |mn", 1e6)]) for p in P.POPULATION)), 1e7, 1e8) if len(text) >= 50 else None
    gdp = first((read(p, 50, [("trillion| tn| t ", 1e12), ("billion| bn| b ", 1e9), ("million", 1e6)]) for p in P.GDP), 1e12, 50e12)
    return people, gdp, *(first((read(p, 0, []) for p in ps), 0, most) for most, ps in P.RATES.values())


def test_macro_figures_with_what_surrounds_them(spark):
    r = random.Random(5)
    pads = ["", " ", "\n \t", "million", " m ", "mn", " tn ", "trillion", " billion,", "é🙂", "in the year of the census", "Population", "GDP", "K", "x" * 49, "y" * 90, "word " * 30]
    figures = [s.replace("{p}", str(r.choice([4, 12, 47]))).replace("{y}", "1999").replace("{g}", r.choice(["9,870", "12,345"])).replace("{m}", "07") for s in SURVEYS for _ in range(3)]
    some = lambda: "".join(r.choice(pads) for _ in range(r.randint(0, 4)))
    texts = [some() + r.choice([str, str.upper])(r.choice(figures)) + some() + r.choice(["", r.choice(figures)]) for _ in range(1500)] + ["z" * 99 + "million" + "y" * n + " GDP: 12 and population: 47,123,456" + "x" * n + " million" for n in range(40, 110)]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", P.population(t), P.gdp(t), *(P.rate(t, n) for n in P.RATES))
    got = {x[0]: tuple(x)[1:] for x in df.collect()}
    want = {x: plain_figures(x) for x in texts}
    assert [x for x in got if got[x] != want[x]] == [] and all(sum(w[i] is not None for w in want.values()) > 40 for i in range(5))


def test_texts_are_searched_once(spark, sf):
    """A pattern that may begin up to 100 characters before a figure was tried at every place of every text, several times."""
    plan = QUERIES["macro_indicators"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "0,100}?" not in plan and "0,50}?" not in plan and plan.count("regexp_replace(") < 20
