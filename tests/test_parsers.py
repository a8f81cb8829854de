"""Golden values of the readers of audit reports and statistics, and of metadata of any shape."""

from __future__ import annotations

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import nested as J
from ledgerlake.operators import parsers as P


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (P.audit_amount, "KES 1,234,567.89 was unaccounted for", 1234567.89), (P.audit_amount, "Ksh. 45.6 million irregular", 4.56e7), (P.audit_amount, "Kshs 2.5 billion", 2.5e9), (P.audit_amount, "KES 12 (in all, million)", 1.2e7),
        (P.audit_amount, "KES 12 as the books of the county say, million", 12.0), (P.audit_amount, "paid 500 thousand KES", 500.0), (P.audit_amount, "no amount", None), (P.audit_amount, None, None), (P.audit_amount, "K.Sh. 3 thousand", 3000.0), (P.audit_amount, "Sh. , and 7 KES", 7.0),
        (P.is_finding, "Audit Findings", True), (P.is_finding, "US$ 5 paid", False), (P.is_finding, "x,200 bags", True), (P.is_finding, "Basis of opinion", True), (P.is_finding, "the weather", False), (P.is_finding, "pending bills", True),
        (P.responses, "Management response: We agree.\nDETAILED FINDINGS\nmore", ["We agree."]), (P.responses, "x\nEntity response\nnoted\n\nManagement Response\nagain", ["noted\n\nManagement Response\nagain", "again"]),
        (P.responses, "Management comment " + "y" * 3000, ["y" * 1999]), (P.responses, "a Management response: not at a line's start", []), (P.responses, "Auditee responses\n  \n", []),
        (P.currency_amount, "KES 1,234,567.89", 1234567.89), (P.currency_amount, "USD -5 000", -5000.0), (P.currency_amount, "none", 0.0), (P.currency_of, "1,234", "KES"), (P.currency_of, "E U R 5", "EUR"), (P.currency_of, "$ 3 USDX", "USD"),
        (P.population, "The total population: 47.6 million people, as the last census has it", 47_600_000), (P.population, "There were 47,564,296 persons in the country at that time", 47_564_296), (P.population, "population: 47.6 million", None), (P.population, "population: 5.1 million people, and then some more in the far north", None),
        (P.gdp, "GDP: KSh 12.5 trillion", 1.25e13), (P.gdp, "Gross domestic product of Ksh 9,870 billion", 9.87e12), (P.gdp, "GDP was 3 million", None), (P.gdp, "economy expanded to 11.2 tn", 1.12e13),
        (lambda t: P.rate(t, "inflation"), "inflation rate: was 6.5%", 6.5), (lambda t: P.rate(t, "inflation"), "Inflation was 6.5%", 6.5), (lambda t: P.rate(t, "inflation"), "inflation: 80%; CPI inflation of 7.1%", 7.1), (lambda t: P.rate(t, "unemployment"), "12.5% unemployment", 12.5),
        (lambda t: P.rate(t, "poverty"), "36.1% of the population living below poverty", 36.1), (lambda t: P.rate(t, "poverty"), "poverty\nlevel: 130%", None),
    ],
)
def test_reader(spark, f, text, want):
    assert one(spark, text, f) == want


@pytest.mark.parametrize(("text", "want"), [("FY 2024/25", ("FY2024/25", 2024, 2025, 0.9)), ("2023-2024 FY", ("FY2023/24", 2023, 2024, 0.9)), ("Financial Year 2019/20", ("FY2019/20", 2019, 2020, 0.9)), ("in 1999", ("FY1999/00", 1999, 2000, 0.5)), ("none", None), ("9999", None), ("FY 0000/25, in 2001", None)])
def test_fiscal_period(spark, text, want):
    got = one(spark, text, P.fiscal_period)
    if want is None:
        assert got == []
    else:
        label, a, b, sure = want
        assert [tuple(x) for x in got] == [(label, datetime.date(a, 7, 1), datetime.date(b, 6, 30), sure)]


PAYLOADS = ['{"b":1,"a":{"d":[1,{"z":null,"y":true}],"c":"x"}}', '{"é":"🙂 \\u20ac","A":"\\n\\"/\\\\"}', "[3,1,2]", '"text"', '{"a":[{"b":{},"a":[]}],"B":-1.5}', "{}"]


@pytest.mark.parametrize("text", PAYLOADS)
def test_hash_is_that_of_sorted_json(spark, text):
    want = hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, text, lambda t: J.content_hash(F.try_parse_json(t))) == want


def test_hash_ignores_the_order_of_keys_at_every_level(spark):
    same = ['{"a":{"x":[{"p":1,"q":2}],"y":2},"b":3}', '{ "b": 3, "a": {"y": 2, "x": [ {"q": 2, "p": 1} ]} }']
    other = '{"a":{"x":[{"p":2,"q":1}],"y":2},"b":3}'
    h = [one(spark, t, lambda t: J.content_hash(F.try_parse_json(t))) for t in (*same, other, "{broken", '{"a":1,"a":2}')]
    assert h[0] == h[1] != h[2] and h[3] is None and h[4] is None


META = '{"metrics": {"FY2020/21": {"x": 1.5, "s": "word"}, "FY2024/25": {"x": 7}, "FY2019/20": {}, "FY2018/19": 3}}'


@pytest.mark.parametrize(
    ("meta", "year", "want"),
    [(META, "FY2020/21", 1.5), (META, "FY2019/20", 7.0), (META, "FY2018/19", 7.0), (META, "FY1990/91", 7.0), ('{"metrics": {}}', "FY2020/21", 0.0), ("{}", "FY2020/21", 0.0), ("{broken", "FY2020/21", 0.0), (None, "FY2020/21", 0.0), ("[1]", "FY2020/21", 0.0), (META, None, 7.0)],
)
def test_metric_of_a_year(spark, meta, year, want):
    df = spark.createDataFrame([(meta, year)], "m string, y string").select(J.metrics_of(F.try_parse_json("m"), F.col("y"), F.lit("FY2024/25")).alias("m"))
    assert df.select(J.metric(F.col("m"), "x", F.lit(0.0)).alias("v")).first()["v"] == want


@pytest.mark.parametrize(("a", "b", "want"), [('{"x":1,"y":2}', '{"y":null,"z":[1]}', '{"x":1,"y":null,"z":[1]}'), (None, '{"a":1}', '{"a":1}'), ('{"a":1}', "{bro", '{"a":1}'), ("[1]", None, "{}")])
def test_right_side_wins(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(J.canonical(F.to_variant_object(J.merged(F.try_parse_json("a"), F.try_parse_json("b")))).alias("v")).first()["v"] == want
