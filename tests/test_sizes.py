"""What plans send to every task, and tables with repeated and missing keys, against DuckDB."""

from __future__ import annotations

import random
import re
from itertools import takewhile

import duckdb
import pytest

from ledgerlake.operators import ORACLE_SQL, QUERIES
from ledgerlake.operators.parsing_more import nearest_names


def sent(df, column):
    """Whether a plan broadcasts rows of a table with ``column``, rather than one row that sums them up."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x[:1] in (" ", ":", "+")]  # not the lines within texts
    depth = lambda x: re.match(r"[ :+\-]*", x).end()
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            under = list(takewhile(lambda y: depth(y) > depth(x), lines[i + 1 :]))
            if any(f"FileScan parquet [{column}#" in y for y in under) and not any("HashAggregate(keys=[]" in y for y in under):
                return True
    return False


def odd_orders(spark, at):
    """Orders of which some have a key that others have, or none."""
    rows = [(None if k % 50 == 0 else k - k % 3 if k % 4 == 0 else k, k * 7 % 100, 900.5 + k * 37, f"199{k % 8}-0{k % 9 + 1}-1{k % 10} 00:00:00") for k in range(1, 1200)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, day string")
    df.selectExpr("o_orderkey", "o_custkey", "'O' AS o_orderstatus", "o_totalprice", "CAST(day AS timestamp_ntz) AS o_orderdate", "'LOW' AS o_orderpriority").write.parquet(f"{at}/orders.parquet")


def same_as_sql(spark, at, name):
    odd_orders(spark, at)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet/*.parquet'")
    got = QUERIES[name](spark, str(at))
    key = lambda r: [(x is not None, str(x)) for x in r]
    clean = lambda rows: sorted((tuple(r) for r in rows), key=key)
    assert clean(got.collect()) == clean(con.sql(ORACLE_SQL[name]).project(", ".join(got.columns)).fetchall())


@pytest.mark.parametrize(("name", "column"), [("entity_mentions", "o_orderkey"), ("document_mentions", "doc_id")])
def test_texts_are_not_sent_to_tasks(spark, sf, name, column):
    """Computed texts look small to the planner: they were broadcast, which took the driver's memory."""
    assert not sent(QUERIES[name](spark, sf), column)


def test_entity_mentions_by_row(spark, tmp_path):
    same_as_sql(spark, tmp_path, "entity_mentions")


def test_mention_coverage(spark, sf, tmp_path):
    assert not sent(QUERIES["mention_coverage"](spark, sf), "o_orderkey")
    same_as_sql(spark, tmp_path, "mention_coverage")


def test_mentions_listed_with_repeated_keys(spark, sf, tmp_path):
    """A key that two orders have lists what both mention, repeats included."""
    assert not sent(QUERIES["mentions_listed"](spark, sf), "o_orderkey")
    same_as_sql(spark, tmp_path, "mentions_listed")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_names(spark, sf, tmp_path):
    """Few pairs have their distance computed, where 116 were for each row; rows of the same key and text give one."""
    plan = QUERIES["normalize_entity_fuzzy"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") <= 3
    same_as_sql(spark, tmp_path, "normalize_entity_fuzzy")


@pytest.mark.parametrize("least", [70, 50])
def test_no_near_name_is_missed(spark, least):
    r = random.Random(least)
    names = [("ab", "Ab", "x"), ("abc", "Abd", "x"), ("a", "B", "y"), ("homa bay", "Homa-Bay County", "y"), ("homabay", "Homa-Bay County", "z"), ("ministry of livestock and fisheries", "Livestock", "z"), ("aaaaaaa", "aaaaaa", "z")]
    texts = ["", "  ", None, "x" * 200, "a", "B", "ab", "HOMA BAY", "−homa bay", "homa🙂bay", "aaaaaaaaaa", "aaaa"]
    for _ in range(300):
        t = list(r.choice(names)[r.randint(0, 1)])
        for _ in range(r.randint(0, len(t) // 2)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randint(0, 1)] = r.choice(["", "a", "y", "7", " ", "É", "b"])
        texts.append("".join(t))
    want = {}
    for k, t in enumerate(texts):
        a = (t or "").strip(" ").lower()
        found = [(-max(round(100 * (1 - distance(a, b) / max(len(a), len(b))), 2) for b in (name.lower(), key)), i, name, kind) for i, (key, name, kind) in enumerate(names)]
        if t is not None and -min(found)[0] > least:
            want[k] = (t, *min(found)[2:], -min(found)[0])
    rows = nearest_names(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), names, least).collect()
    assert {x["k"]: tuple(x)[1:] for x in rows} == want and len(rows) == len(want) > 100
