"""Entities and fiscal years that are asked for by a column of a table: ids, slugs, codes, parts of names, labels.

What is asked is reduced to its distinct values first, and every kind of match is an equality join, so neither side has to be
small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Roles, query

#: A part of a name is looked up by its first characters, then tested in full.
STEM = 3
#: The key of every year, for labels that no year has.
ANY = "*"


def stems(name: Column) -> Column:
    """The first one to ``STEM`` characters from every place of a name."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(STEM)), lambda n: F.substring(name, i, n)))))


def resolve(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(q, entity_id, kind) of each distinct value ``q`` of ``asked``, null where nothing fits.

    entities: (id, name, code).  The id counts before the slug (the name in small letters), the code and a part of the name in
    any case; of equals the smallest id.  Only what has no key is looked for in names.  Null isn't a value; an empty one fits
    nothing.
    """
    q = asked.select("q").where("q is not null").distinct()
    kind = lambda c, n: F.struct(c.cast("string").alias("q"), F.lit(n).alias("kind"))
    keys = entities.select("id", F.inline(F.array(kind(F.col("id"), 1), kind(F.lower("name"), 2), kind(F.col("code"), 3))))
    first = lambda g: g.agg(F.min(F.struct("kind", "id")).alias("m"))
    exact = first(q.join(keys, "q", "left").groupBy("q"))
    open_ = exact.where("m.kind is null").select("q", F.lower("q").alias("part")).where("part <> ''").withColumn("stem", F.substring("part", 1, STEM))
    names = entities.select("id", F.lower("name").alias("name")).withColumn("stem", F.explode(stems(F.col("name"))))
    parts = first(open_.join(names, "stem").where(F.contains("name", "part")).select("q", F.lit(4).alias("kind"), "id").groupBy("q"))
    found = exact.select("q", F.when(F.col("m.kind").isNotNull(), F.col("m")).alias("e")).join(parts, "q", "left").select("q", F.coalesce("e", "m").alias("m"))
    return found.select("q", F.col("m.id").alias("entity_id"), F.col("m.kind").alias("kind"))


ASKED = """CASE s_suppkey % 7 WHEN 0 THEN CAST(s_nationkey AS VARCHAR) WHEN 1 THEN 'nation_' || s_nationkey WHEN 2 THEN 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
    WHEN 3 THEN 'Tion_' || s_nationkey WHEN 4 THEN 'NATION_' || s_nationkey WHEN 5 THEN 'county ' || s_nationkey ELSE '_' || s_nationkey END"""


@query(f"""WITH q AS (SELECT {ASKED} AS q, count(*) AS suppliers FROM supplier GROUP BY 1),
    c AS (SELECT q, n_nationkey AS id, CASE WHEN q = CAST(n_nationkey AS VARCHAR) THEN 1 WHEN q = lower(n_name) THEN 2 WHEN q = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') THEN 3 WHEN contains(lower(n_name), lower(q)) THEN 4 END AS kind FROM q, nation),
    b AS (SELECT q, min(kind * 1000000 + id) AS m FROM c WHERE kind IS NOT NULL GROUP BY 1)
    SELECT q.q AS asked, suppliers, CAST(m % 1000000 AS INTEGER) AS entity_id, CAST(m // 1000000 AS INTEGER) AS kind FROM q LEFT JOIN b ON b.q = q.q""")
def resolve_suppliers(r: Roles):
    """The entity that each supplier's reference means, in the form that the supplier writes it."""
    asked = r.table("supplier").groupBy(F.expr(ASKED.replace("VARCHAR", "STRING")).alias("q")).agg(F.count("*").alias("suppliers"))
    n = r.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"))
    return asked.join(resolve(asked, n), "q", "left").select(F.col("q").alias("asked"), "suppliers", "entity_id", "kind")


def match_years(asked: DataFrame, years: DataFrame) -> DataFrame:
    """``years`` (fy and more) of each distinct label ``q``: its own year by label or first year; all where none has it."""
    q = asked.select("q").where("q is not null").distinct()
    label = F.format_string("%d/%02d", "fy", (F.col("fy") + 1) % 100)
    keys = years.select("*", F.explode(F.array(label, F.col("fy").cast("string"), F.lit(ANY))).alias("key"))
    known = keys.select(F.col("key").alias("q")).where(F.col("q") != ANY).distinct().withColumn("key", F.col("q"))
    named = q.join(known, "q", "left").select("q", F.coalesce("key", F.lit(ANY)).alias("key"))
    return named.join(keys, "key").drop("key")


LABEL = "CASE WHEN {m} % 3 = 0 THEN CAST({y} AS VARCHAR) WHEN {m} % 3 = 1 THEN {y} || '/' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0') ELSE 'FY ' || {y} END".format(y="year(o_orderdate)", m="month(o_orderdate)")


@query(f"""WITH q AS (SELECT DISTINCT {LABEL} AS q FROM orders WHERE o_orderdate IS NOT NULL), y AS (SELECT fy, count(*) AS lines FROM budget_lines GROUP BY 1),
    m AS (SELECT q, fy, lines, printf('%d/%02d', fy, (fy + 1) % 100) = q OR CAST(fy AS VARCHAR) = q AS hit FROM q, y)
    SELECT q AS asked, fy, lines FROM (SELECT *, bool_or(hit) OVER (PARTITION BY q) AS fits FROM m) WHERE hit OR NOT fits""")
def fy_match_orders(r: Roles):
    """The budget lines of the year that each order's label names; a label that fits no year filters nothing."""
    asked = r.table("orders").where("o_orderdate is not null").select(F.expr(LABEL.replace("VARCHAR", "STRING")).alias("q"))
    per = r.execution("fy").groupBy("fy").agg(F.sum("lines").alias("lines"))
    return match_years(asked, per).select(F.col("q").alias("asked"), "fy", "lines")
