"""Population, output and indicators: latest rows, ranges, growth, brackets, pivots and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import to_double
from .budget import d


@query("SELECT entity_id, year, people FROM population QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY year DESC) = 1")
def latest_population(r: Roles):
    """An aggregate instead of a window: the latest row of each key needs no sort."""
    return r.population.groupBy("entity_id").agg(F.max("year").alias("year"), F.max_by("people", "year").alias("people"))


@query(f"SELECT entity_id, year, quarter, {d('gdp')} AS gdp FROM gdp QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY year DESC, quarter DESC NULLS FIRST) = 1")
def latest_gdp(r: Roles):
    """Within a year the annual figure (null quarter) comes first."""
    key = F.struct("year", F.coalesce("quarter", F.lit(9)))
    s = r.gdp.groupBy("entity_id").agg(F.max_by(F.struct("year", "quarter", "gdp"), key).alias("x"))
    return s.select("entity_id", "x.year", "x.quarter", to_double(F.col("x.gdp")).alias("gdp"))


@query("SELECT CAST(sum(people) AS BIGINT) AS people, max(year) AS year FROM population WHERE year = (SELECT max(year) FROM population)")
def population_latest(r: Roles):
    by = r.population.groupBy("year").agg(F.sum("people").alias("people"))
    return by.agg(F.max_by("people", "year").alias("people"), F.max("year").alias("year"))


@query("SELECT entity_id, year, people FROM population WHERE year BETWEEN 2019 AND 2021 AND people >= 1")
def year_range(r: Roles):
    return r.population.where(F.col("year").between(2019, 2021) & (F.col("people") >= 1)).select("entity_id", "year", "people")


@query("SELECT entity_id, year, people FROM population WHERE confidence >= 0.7")
def confidence_filter(r: Roles):
    return r.population.where(F.col("confidence") >= 0.7).select("entity_id", "year", "people")


@query("""WITH g AS (SELECT entity_id, year, people, lag(people) OVER w AS p0, lag(year) OVER w AS y0 FROM population WINDOW w AS (PARTITION BY entity_id ORDER BY year)) SELECT entity_id, round((people - p0) / CAST(p0 AS DOUBLE) / (year - y0) * 100, 3) AS growth FROM g WHERE year = 2021 AND p0 IS NOT NULL""")
def population_growth(r: Roles):
    w = Window.partitionBy("entity_id").orderBy("year")
    g = r.population.withColumns({"p0": F.lag("people").over(w), "y0": F.lag("year").over(w)}).where("year = 2021 and p0 is not null")
    return g.select("entity_id", F.round((F.col("people") - F.col("p0")) / F.col("p0").cast("double") / (F.col("year") - F.col("y0")) * 100, 3).alias("growth"))


@query("SELECT entity_id, CASE WHEN people < 500000 THEN '<500k' WHEN people < 600000 THEN '<600k' WHEN people < 2000000 THEN '<2M' ELSE '2M+' END AS bracket, count(*) OVER (PARTITION BY CASE WHEN people < 500000 THEN 1 WHEN people < 600000 THEN 2 WHEN people < 2000000 THEN 3 ELSE 4 END) - 1 AS peers FROM population WHERE year = 2021")
def population_bracket(r: Roles):
    p = F.col("people")
    x = r.population.where("year = 2021").select("entity_id", F.when(p < 500000, "<500k").when(p < 600000, "<600k").when(p < 2000000, "<2M").otherwise("2M+").alias("bracket"))
    n = x.groupBy("bracket").agg((F.count("*") - 1).alias("peers"))
    return x.join(n, "bracket").select("entity_id", "bracket", "peers")


@query(f"""SELECT (SELECT CAST(sum(people) AS BIGINT) FROM population WHERE year = 2021) AS people, (SELECT {d('sum(gdp)')} FROM gdp WHERE year = 2000) AS gdp, (SELECT count(*) FROM findings) AS findings, (SELECT {d('sum(principal)')} FROM loans) AS debt""")
def economic_summary(r: Roles):
    parts = [r.population.where("year = 2021").agg(F.sum("people").alias("people")), r.gdp.where("year = 2000").agg(to_double(F.sum("gdp")).alias("gdp")), r.findings.agg(F.count("*").alias("findings")), r.loans.agg(to_double(F.sum("principal")).alias("debt"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("""WITH v AS (SELECT CAST(user_id % 50 AS INTEGER) AS country, CAST(day(ts) AS INTEGER) AS year, max(CASE WHEN event_id % 3 <> 0 THEN value END) AS value FROM events GROUP BY 1, 2) SELECT country, max(year) AS year, arg_max(value, year) AS value FROM v WHERE value IS NOT NULL GROUP BY 1""")
def latest_nonnull_by_key(r: Roles):
    v = r.table("events").groupBy(F.pmod("user_id", F.lit(50)).cast("int").alias("country"), F.dayofmonth("ts").alias("year")).agg(F.max(F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("value"))
    return v.where("value is not null").groupBy("country").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))


KINDS = ("click", "view", "purchase")


@query("SELECT CAST(day(ts) AS INTEGER) AS day, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + f" FROM events WHERE event_type IN {KINDS} GROUP BY 1")
def indicator_pivot(r: Roles):
    return r.table("events").where(F.col("event_type").isin(*KINDS)).groupBy(F.dayofmonth("ts").alias("day")).pivot("event_type", list(KINDS)).agg(F.max("value"))


MERGE_SQL = "WITH live AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, max(value) AS value FROM events WHERE day(ts) > 15 GROUP BY 1, 2), base AS (SELECT event_type, CAST(day(ts) AS INTEGER) AS day, min(value) AS value FROM events WHERE day(ts) > 5 GROUP BY 1, 2)"


def _live_base(r: Roles):
    e = r.table("events").withColumn("day", F.dayofmonth("ts"))
    return e.where("day > 15").groupBy("event_type", "day").agg(F.max("value").alias("value")), e.where("day > 5").groupBy("event_type", "day").agg(F.min("value").alias("value"))


@query(MERGE_SQL + " SELECT * FROM live UNION ALL SELECT * FROM base ANTI JOIN live USING (event_type, day)")
def merge_prefer_live(r: Roles):
    live, base = _live_base(r)
    return live.unionByName(base.join(live, ["event_type", "day"], "left_anti"))


@query(MERGE_SQL + " SELECT event_type, day, coalesce(b.value, l.value) AS value FROM base b FULL JOIN live l USING (event_type, day)")
def merge_fill_gaps(r: Roles):
    live, base = _live_base(r)
    return base.withColumnRenamed("value", "b").join(live.withColumnRenamed("value", "l"), ["event_type", "day"], "full").select("event_type", "day", F.coalesce("b", "l").alias("value"))


@query("SELECT entity_id, CAST(floor(people * 4500 * (1 + entity_id % 3 * 0.25::DOUBLE)) AS BIGINT) AS budget FROM population WHERE year = 2021")
def budget_estimate(r: Roles):
    return r.population.where("year = 2021").select("entity_id", F.floor(F.col("people") * 4500 * (1 + F.col("entity_id") % 3 * 0.25)).alias("budget"))


@query("SELECT entity_id, y AS year, round(people * power(1.08::DOUBLE, y - 2021), 2) AS people FROM population, (SELECT unnest([2022, 2023, 2024]) AS y) WHERE year = 2021")
def compound_growth(r: Roles):
    return r.population.where("year = 2021").select("entity_id", "people", F.explode(F.array(*(F.lit(y) for y in (2022, 2023, 2024)))).alias("year")).select("entity_id", "year", F.round(F.col("people") * F.pow(F.lit(1.08), F.col("year") - 2021), 2).alias("people"))


@query("SELECT o_orderkey, round(CASE CAST(o_orderkey % 3 AS INTEGER) WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice * 129.0::DOUBLE ELSE o_totalprice * 140.5::DOUBLE END, 0) AS kes FROM orders")
def fx_convert(r: Roles):
    k, v = F.col("o_orderkey") % 3, F.col("o_totalprice")
    return r.table("orders").select("o_orderkey", F.round(F.when(k == 0, v).when(k == 1, v * 129.0).otherwise(v * 140.5), 0).alias("kes"))


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 5000) AS high, count(*) FILTER (WHERE c_acctbal < 1000) AS low FROM customer GROUP BY 1")
def percapita_flags(r: Roles):
    return r.table("customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("high"), F.count_if(F.col("c_acctbal") < 1000).alias("low"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 2000 AND s_nationkey IN (1, 2, 3, 4, 5) ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def county_search(r: Roles):
    return r.table("supplier").where((F.col("s_acctbal") >= 2000) & F.col("s_nationkey").isin(1, 2, 3, 4, 5)).orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select("s_suppkey", "s_acctbal")


@query("SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS best, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS worst FROM supplier")
def metric_ranks(r: Roles):
    """Ranks in both directions: rows are ranked within ranges of the metric, and ranges by their counts.

    An entity's rows are dealt over its ranges, so 25 entities are not 25 tasks.
    """
    s = r.table("supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 100).alias("range"))
    n = s.groupBy("s_nationkey", "range").agg(F.count("*").alias("n"))
    others = Window.partitionBy("s_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("s_nationkey", "range", *(F.coalesce(F.sum("n").over(others.orderBy(o)), F.lit(0)).alias(name) for name, o in (("above", F.desc("range")), ("below", F.asc("range")))))
    w = Window.partitionBy("s_nationkey", "range")
    best, worst = (F.row_number().over(w.orderBy(o, "s_suppkey")) for o in (F.desc("s_acctbal"), F.asc("s_acctbal")))
    ranked = s.select("s_nationkey", "s_suppkey", "range", best.alias("b"), worst.alias("w")).join(n, ["s_nationkey", "range"])
    return ranked.select("s_nationkey", "s_suppkey", (F.col("b") + F.col("above")).cast("int").alias("best"), (F.col("w") + F.col("below")).cast("int").alias("worst"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 999), c_custkey LIMIT 30")
def flow_table_sort(r: Roles):
    """Missing values sort as a sentinel."""
    v = F.coalesce(F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")), F.lit(999.0))
    return r.table("customer").orderBy(v, "c_custkey").limit(30).select("c_custkey", "c_acctbal")
