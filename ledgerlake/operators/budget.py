"""Budget execution: totals, sectors, utilisation, waterfalls and county roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import fy_label, share, to_double


def overall():
    """The window of all rows; only over results that are already a few rows."""
    return Window.partitionBy()



def sums():
    return F.sum("allocated").alias("allocated"), F.sum("spent").alias("spent")


def d(x: str, n: int = 2) -> str:
    return f"CAST(round({x}, {n}) AS DOUBLE)"


def pct(a: str, b: str, n: int, k: int = 100) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) * {k}, {n})"


def health(u: Column) -> Column:
    """Score of a utilisation in percent: full marks stop at 95, overspending is punished."""
    return F.round(F.when(u <= 95, F.least(u, F.lit(95.0))).when(u <= 100, F.lit(90.0)).otherwise(F.greatest(F.lit(0.0), 80 - (u - 100))), 1)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B+").when(score >= 55, "B").when(score >= 40, "B-").otherwise("C")


HEALTH_SQL = "round(CASE WHEN u <= 95 THEN least(u, 95.0) WHEN u <= 100 THEN 90.0 ELSE greatest(0.0, 80 - (u - 100)) END, 1)"
GRADE_SQL = "CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B+' WHEN score >= 55 THEN 'B' WHEN score >= 40 THEN 'B-' ELSE 'C' END"


@query(f"SELECT {d('sum(allocated)')} AS allocated, {d('sum(spent)')} AS spent, coalesce({pct('sum(spent)', 'sum(allocated)', 1)}, 0) AS execution_rate FROM budget_lines")
def country_summary(r: Roles):
    return r.execution().agg(*sums()).select(to_double(F.col("allocated")).alias("allocated"), to_double(F.col("spent")).alias("spent"), F.coalesce(share(F.col("spent"), F.col("allocated"), 1), F.lit(0.0)).alias("execution_rate"))


@query("SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")
def entity_breakdown(r: Roles):
    return r.entities.groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def doc_counts(r: Roles):
    return r.table("documents").groupBy("source").agg(F.count("*").alias("n"))


@query(f"""SELECT category, {d('sum(allocated)')} AS allocated, {d('sum(spent)')} AS spent, {pct('sum(allocated)', 'sum(sum(allocated)) OVER ()', 1)} AS percentage, {pct('sum(spent)', 'sum(allocated)', 1)} AS utilization FROM budget_lines GROUP BY 1""")
def national_budget_sectors(r: Roles):
    s = r.execution("category").groupBy("category").agg(*sums())
    return s.select("category", to_double(F.col("allocated")).alias("allocated"), to_double(F.col("spent")).alias("spent"), share(F.col("allocated"), F.sum("allocated").over(overall()), 1).alias("percentage"), share(F.col("spent"), F.col("allocated"), 1).alias("utilization"))


@query(f"""SELECT fy, {d("coalesce(sum(allocated) FILTER (WHERE regexp_matches(lower(category), 'large|promo')), 0)")} AS development, {d("coalesce(sum(allocated) FILTER (WHERE NOT regexp_matches(lower(category), 'large|promo')), 0)")} AS recurrent FROM budget_lines GROUP BY 1""")
def dev_recurrent_split(r: Roles):
    dev = F.lower("category").rlike("large|promo")
    zero = F.lit(0).cast("decimal(20,4)")
    return r.execution("fy", "category").groupBy("fy").agg(to_double(F.sum(F.when(dev, F.col("allocated")).otherwise(zero))).alias("development"), to_double(F.sum(F.when(~dev, F.col("allocated")).otherwise(zero))).alias("recurrent"))


SECTORS = (("STANDARD", "Health"), ("SMALL", "Education"), ("MEDIUM", "Education"), ("LARGE", "Infrastructure"), ("ECONOMY", "Agriculture"))


@query(f"""WITH sector AS (SELECT coalesce(CASE split_part(category, ' ', 1) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SECTORS)} END, 'Other') AS sector, allocated, spent FROM budget_lines),
    s AS (SELECT sector, sum(allocated) AS a, sum(spent) AS b FROM sector GROUP BY 1)
    SELECT sector, {d('a')} AS allocated, {pct('b', 'a', 1)} AS execution, {pct('a', 'sum(a) OVER ()', 1)} AS percentage FROM s""")
def budget_overview_sectors(r: Roles):
    names = F.create_map(*(F.lit(x) for pair in SECTORS for x in pair))
    s = r.execution("category").groupBy(F.coalesce(names[F.substring_index("category", " ", 1)], F.lit("Other")).alias("sector")).agg(*sums())
    return s.select("sector", to_double(F.col("allocated")).alias("allocated"), share(F.col("spent"), F.col("allocated"), 1).alias("execution"), share(F.col("allocated"), F.sum("allocated").over(overall()), 1).alias("percentage"))


@query(f"""SELECT category, {d('sum(committed)')} AS committed, {d('sum(allocated) - sum(spent)')} AS unspent, {pct('sum(spent)', 'sum(allocated)', 1)} AS rate FROM budget_lines WHERE committed IS NOT NULL AND allocated > 0 GROUP BY 1""")
def execution_by_sector(r: Roles):
    s = r.budget_lines.where("committed is not null and allocated > 0").groupBy("category").agg(F.sum("committed").alias("committed"), *sums())
    return s.select("category", to_double(F.col("committed")).alias("committed"), to_double(F.col("allocated") - F.col("spent")).alias("unspent"), share(F.col("spent"), F.col("allocated"), 1).alias("rate"))


def _utilisation(r: Roles):
    s = r.execution("entity_id").groupBy("entity_id").agg(*sums()).join(r.entities, "entity_id")
    return s.select("entity", "region", to_double(F.col("allocated")).alias("allocated"), to_double(F.col("allocated") - F.col("spent")).alias("variance"), share(F.col("spent"), F.col("allocated"), 1).alias("utilization"))


UTIL_SQL = f"SELECT entity, region, {d('sum(allocated)')} AS allocated, {d('sum(allocated) - sum(spent)')} AS variance, {pct('sum(spent)', 'sum(allocated)', 1)} AS utilization FROM budget_lines JOIN entities USING (entity_id) GROUP BY entity, region"


@query(UTIL_SQL)
def budget_utilization(r: Roles):
    return _utilisation(r)


@query(f"""WITH u AS ({UTIL_SQL}), k AS (SELECT *, row_number() OVER (ORDER BY utilization DESC, entity) AS top, row_number() OVER (ORDER BY utilization, entity) AS bottom, count(*) OVER () AS n, round(avg(utilization) OVER (), 1) AS mean FROM u)
    SELECT CASE WHEN top <= 5 THEN 'top' ELSE 'bottom' END AS side, entity, utilization, mean FROM k WHERE top <= 5 OR (bottom <= 5 AND n >= 5)""")
def utilization_extremes(r: Roles):
    u = _utilisation(r)
    n = u.agg(F.count("*").alias("n"), F.round(F.avg("utilization"), 1).alias("mean"))
    top = u.orderBy(F.desc("utilization"), "entity").limit(5).withColumn("side", F.lit("top"))
    low = u.orderBy("utilization", "entity").limit(5).join(top.select("entity"), "entity", "left_anti").withColumn("side", F.lit("bottom"))
    return top.unionByName(low.join(F.broadcast(n), F.col("n") >= 5, "left_semi")).crossJoin(F.broadcast(n)).select("side", "entity", "utilization", "mean")


@query(f"""WITH s AS (SELECT fy, category, sum(spent) AS v FROM budget_lines GROUP BY 1, 2)
    SELECT fy, category, {d('v')} AS amount, {pct('v', 'sum(v) OVER (PARTITION BY fy)', 1)} AS share_pct, round(CAST(v - lag(v) OVER (PARTITION BY category ORDER BY fy) AS DOUBLE) / nullif(CAST(lag(v) OVER (PARTITION BY category ORDER BY fy) AS DOUBLE), 0) * 100, 1) AS yoy_pct FROM s""")
def revenue_by_source(r: Roles):
    s = r.execution("fy", "category").groupBy("fy", "category").agg(F.sum("spent").alias("v"))
    before = F.lag("v").over(Window.partitionBy("category").orderBy("fy"))
    return s.select("fy", "category", to_double(F.col("v")).alias("amount"), share(F.col("v"), F.sum("v").over(Window.partitionBy("fy")), 1).alias("share_pct"), share(F.col("v") - before, before, 1).alias("yoy_pct"))


@query(f"""SELECT category, {d("coalesce(sum(spent) FILTER (WHERE fy = 1996), 0)")} AS fy1996, {d("coalesce(sum(spent) FILTER (WHERE fy = 1997), 0)")} AS fy1997, {d("coalesce(sum(spent) FILTER (WHERE fy = 1998), 0)")} AS fy1998 FROM budget_lines WHERE fy IN (1996, 1997, 1998) GROUP BY 1""")
def revenue_pivot(r: Roles):
    p = r.execution("category", "fy").where(F.col("fy").isin(1996, 1997, 1998)).groupBy("category").pivot("fy", [1996, 1997, 1998]).agg(F.sum("spent"))
    return p.select("category", *(to_double(F.coalesce(F.col(f"{y}"), F.lit(0).cast("decimal(20,4)"))).alias(f"fy{y}") for y in (1996, 1997, 1998)))


@query(f"""WITH b AS (SELECT sum(allocated) AS a, sum(spent) AS s FROM budget_lines), g AS (SELECT sum(gdp) AS g FROM gdp), p AS (SELECT sum(people) AS p FROM population WHERE year = 2021)
    SELECT {pct('a', 'g', 2)} AS budget_to_gdp, {pct('s', 'g', 2)} AS revenue_to_gdp, round(CAST(a AS DOUBLE) / CAST(p AS DOUBLE), 0) AS per_capita FROM b, g, p""")
def economic_context(r: Roles):
    one = r.execution().agg(F.sum("allocated").alias("a"), F.sum("spent").alias("s")).crossJoin(r.gdp.agg(F.sum("gdp").alias("g"))).crossJoin(r.population.where("year = 2021").agg(F.sum("people").alias("p")))
    return one.select(share(F.col("a"), F.col("g"), 2).alias("budget_to_gdp"), share(F.col("s"), F.col("g"), 2).alias("revenue_to_gdp"), F.round(F.col("a").cast("double") / F.col("p").cast("double"), 0).alias("per_capita"))


@query(f"""SELECT entity_id, printf('FY%d/%02d', fy, (fy + 1) % 100) AS period, {d('sum(allocated)')} AS allocated, {d('sum(spent)')} AS spent, count(*) AS lines FROM budget_lines GROUP BY entity_id, fy""")
def entity_time_series(r: Roles):
    return r.execution("entity_id", "fy").groupBy("entity_id", "fy").agg(*sums(), F.sum("lines").alias("lines")).select("entity_id", fy_label(F.col("fy")).alias("period"), to_double(F.col("allocated")).alias("allocated"), to_double(F.col("spent")).alias("spent"), "lines")


@query(f"""SELECT printf('FY%d/%02d', fy, (fy + 1) % 100) AS period, {d('sum(allocated)')} AS revenue, {d('sum(spent)')} AS expenditure, {d('sum(allocated) - sum(spent)')} AS balance FROM budget_lines GROUP BY fy ORDER BY period DESC LIMIT 8""")
def fiscal_outturns(r: Roles):
    s = r.execution("fy").groupBy("fy").agg(*sums()).withColumn("period", fy_label(F.col("fy"))).orderBy(F.desc("period")).limit(8)
    return s.select("period", to_double(F.col("allocated")).alias("revenue"), to_double(F.col("spent")).alias("expenditure"), to_double(F.col("allocated") - F.col("spent")).alias("balance"))


@query(f"""SELECT replace(lower(category), ' ', '_') AS key, {pct('sum(allocated)', 'sum(sum(allocated)) OVER ()', 2)} AS ceiling FROM budget_lines GROUP BY category""")
def sector_ceilings(r: Roles):
    s = r.execution("category").groupBy("category").agg(F.sum("allocated").alias("a"))
    return s.select(F.replace(F.lower("category"), F.lit(" "), F.lit("_")).alias("key"), share(F.col("a"), F.sum("a").over(overall()), 2).alias("ceiling"))


@query("SELECT line_id, category, CAST(allocated AS DOUBLE) AS allocated, count(*) OVER () AS total FROM budget_lines WHERE entity_id = 3 AND fy = 1997 ORDER BY allocated DESC, line_id LIMIT 20 OFFSET 20")
def budget_lines_page(r: Roles):
    f = r.budget_lines.where("entity_id = 3 and fy = 1997")
    page = f.select("line_id", "category", F.col("allocated").cast("double").alias("allocated")).orderBy(F.desc("allocated"), "line_id").offset(20).limit(20)
    return page.crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))


WATERFALL = f"""WITH b AS (SELECT entity_id, sum(allocated) AS a, sum(spent) AS s, sum(committed) AS c FROM budget_lines WHERE fy = 1997 GROUP BY 1), f AS (SELECT entity_id, nullif(sum(amount), 0) AS fl FROM findings WHERE audit_year = 2022 GROUP BY 1)"""


def _flow(r: Roles):
    b = r.execution("entity_id", "fy").where("fy = 1997").groupBy("entity_id").agg(F.sum("allocated").alias("a"), F.sum("spent").alias("s"), F.sum("committed").alias("c"))
    f = r.findings.where("audit_year = 2022").groupBy("entity_id").agg(F.nullif(F.sum("amount"), F.lit(0)).alias("fl"))
    return r.entities.select("entity_id", "entity").join(b, "entity_id", "left").join(f, "entity_id", "left")


@query(WATERFALL + f""" SELECT entity, {d('a')} AS allocated, {d('c')} AS released, {d('s')} AS spent, {d('fl')} AS flagged, {d('a - c')} AS gap_released, {d('coalesce(c, a) - s')} AS gap_spent, {pct('s', 'a', 2)} AS efficiency FROM entities LEFT JOIN b USING (entity_id) LEFT JOIN f USING (entity_id) WHERE a IS NOT NULL""")
def money_flow_entity(r: Roles):
    """Stages for entities with budget lines in the period; released stays null when no line is committed."""
    return _flow(r).where("a is not null").select("entity", to_double(F.col("a")).alias("allocated"), to_double(F.col("c")).alias("released"), to_double(F.col("s")).alias("spent"), to_double(F.col("fl")).alias("flagged"), to_double(F.col("a") - F.col("c")).alias("gap_released"), to_double(F.coalesce("c", "a") - F.col("s")).alias("gap_spent"), share(F.col("s"), F.col("a"), 2).alias("efficiency"))


@query(WATERFALL + f""" SELECT entity, {d('nullif(a, 0)')} AS allocated, {d('nullif(c, 0)')} AS released, {d('nullif(s, 0)')} AS spent, {d('fl')} AS flagged FROM entities LEFT JOIN b USING (entity_id) LEFT JOIN f USING (entity_id)""")
def money_flow_batch(r: Roles):
    """All entities, with or without rows; a sum of zero counts as unavailable."""
    z = F.lit(0)
    return _flow(r).select("entity", *(to_double(F.nullif(F.col(c), z)).alias(n) for c, n in (("a", "allocated"), ("c", "released"), ("s", "spent"))), to_double(F.col("fl")).alias("flagged"))


@query(WATERFALL + f""" , n AS (SELECT sum(a) AS a, sum(c) AS c, sum(s) AS s, (SELECT sum(fl) FROM f) AS fl FROM b),
    st AS (SELECT 1 AS ord, 'Allocated' AS stage, a AS v FROM n UNION ALL SELECT 2, 'Released', c FROM n UNION ALL SELECT 3, 'Spent', s FROM n UNION ALL SELECT 4, 'Flagged', fl FROM n)
    SELECT stage, {d('v')} AS amount, {d('lag(v IGNORE NULLS) OVER (ORDER BY ord) - v')} AS gap FROM st""")
def money_flow_national(r: Roles):
    n = _flow(r).agg(*(F.sum(c).alias(c) for c in ("a", "c", "s", "fl")))
    st = n.select(F.expr("stack(4, 1, 'Allocated', a, 2, 'Released', c, 3, 'Spent', s, 4, 'Flagged', fl) as (ord, stage, v)"))
    before = F.last("v", ignorenulls=True).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))  # four rows
    return st.select("stage", to_double(F.col("v")).alias("amount"), to_double(before - F.col("v")).alias("gap"))


@query(f"""WITH b AS (SELECT entity_id, sum(allocated) AS a, sum(spent) AS s FROM budget_lines GROUP BY 1), x AS (SELECT entity_id, sum(amount) AS flagged, count(*) AS findings FROM findings GROUP BY 1), l AS (SELECT entity_id, sum(coalesce(nullif(outstanding, 0), principal)) AS debt FROM loans GROUP BY 1), p AS (SELECT entity_id, arg_max(people, year) AS people FROM population GROUP BY 1),
    j AS (SELECT entity, region, a, s, flagged, findings, debt, people, {pct('s', 'a', 1)} AS u FROM entities LEFT JOIN b USING (entity_id) LEFT JOIN x USING (entity_id) LEFT JOIN l USING (entity_id) LEFT JOIN p USING (entity_id))
    SELECT entity, region, {d('a')} AS allocated, {d('s')} AS spent, {d('flagged')} AS flagged, coalesce(findings, 0) AS findings, {d('debt')} AS debt, people, u AS utilization, {HEALTH_SQL} AS health, round(CAST(a AS DOUBLE) / people, 2) AS per_capita FROM j""")
def county_rollup(r: Roles):
    """Each fact is aggregated by entity on its own, then joined to the entities: no fact meets another row by row."""
    b = r.execution("entity_id").groupBy("entity_id").agg(F.sum("allocated").alias("a"), F.sum("spent").alias("s"))
    x = r.findings.groupBy("entity_id").agg(F.sum("amount").alias("flagged"), F.count("*").alias("findings"))
    debt = r.loans.groupBy("entity_id").agg(F.sum(F.coalesce(F.nullif("outstanding", F.lit(0)), F.col("principal"))).alias("debt"))
    p = r.population.groupBy("entity_id").agg(F.max_by("people", "year").alias("people"))
    j = r.entities.join(b, "entity_id", "left").join(x, "entity_id", "left").join(debt, "entity_id", "left").join(p, "entity_id", "left").withColumn("u", share(F.col("s"), F.col("a"), 1))
    return j.select("entity", "region", to_double(F.col("a")).alias("allocated"), to_double(F.col("s")).alias("spent"), to_double(F.col("flagged")).alias("flagged"), F.coalesce("findings", F.lit(0)).alias("findings"), to_double(F.col("debt")).alias("debt"), "people", F.col("u").alias("utilization"), health(F.col("u")).alias("health"), F.round(F.col("a").cast("double") / F.col("people"), 2).alias("per_capita"))


@query(f"""WITH b AS (SELECT entity_id, fy, {pct('sum(spent)', 'sum(allocated)', 1)} AS u FROM budget_lines GROUP BY 1, 2), h AS (SELECT entity_id, fy, u, {HEALTH_SQL} AS score FROM b) SELECT entity_id, fy, score, {GRADE_SQL} AS grade FROM h""")
def health_grade(r: Roles):
    b = r.execution("entity_id", "fy").groupBy("entity_id", "fy").agg(*sums())
    s = b.select("entity_id", "fy", health(share(F.col("spent"), F.col("allocated"), 1)).alias("score"))
    return s.withColumn("grade", grade(F.col("score")))


@query(f"""WITH b AS (SELECT entity_id, sum(allocated) AS a, sum(spent) AS s FROM budget_lines GROUP BY 1), l AS (SELECT entity_id, sum(outstanding) AS o FROM loans GROUP BY 1), p AS (SELECT entity_id, sum(amount) AS p FROM bills GROUP BY 1)
    SELECT entity_id, round(0.4 * least(100.0, CAST(s AS DOUBLE) / CAST(a AS DOUBLE) * 100) + 0.3 * greatest(0.0, 100 - CAST(o AS DOUBLE) / CAST(a AS DOUBLE) * 2) + 0.3 * greatest(0.0, 100 - CAST(p AS DOUBLE) / CAST(a AS DOUBLE) * 3), 1) AS score FROM b JOIN l USING (entity_id) JOIN p USING (entity_id)""")
def weighted_health(r: Roles):
    b = r.execution("entity_id").groupBy("entity_id").agg(F.sum("allocated").cast("double").alias("a"), F.sum("spent").cast("double").alias("s"))
    o = r.loans.groupBy("entity_id").agg(F.sum("outstanding").cast("double").alias("o"))
    p = r.bills.groupBy("entity_id").agg(F.sum("amount").cast("double").alias("p"))
    score = 0.4 * F.least(F.lit(100.0), F.col("s") / F.col("a") * 100) + 0.3 * F.greatest(F.lit(0.0), 100 - F.col("o") / F.col("a") * 2) + 0.3 * F.greatest(F.lit(0.0), 100 - F.col("p") / F.col("a") * 3)
    return b.join(o, "entity_id").join(p, "entity_id").select("entity_id", F.round(score, 1).alias("score"))


@query(f"""WITH e AS (SELECT entity_id, fy, sum(allocated) - sum(committed) AS gap FROM budget_lines GROUP BY 1, 2) SELECT entity_id, {d('sum(greatest(coalesce(gap, 0), 0))')} AS positive_gap, count(gap) AS periods FROM e GROUP BY 1""")
def positive_gap(r: Roles):
    e = r.execution("entity_id", "fy").groupBy("entity_id", "fy").agg((F.sum("allocated") - F.sum("committed")).alias("gap"))
    zero = F.lit(0).cast("decimal(20,4)")
    return e.groupBy("entity_id").agg(to_double(F.sum(F.greatest(F.coalesce("gap", zero), zero))).alias("positive_gap"), F.count("gap").alias("periods"))


@query(f"""WITH k AS (SELECT fy, dense_rank() OVER (ORDER BY fy DESC) AS k, allocated FROM budget_lines) SELECT k, fy, {d('sum(allocated)')} AS allocated FROM k WHERE k <= 2 GROUP BY 1, 2""")
def period_comparison(r: Roles):
    s = r.execution("fy").groupBy("fy").agg(F.sum("allocated").alias("a")).orderBy(F.desc("fy")).limit(2)
    return s.select(F.row_number().over(Window.orderBy(F.desc("fy"))).alias("k"), "fy", to_double(F.col("a")).alias("allocated"))


WEIGHTS = (("Health", "0.35"), ("Education", "0.25"), ("Roads", "0.20"))


@query(f"""WITH t AS (SELECT entity_id, CAST(sum(allocated) AS DECIMAL(20,4)) AS total FROM budget_lines GROUP BY 1), w AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}::DECIMAL(4,2))" for n, x in WEIGHTS)}) v(sector, weight)),
    a AS (SELECT entity_id, sector, CAST(round(total * weight, 2) AS DOUBLE) AS amount, total FROM t CROSS JOIN w)
    SELECT entity_id, sector, amount FROM a UNION ALL SELECT entity_id, 'Other', round(CAST(any_value(total) AS DOUBLE) - sum(amount), 1) FROM a GROUP BY 1""")
def allocate_by_weight(r: Roles):
    """Each total split over fixed weights, and a remainder row for what they leave."""
    w = F.array(*(F.struct(F.lit(n).alias("sector"), F.lit(x).cast("decimal(4,2)").alias("weight")) for n, x in WEIGHTS))
    t = r.execution("entity_id").groupBy("entity_id").agg(F.sum("allocated").cast("decimal(20,4)").alias("total"))
    a = t.select("entity_id", "total", F.explode(w).alias("w")).select("entity_id", "total", "w.sector", F.round(F.col("total") * F.col("w.weight"), 2).cast("double").alias("amount"))
    rest = a.groupBy("entity_id").agg(F.round(F.first("total").cast("double") - F.sum("amount"), 1).alias("amount")).select("entity_id", F.lit("Other").alias("sector"), "amount")
    return a.select("entity_id", "sector", "amount").unionByName(rest)


@query("""WITH p AS (SELECT entity_id, CAST(people AS DOUBLE) AS people FROM population WHERE year = 2021) SELECT entity_id, round(1e9 * (0.5 * people / sum(people) OVER () + 0.5 / count(*) OVER ()), 2) AS amount FROM p""")
def equitable_share(r: Roles):
    p = r.population.where("year = 2021").select("entity_id", F.col("people").cast("double").alias("people"))
    return p.select("entity_id", F.round(1e9 * (0.5 * F.col("people") / F.sum("people").over(overall()) + 0.5 / F.count("*").over(overall())), 2).alias("amount"))


@query("""WITH s AS (SELECT region, count(*) AS counties, sum(allocated) AS a FROM budget_lines JOIN entities USING (entity_id) GROUP BY 1) SELECT region, counties, round(CAST(a AS DOUBLE), 2) AS allocated FROM s""")
def region_summary(r: Roles):
    s = r.execution("entity_id").groupBy("entity_id").agg(F.sum("lines").alias("n"), F.sum("allocated").alias("a")).join(r.entities, "entity_id")
    return s.groupBy("region").agg(F.sum("n").alias("counties"), to_double(F.sum("a")).alias("allocated"))


@query(f"""WITH u AS ({UTIL_SQL}) SELECT (SELECT entity FROM u ORDER BY utilization DESC, entity LIMIT 1) AS best, (SELECT entity FROM u ORDER BY utilization, entity LIMIT 1) AS worst, round(avg(utilization), 2) AS mean, {d('sum(allocated)')} AS total FROM u""")
def best_worst(r: Roles):
    best = F.min(F.struct(-F.col("utilization"), F.col("entity")))
    worst = F.min(F.struct("utilization", "entity"))
    return _utilisation(r).agg(best["entity"].alias("best"), worst["entity"].alias("worst"), F.round(F.avg("utilization"), 2).alias("mean"), to_double(F.sum("allocated")).alias("total"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN nullif(o_totalprice - o_totalprice, 0) END, o_totalprice) AS amount FROM orders")
def falsy_coalesce(r: Roles):
    """``x or y``: zero falls through like null."""
    x = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") - F.col("o_totalprice"))
    return r.table("orders").select("o_orderkey", F.when(F.coalesce(x, F.lit(0.0)) != 0, x).otherwise(F.col("o_totalprice")).alias("amount"))
