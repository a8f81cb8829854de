"""Debt and pending bills: composition, service, risk bands, projections and ageing."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import fy_label, share, to_double
from .budget import d, overall, pct


def zero() -> Column:
    return F.lit(0).cast("decimal(20,4)")

AS_OF = "2001-12-31"


def owed() -> Column:
    """Outstanding, or the principal where that is zero or missing."""
    return F.coalesce(F.nullif("outstanding", F.lit(0)), F.col("principal"))


OWED = "coalesce(nullif(outstanding, 0), principal)"


@query(f"SELECT coalesce(lender, 'Other') AS lender, {d(f'sum({OWED})')} AS owed, count(*) AS loans FROM loans GROUP BY 1")
def debt_by_lender(r: Roles):
    return r.loans.groupBy(F.coalesce("lender", F.lit("Other")).alias("lender")).agg(to_double(F.sum(owed())).alias("owed"), F.count("*").alias("loans"))


@query("SELECT count(DISTINCT debt_category) AS categories, count(DISTINCT coalesce(debt_category, '')) AS with_null FROM loans")
def debt_category_count(r: Roles):
    return r.loans.agg(F.countDistinct("debt_category").alias("categories"), F.countDistinct(F.coalesce("debt_category", F.lit(""))).alias("with_null"))


@query(f"""SELECT debt_category, {d('sum(principal)')} AS principal, {d('coalesce(sum(outstanding), 0)')} AS outstanding, count(*) AS loans, {pct('sum(principal)', 'sum(sum(principal)) OVER ()', 2)} AS share_pct, string_agg(CAST(loan_id AS VARCHAR), ',' ORDER BY loan_id) FILTER (WHERE k <= 5) AS items
    FROM (SELECT *, row_number() OVER (PARTITION BY debt_category ORDER BY loan_id) AS k FROM loans WHERE debt_category IS NOT NULL) GROUP BY 1""")
def debt_categories(r: Roles):
    """The first five items come from the smallest ids by a bounded aggregate, not from a collected group."""
    known = r.loans.where("debt_category is not null")
    w = Window.partitionBy("debt_category").orderBy("loan_id")
    first = known.select("debt_category", "loan_id", F.row_number().over(w).alias("k")).where("k <= 5").groupBy("debt_category").agg(F.concat_ws(",", F.array_sort(F.collect_list("loan_id")).cast("array<string>")).alias("items"))
    s = known.groupBy("debt_category").agg(F.sum("principal").alias("p"), F.sum("outstanding").alias("o"), F.count("*").alias("loans"))
    return s.join(first, "debt_category").select("debt_category", to_double(F.col("p")).alias("principal"), to_double(F.coalesce("o", zero())).alias("outstanding"), "loans", share(F.col("p"), F.sum("p").over(overall()), 2).alias("share_pct"), "items")


@query(f"""SELECT {d("sum(CASE WHEN debt_category LIKE 'EXTERNAL%' THEN principal ELSE 0 END)")} AS external_debt, {d("sum(CASE WHEN debt_category LIKE 'EXTERNAL%' THEN 0 ELSE principal END)")} AS domestic_debt FROM loans""")
def debt_mix(r: Roles):
    ext = F.coalesce(F.col("debt_category").startswith("EXTERNAL"), F.lit(False))
    return r.loans.agg(to_double(F.sum(F.when(ext, F.col("principal")).otherwise(zero()))).alias("external_debt"), to_double(F.sum(F.when(ext, zero()).otherwise(F.col("principal")))).alias("domestic_debt"))


TERM = f"CASE WHEN maturity_date < DATE '{AS_OF}' THEN 'matured' ELSE 'active' END"


@query(f"SELECT loan_id, CAST(principal AS DOUBLE) AS principal, {TERM} AS term FROM loans WHERE debt_category <> 'PENDING_BILLS' ORDER BY principal DESC, loan_id LIMIT 10")
def top_loans(r: Roles):
    """A null category is dropped by the inequality, as in SQL."""
    top = r.loans.where("debt_category <> 'PENDING_BILLS'").orderBy(F.desc("principal"), "loan_id").limit(10)
    return top.select("loan_id", F.col("principal").cast("double").alias("principal"), F.when(F.col("maturity_date") < F.lit(AS_OF).cast("date"), "matured").otherwise("active").alias("term"))


@query(f"SELECT {TERM} AS term, count(*) AS loans, {d('sum(principal)')} AS principal FROM loans GROUP BY 1")
def loan_status(r: Roles):
    term = F.when(F.col("maturity_date") < F.lit(AS_OF).cast("date"), "matured").otherwise("active")
    return r.loans.groupBy(term.alias("term")).agg(F.count("*").alias("loans"), to_double(F.sum("principal")).alias("principal"))


@query("SELECT debt_category, CAST(sum(round(CAST(outstanding AS DECIMAL(14,2)) * interest_rate * 0.01::DECIMAL(3,2), 2)) AS DOUBLE) AS service FROM loans WHERE outstanding IS NOT NULL GROUP BY 1")
def loan_service_cost(r: Roles):
    per = F.round(F.col("outstanding").cast("decimal(14,2)") * F.col("interest_rate") * F.lit("0.01").cast("decimal(3,2)"), 2)
    return r.loans.where("outstanding is not null").groupBy("debt_category").agg(F.sum(per).cast("double").alias("service"))


RATIO = f"""WITH l AS (SELECT entity_id, sum({OWED}) AS debt FROM loans GROUP BY 1), b AS (SELECT entity_id, sum(allocated) AS budget FROM budget_lines GROUP BY 1), x AS (SELECT entity_id, {pct('debt', 'budget', 1)} AS ratio FROM l JOIN b USING (entity_id))"""


@query(RATIO + " SELECT entity_id, ratio, CASE WHEN ratio > 100 THEN 'critical' WHEN ratio > 50 THEN 'high_risk' WHEN ratio > 25 THEN 'moderate' ELSE 'sustainable' END AS risk FROM x")
def debt_risk(r: Roles):
    x = r.loans.groupBy("entity_id").agg(F.sum(owed()).alias("debt")).join(r.execution("entity_id").groupBy("entity_id").agg(F.sum("allocated").alias("budget")), "entity_id").select("entity_id", share(F.col("debt"), F.col("budget"), 1).alias("ratio"))
    return x.withColumn("risk", F.when(F.col("ratio") > 100, "critical").when(F.col("ratio") > 50, "high_risk").when(F.col("ratio") > 25, "moderate").otherwise("sustainable"))


YEARLY = """WITH t AS (SELECT CAST(year(issue_date) AS INTEGER) AS year, sum(CASE WHEN debt_category LIKE 'EXTERNAL%' THEN principal ELSE 0 END) AS ext, sum(principal) AS total FROM loans WHERE year(issue_date) < 2001 GROUP BY 1), g AS (SELECT year, sum(gdp) * 2 AS gdp FROM gdp GROUP BY 1), y AS (SELECT year, ext, total, gdp, round(CAST(total AS DOUBLE) / nullif(CAST(gdp AS DOUBLE), 0) * 100, 1) AS ratio FROM t JOIN g USING (year))"""


def _yearly(r: Roles):
    ext = F.coalesce(F.col("debt_category").startswith("EXTERNAL"), F.lit(False))
    t = r.loans.where(F.year("issue_date") < 2001).groupBy(F.year("issue_date").alias("year")).agg(F.sum(F.when(ext, F.col("principal")).otherwise(zero())).alias("ext"), F.sum("principal").alias("total"))
    g = r.gdp.groupBy("year").agg((F.sum("gdp") * 2).alias("gdp"))
    return t.join(g, "year").withColumn("ratio", share(F.col("total"), F.col("gdp"), 1))


@query(YEARLY + f" SELECT year, {d('ext')} AS external_debt, {d('total - ext')} AS domestic_debt, {d('total')} AS total, ratio FROM y")
def debt_timeline(r: Roles):
    return _yearly(r).select("year", to_double(F.col("ext")).alias("external_debt"), to_double(F.col("total") - F.col("ext")).alias("domestic_debt"), to_double(F.col("total")).alias("total"), "ratio")


@query(YEARLY + f""" SELECT year, ratio, CASE WHEN ratio > 55 THEN 'above' ELSE 'below' END AS imf, CASE WHEN ratio > 50 THEN 'above' ELSE 'below' END AS eac, {pct('ext', 'total', 1)} AS external_share FROM y ORDER BY year DESC LIMIT 1""")
def debt_sustainability(r: Roles):
    last = _yearly(r).orderBy(F.desc("year")).limit(1)
    return last.select("year", "ratio", F.when(F.col("ratio") > 55, "above").otherwise("below").alias("imf"), F.when(F.col("ratio") > 50, "above").otherwise("below").alias("eac"), share(F.col("ext"), F.col("total"), 1).alias("external_share"))


@query(YEARLY + """ , f AS (SELECT regr_slope(CAST(total AS DOUBLE) / 1e6, year) AS slope, avg(CAST(total AS DOUBLE) / 1e6) AS my, avg(year) AS mx, max(year) AS last FROM (SELECT * FROM y ORDER BY year DESC LIMIT 5)) SELECT CAST(last + k AS INTEGER) AS year, round(my + slope * (last + k - mx), 3) AS total_millions FROM f, (SELECT unnest([1, 2, 3, 4, 5]) AS k)""")
def debt_projection(r: Roles):
    """Least squares over the last five years, carried on for five."""
    last = _yearly(r).orderBy(F.desc("year")).limit(5).select("year", (F.col("total").cast("double") / 1e6).alias("v"))
    f = last.agg(F.regr_slope("v", "year").alias("slope"), F.avg("v").alias("my"), F.avg("year").alias("mx"), F.max("year").alias("last"))
    return f.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k")).select((F.col("last") + F.col("k")).alias("year"), F.round(F.col("my") + F.col("slope") * (F.col("last") + F.col("k") - F.col("mx")), 3).alias("total_millions"))


@query(f"SELECT bill_type, {d('sum(amount)')} AS amount, count(*) AS bills FROM bills GROUP BY 1")
def pending_by_type(r: Roles):
    return r.bills.groupBy("bill_type").agg(to_double(F.sum("amount")).alias("amount"), F.count("*").alias("bills"))


AGE = "CASE WHEN coalesce(aging_days, 0) <= 30 THEN '0-30d' WHEN aging_days <= 90 THEN '31-90d' WHEN aging_days <= 180 THEN '91-180d' ELSE '180d+' END"


@query(f"SELECT {AGE} AS age, {d('sum(amount)')} AS amount, count(*) AS bills FROM bills GROUP BY 1")
def pending_aging(r: Roles):
    a = F.coalesce("aging_days", F.lit(0))
    age = F.when(a <= 30, "0-30d").when(a <= 90, "31-90d").when(a <= 180, "91-180d").otherwise("180d+")
    return r.bills.groupBy(age.alias("age")).agg(to_double(F.sum("amount")).alias("amount"), F.count("*").alias("bills"))


@query(f"SELECT printf('FY%d/%02d', fy, (fy + 1) % 100) AS period, {d('sum(amount)')} AS amount, {d('sum(amount - coalesce(ineligible, 0))')} AS eligible FROM bills GROUP BY fy")
def pending_trend(r: Roles):
    s = r.bills.groupBy("fy").agg(F.sum("amount").alias("a"), F.sum(F.col("amount") - F.coalesce("ineligible", zero())).alias("e"))
    return s.select(fy_label(F.col("fy")).alias("period"), to_double(F.col("a")).alias("amount"), to_double(F.col("e")).alias("eligible"))


@query(f"SELECT entity, {d('sum(amount)')} AS amount FROM bills JOIN entities USING (entity_id) GROUP BY entity ORDER BY sum(amount) DESC, entity LIMIT 15")
def pending_top(r: Roles):
    s = r.bills.groupBy("entity_id").agg(F.sum("amount").alias("a")).join(r.entities, "entity_id").orderBy(F.desc("a"), "entity").limit(15)
    return s.select("entity", to_double(F.col("a")).alias("amount"))


@query(f"SELECT entity_id, bill_type, {d('sum(amount)')} AS amount, count(*) AS bills, max(aging_days) AS oldest FROM bills GROUP BY 1, 2")
def pending_by_entity(r: Roles):
    return r.bills.groupBy("entity_id", "bill_type").agg(to_double(F.sum("amount")).alias("amount"), F.count("*").alias("bills"), F.max("aging_days").alias("oldest"))


@query(f"""SELECT {d("sum(CASE WHEN entity_type = 'NATIONAL' THEN amount ELSE 0 END)")} AS national, {d("sum(CASE WHEN entity_type = 'COUNTY' THEN amount ELSE 0 END)")} AS county, {d('sum(amount)')} AS total FROM bills JOIN entities USING (entity_id)""")
def pending_totals(r: Roles):
    j = r.bills.join(r.entities, "entity_id")  # an entity is a row of the 25-row nation table
    return j.agg(to_double(F.sum(F.when(F.col("entity_type") == "NATIONAL", F.col("amount")).otherwise(zero()))).alias("national"), to_double(F.sum(F.when(F.col("entity_type") == "COUNTY", F.col("amount")).otherwise(zero()))).alias("county"), to_double(F.sum("amount")).alias("total"))


@query("SELECT bill_id, coalesce(entity, 'Unknown') AS entity, bill_type, CAST(amount AS DOUBLE) AS amount FROM bills LEFT JOIN (SELECT * FROM entities WHERE entity_id <> 3) e USING (entity_id) WHERE fy = 2000")
def pending_bills_list(r: Roles):
    known = r.entities.where("entity_id <> 3")
    return r.bills.where("fy = 2000").join(known, "entity_id", "left").select("bill_id", F.coalesce("entity", F.lit("Unknown")).alias("entity"), "bill_type", F.col("amount").cast("double").alias("amount"))


@query(f"""SELECT CASE WHEN lender IN ('BUILDING', 'MACHINERY') THEN 'Suppliers' WHEN lender = 'HOUSEHOLD' THEN 'Statutory' ELSE 'Other' END AS bill_type, '180d+' AS age, {d(f'sum({OWED})')} AS amount FROM loans WHERE debt_category = 'PENDING_BILLS' GROUP BY 1""")
def pending_from_loans(r: Roles):
    kind = F.when(F.col("lender").isin("BUILDING", "MACHINERY"), "Suppliers").when(F.col("lender") == "HOUSEHOLD", "Statutory").otherwise("Other")
    return r.loans.where("debt_category = 'PENDING_BILLS'").groupBy(kind.alias("bill_type")).agg(F.lit("180d+").alias("age"), to_double(F.sum(owed())).alias("amount")).select("bill_type", "age", "amount")


@query(f"SELECT coalesce(entity_type, 'ALL') AS entity_type, coalesce(bill_type, 'ALL') AS bill_type, {d('sum(amount)')} AS amount FROM bills JOIN entities USING (entity_id) GROUP BY ROLLUP (entity_type, bill_type)")
def pending_rollup(r: Roles):
    """Totals at every level in one pass over the facts."""
    j = r.bills.join(r.entities.select("entity_id", "entity_type"), "entity_id")
    s = j.rollup("entity_type", "bill_type").agg(F.sum("amount").alias("a"))
    return s.select(F.coalesce("entity_type", F.lit("ALL")).alias("entity_type"), F.coalesce("bill_type", F.lit("ALL")).alias("bill_type"), to_double(F.col("a")).alias("amount"))
