"""The public-finance tables as views of the driver's star schema.

Each role is a DataFrame function and, for the oracle, the same projection as SQL text.  Money is ``DECIMAL(20,4)`` so
that sums don't depend on order; results leave as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import COUNTIES

MONEY = "decimal(20,4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fy_start(d: Column) -> Column:
    """First calendar year of the fiscal year (July to June) that holds ``d``."""
    return (F.year(d) - F.when(F.month(d) < 7, 1).otherwise(0)).cast("int")


def fy_label(start: Column) -> Column:
    return F.format_string("FY%d/%02d", start, F.pmod(start + 1, F.lit(100)))


def money(c: Column) -> Column:
    return c.cast(MONEY)


def to_double(c: Column, scale: int = 2) -> Column:
    """Money as a double, rounded half up while it is still exact."""
    return F.round(c, scale).cast("double")


def share(part: Column, whole: Column, scale: int, factor: int = 100) -> Column:
    """``part / whole * factor``, null where ``whole`` is 0."""
    return F.round(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * factor, scale)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity"), F.col("r_name").alias("region"),
        F.when(F.col("n_regionkey") == 0, "NATIONAL").otherwise("COUNTY").alias("entity_type"),
    )


def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    ext, start = F.col("l_extendedprice"), fy_start(F.col("l_shipdate"))
    return (
        li.join(s.select("s_suppkey", "s_nationkey"), li["l_suppkey"] == F.col("s_suppkey"))
        .join(p.select("p_partkey", "p_type", "p_brand"), li["l_partkey"] == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.col("s_nationkey").alias("entity_id"), start.alias("fy"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"),
            money(ext).alias("allocated"), money(ext * (1 - F.col("l_discount"))).alias("spent"), money(F.when(F.col("l_linestatus") == "F", ext * (1 - F.col("l_tax")))).alias("committed"),
        )
    )


def execution(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """allocated, spent, committed and lines by any of entity_id, category, subcategory and fy.

    The lines are summed by their foreign keys first, so the dimensions are joined to one row per supplier or part (and
    year) and the fact table itself is never shuffled for a join.  Every line is taken to have its supplier and part.
    """
    need = [c for c, used in (("l_suppkey", {"entity_id"}), ("l_partkey", {"category", "subcategory"})) if used & set(keys)]
    years = ["fy"] if "fy" in keys else []
    ext = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        *need, *([fy_start(F.col("l_shipdate")).alias("fy")] if years else []),
        money(ext).alias("allocated"), money(ext * (1 - F.col("l_discount"))).alias("spent"), money(F.when(F.col("l_linestatus") == "F", ext * (1 - F.col("l_tax")))).alias("committed"), F.lit(1).alias("lines"),
    )
    totals = [F.sum(c).alias(c) for c in ("allocated", "spent", "committed", "lines")]
    out = rows.groupBy(*need, *years).agg(*totals)
    if "l_suppkey" in need:
        s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity_id"))
        out = out.join(s, "l_suppkey")
    if "l_partkey" in need:
        p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"))
        out = out.join(p, "l_partkey")
    return out.groupBy(*keys).agg(*totals) if need else out


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("finding_id"), F.pmod("user_id", F.lit(25)).cast("int").alias("entity_id"), F.when(e % 11 != 0, F.col("event_type")).alias("query_type"),
        F.when(e % 9 != 0, money(F.col("value"))).alias("amount"), (2020 + F.floor((F.dayofmonth("ts") - 1) / 6)).cast("int").alias("audit_year"),
        F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), (e % 3 + 1).cast("int")).alias("severity"),
        F.when(e % 4 == 0, "Resolved").when(e % 4 == 1, "Unresolved").when(e % 4 == 2, "Pending").alias("status"),
        F.when(e % 5 == 0, "Unqualified").when(e % 5 == 1, "Qualified").when(e % 5 == 2, "Adverse").when(e % 5 == 3, "Disclaimer").alias("opinion"),
        F.when(e % 97 == 0, "Recurring").alias("follow_up"), (e % 200).alias("doc_id"), F.col("ts"), F.col("props"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), o["o_custkey"] == F.col("c_custkey")).select(
        k.alias("loan_id"), F.col("c_nationkey").alias("entity_id"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("lender"), money(F.col("o_totalprice")).alias("principal"),
        F.when(F.col("o_orderstatus") == "O", money(F.col("o_totalprice"))).when(F.col("o_orderstatus") == "P", money(F.floor(F.col("o_totalprice") / 2))).when(k % 2 == 0, money(F.lit(0))).alias("outstanding"),
        (k % 12 + 0.5).cast("decimal(5,2)").alias("interest_rate"), F.col("o_orderdate").cast("date").alias("issue_date"), F.add_months(F.col("o_orderdate").cast("date"), ((k % 10 + 1) * 12).cast("int")).alias("maturity_date"),
        F.when(k % 17 != 0, F.element_at(F.array(*(F.lit(x) for x in ("EXTERNAL_MULTILATERAL", "EXTERNAL_BILATERAL", "EXTERNAL_COMMERCIAL", "DOMESTIC_BONDS", "DOMESTIC_BILLS", "PENDING_BILLS"))), (k % 6 + 1).cast("int"))).alias("debt_category"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return o.where("o_orderstatus in ('O', 'P')").join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == F.col("c_custkey")).select(
        k.alias("bill_id"), F.col("c_nationkey").alias("entity_id"), F.col("o_orderpriority").alias("bill_type"), money(F.col("o_totalprice")).alias("amount"), fy_start(d).alias("fy"),
        F.when(k % 7 != 0, F.datediff(F.lit("2001-12-31").cast("date"), d)).alias("aging_days"), F.when(k % 3 == 0, money(F.floor(F.col("o_totalprice") / 4))).alias("ineligible"),
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, year, people, confidence): three years for each entity."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("entity_id")).agg((F.count("*") * 10000).alias("people"))
    years = F.explode(F.array(F.lit(2018), F.lit(2019), F.lit(2021))).alias("year")
    local = c.select("entity_id", "people", years).select("entity_id", "year", (F.col("people") + (F.col("year") - 2018) * (F.col("entity_id") % 5 - 1) * 500).alias("people"), (F.lit(0.5) + F.col("entity_id") % 5 * 0.1).alias("confidence"))
    return local


def gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, year, quarter null for annual, gdp)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    q = F.when(F.quarter("o_orderdate") < 4, F.quarter("o_orderdate")).cast("int")
    return o.join(c.select("c_custkey", "c_nationkey"), o["o_custkey"] == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("entity_id"), F.year("o_orderdate").alias("year"), q.alias("quarter")).agg(F.sum(money(F.col("o_totalprice"))).alias("gdp"))


#: Sentences of the remarks; {n} and {g} are an amount, plain and grouped, {y} and {z} a year and the next one's last two
#: digits, {m} a month, {d} a day, {s} seconds since 1970, {c} an entity name, {p} a number of percent.
REMARKS = (
    "KES {g} million was an unsupported payment of {c}", "Ksh. {p}.5 billion irregular expenditure in FY{y}/{z}", "KES {g}", "no amount in {y}/{y}", "KES {p}.5B", "KES {n}M", "{p}%", "N/A", "({g}.5)", "−{n}", "{p},5", "{g}", "{y}-Q3", "{y}-{m}", "{y}", "{d}", "{s}", "{d}T08:30:00",
    "{c} City County", "{c} county", "{c}", "Health & Sanitation of {c}", "Disclaimer of Opinion for {c}", "an adverse opinion was issued for {y}", "Unqualified opinion on {c}", "Qualified opinion, KES {n} unaccounted", "fraud in the procurement process of tender {n}", "late submission of the payroll of {c}", "stalled project, contrary to the plan of {y}",
    "World Bank IDA", "Government of China", "Treasury Bond {y}", "Eurobond {y}", "Audit Report {y}", "Budget Estimates {y}/{z}", "Debt review", "", "USD {p} million grant", "KSh. {n} thousand", "about {g} items", "{p}.5B KES", "{p}M KES owed", "7 KES", "pending of {p}.5 due", "arrears of {g} in total", "a sum of {p} million shillings",
    "inflation rose to {p}.3%", "unemployment stood at {p}.7 per cent", "Finding.\nManagement response: we will pay {n}\nNEXT SECTION\nmore", "Management Response: noted in {y}", "Audit of {c} City", "County of Kisumu and {c}", "weak controls over the cash book", "bank reconciliation of {c} below target", "ghost worker in {c}", "missing asset, idle assets worth {g}", "own-source revenue of {p}", "nil", "Kshs {n}", "-",
    "Finding.\nThe accounts of {c} for {y}", "Central Bank overdraft", "Treasury Bill, 91-day, of {y}", "salary arrears of {c}", "pension dues of {n}", "court award of KES {n}", "Kwale County", "MURANG'A county", "Nairobbi", "Ministry of Helth", "treasury", "kenha", "Recommendation: recover {n} from the officers",
    "Auditor's opinion. In our view the accounts of {c} for the year {y} give a qualified picture: KES {n} was paid without vouchers, the register of assets was not kept, the balances of the banks could not be traced to the cash book, and bills of {p} days were left out.",
    "Opinion: as in {y}.", "Audit opinion. The accounts of {c} for the year {y} were laid before us late; KES {n} was paid without vouchers, the register of assets was not kept, balances of the banks could not be traced to the cash book, and more bills of {p} days were left out. Adverse.",
)


#: Statements of a statistics office, some with figures that no country has.
SURVEYS = (
    "Total population: {p}.6 million people were counted in the census of {y}", "A population of {p},564,296 persons was enumerated, as the bureau says", "The population was estimated at {p}.2 in mn at the end of {m} {y}, says the bureau", "census: total: {p},123,456 households and all", "population: {p}.5 million", "Some {p}.4 million people live in the counties that the survey of {y} reached\nin all",
    "GDP: KSh {p}.5 trillion in current prices", "Gross domestic product of Ksh. {g} billion", "GDP stood at KSh. {g}.25 million; the economy grew by {p}.1%", "GDP of {p}00 billion", "The economy expanded to KSh {p}.25 tn in {y}", "GDP growth: rate of {p}.9%", "growth of {p} per cent", "real GDP growth: {p}.4%", "GDP was {p},500,000,000,000",
    "inflation: rate: was {p}.3%", "overall inflation averaged {p}.7%", "CPI inflation of {p}.1%", "Consumer price index {p}.0%", "inflation rose to {p}.3%", "unemployment rate: stood at {p}.7%", "unemployment was at {p}%", "{p}.5% unemployment", "poverty rate: is {p}.2%", "{p}% of the population living below poverty", "{p}.1% live in poverty", "poverty incidence {p}.6%", "no figures", "",
)


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t): a statement of a statistics office for every order."""
    return filled(spark, sf_dir, SURVEYS)


def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t): a remark in words on every order, with its amount, dates and an entity name."""
    return filled(spark, sf_dir, REMARKS)


def filled(spark: SparkSession, sf_dir: str, sentences: tuple[str, ...]) -> DataFrame:
    """One of the sentences for every order, with the order's values in its places."""
    o, n, day = table(spark, sf_dir, "orders"), F.floor("o_totalprice").cast("bigint"), F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    text = pick(sentences, k)
    grouped = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))
    values = {
        "n": n.cast("string"), "g": grouped, "y": F.date_format(day, "yyyy"), "z": F.lpad(F.pmod(F.year(day) + 1, F.lit(100)).cast("string"), 2, "0"), "m": F.date_format(day, "MM"), "d": F.date_format(day, "yyyy-MM-dd"),
        "s": F.unix_seconds(day.cast("timestamp")).cast("string"), "c": pick(COUNTIES, F.col("o_custkey")), "p": (n % 60 + 1).cast("string"),
    }
    for name, v in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), v)
    return o.select(k.alias("k"), text.alias("t"))


ROLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (entities, budget_lines, findings, loans, bills, population, gdp, remarks, surveys)}

FY = "CAST(year({0}) - CASE WHEN month({0}) < 7 THEN 1 ELSE 0 END AS INTEGER)"
ROLE_SQL = {
    "entities": "SELECT n_nationkey AS entity_id, n_name AS entity, r_name AS region, CASE WHEN n_regionkey = 0 THEN 'NATIONAL' ELSE 'COUNTY' END AS entity_type FROM nation JOIN region ON n_regionkey = r_regionkey",
    "budget_lines": f"""SELECT l_orderkey * 10 + l_linenumber AS line_id, s_nationkey AS entity_id, {FY.format("l_shipdate")} AS fy, p_type AS category, p_brand AS subcategory,
        CAST(l_extendedprice AS DECIMAL(20,4)) AS allocated, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,4)) AS spent,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice * (1 - l_tax) AS DECIMAL(20,4)) END AS committed
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "findings": """SELECT event_id AS finding_id, CAST(user_id % 25 AS INTEGER) AS entity_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS query_type,
        CASE WHEN event_id % 9 <> 0 THEN CAST(value AS DECIMAL(20,4)) END AS amount, CAST(2020 + floor((day(ts) - 1) / 6) AS INTEGER) AS audit_year,
        CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity,
        CASE event_id % 4 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Unresolved' WHEN 2 THEN 'Pending' END AS status,
        CASE event_id % 5 WHEN 0 THEN 'Unqualified' WHEN 1 THEN 'Qualified' WHEN 2 THEN 'Adverse' WHEN 3 THEN 'Disclaimer' END AS opinion,
        CASE WHEN event_id % 97 = 0 THEN 'Recurring' END AS follow_up, event_id % 200 AS doc_id, ts, props FROM events""",
    "loans": """SELECT o_orderkey AS loan_id, c_nationkey AS entity_id, CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS lender, CAST(o_totalprice AS DECIMAL(20,4)) AS principal,
        CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(20,4)) WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice / 2) AS DECIMAL(20,4)) WHEN o_orderkey % 2 = 0 THEN CAST(0 AS DECIMAL(20,4)) END AS outstanding,
        CAST(o_orderkey % 12 + 0.5 AS DECIMAL(5,2)) AS interest_rate, CAST(o_orderdate AS DATE) AS issue_date, CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 10 + 1 AS INTEGER)) AS DATE) AS maturity_date,
        CASE WHEN o_orderkey % 17 <> 0 THEN ['EXTERNAL_MULTILATERAL', 'EXTERNAL_BILATERAL', 'EXTERNAL_COMMERCIAL', 'DOMESTIC_BONDS', 'DOMESTIC_BILLS', 'PENDING_BILLS'][CAST(o_orderkey % 6 + 1 AS INTEGER)] END AS debt_category
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "bills": f"""SELECT o_orderkey AS bill_id, c_nationkey AS entity_id, o_orderpriority AS bill_type, CAST(o_totalprice AS DECIMAL(20,4)) AS amount, {FY.format("o_orderdate")} AS fy,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) END AS aging_days, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 4) AS DECIMAL(20,4)) END AS ineligible
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P')""",
    "population": """SELECT entity_id, year, people + (year - 2018) * (entity_id % 5 - 1) * 500 AS people, 0.5::DOUBLE + entity_id % 5 * 0.1::DOUBLE AS confidence
        FROM (SELECT c_nationkey AS entity_id, count(*) * 10000 AS people FROM customer GROUP BY 1) CROSS JOIN (SELECT unnest([2018, 2019, 2021]) AS year)""",
    "gdp": """SELECT c_nationkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN quarter(o_orderdate) < 4 THEN CAST(quarter(o_orderdate) AS INTEGER) END AS quarter, sum(CAST(o_totalprice AS DECIMAL(20,4))) AS gdp
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
}


def _quoted(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in values) + "]"


def _filled_sql(sentences: tuple[str, ...]) -> str:
    n, day = "CAST(floor(o_totalprice) AS BIGINT)", "CAST(o_orderdate AS DATE)"
    text = f"{_quoted(sentences)}[CAST(o_orderkey % {len(sentences)} + 1 AS INTEGER)]"
    values = {
        "n": f"CAST({n} AS VARCHAR)", "g": f"CASE WHEN {n} >= 1000 THEN CAST({n} // 1000 AS VARCHAR) || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END",
        "y": f"strftime({day}, '%Y')", "z": f"lpad(CAST((year({day}) + 1) % 100 AS VARCHAR), 2, '0')", "m": f"strftime({day}, '%m')", "d": f"strftime({day}, '%Y-%m-%d')",
        "s": f"CAST(CAST(epoch({day}) AS BIGINT) AS VARCHAR)", "c": f"{_quoted(COUNTIES)}[CAST(o_custkey % {len(COUNTIES)} + 1 AS INTEGER)]", "p": f"CAST({n} % 60 + 1 AS VARCHAR)",
    }
    for name, v in values.items():
        text = f"replace({text}, '{{{name}}}', {v})"
    return f"SELECT o_orderkey AS k, {text} AS t FROM orders"


ROLE_SQL["remarks"], ROLE_SQL["surveys"] = _filled_sql(REMARKS), _filled_sql(SURVEYS)


def with_roles(sql: str) -> str:
    """Prefix ``sql`` with the roles it names."""
    import re

    used = [r for r in ROLE_SQL if re.search(rf"\b(?:FROM|JOIN)\s+{r}\b", sql)]
    ctes = [f"{r} AS ({ROLE_SQL[r]})" for r in used]
    if not ctes:
        return sql
    s = sql.lstrip()
    if s[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(ctes)}, {s[15:].lstrip()}"
    return f"WITH {', '.join(ctes)}, {s[4:].lstrip()}" if s[:5].upper() == "WITH " else f"WITH {', '.join(ctes)} {s}"
