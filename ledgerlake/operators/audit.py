"""Audit findings: summaries, trends, recurrence, pages and scorecards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import share, to_double
from .budget import d


def zero():
    return F.lit(0).cast("decimal(20,4)")



@query(f"""SELECT count(*) AS total, {d("sum(CASE WHEN query_type = 'error' THEN coalesce(amount, 0) ELSE 0 END)")} AS irregular, {d("sum(CASE WHEN status <> 'Resolved' THEN coalesce(amount, 0) ELSE 0 END)")} AS unresolved, min(audit_year) AS first_year, max(audit_year) AS last_year FROM findings""")
def audit_summary(r: Roles):
    """One pass; a null status is neither resolved nor counted."""
    a = F.coalesce("amount", zero())
    return r.findings.agg(F.count("*").alias("total"), to_double(F.sum(F.when(F.col("query_type") == "error", a).otherwise(zero()))).alias("irregular"), to_double(F.sum(F.when(F.col("status") != "Resolved", a).otherwise(zero()))).alias("unresolved"), F.min("audit_year").alias("first_year"), F.max("audit_year").alias("last_year"))


@query("SELECT query_type, count(*) AS n FROM findings WHERE query_type IS NOT NULL GROUP BY 1")
def findings_by_type(r: Roles):
    return r.findings.where("query_type is not null").groupBy("query_type").agg(F.count("*").alias("n"))


@query("SELECT opinion, count(*) AS n FROM findings WHERE opinion IS NOT NULL GROUP BY 1")
def findings_by_opinion(r: Roles):
    return r.findings.where("opinion is not null").groupBy("opinion").agg(F.count("*").alias("n"))


@query(f"SELECT entity, {d('sum(amount)')} AS amount, count(*) AS findings FROM findings JOIN entities USING (entity_id) WHERE amount IS NOT NULL GROUP BY entity ORDER BY sum(amount) DESC, entity LIMIT 10")
def worst_entities(r: Roles):
    s = r.findings.where("amount is not null").groupBy("entity_id").agg(F.sum("amount").alias("a"), F.count("*").alias("findings")).join(r.entities, "entity_id")
    return s.orderBy(F.desc("a"), "entity").limit(10).select("entity", to_double(F.col("a")).alias("amount"), "findings")


@query("SELECT entity, count(*) AS findings FROM findings JOIN entities USING (entity_id) WHERE severity = 'critical' GROUP BY entity ORDER BY findings DESC, entity LIMIT 5")
def top_flagged(r: Roles):
    s = r.findings.where("severity = 'critical'").groupBy("entity_id").agg(F.count("*").alias("findings")).join(r.entities, "entity_id")
    return s.orderBy(F.desc("findings"), "entity").limit(5).select("entity", "findings")


@query("SELECT count(DISTINCT entity_id) AS entities FROM findings")
def counties_audited(r: Roles):
    return r.findings.agg(F.countDistinct("entity_id").alias("entities"))


@query(f"SELECT audit_year, count(*) AS n, {d('sum(amount)')} AS amount FROM findings GROUP BY 1")
def audit_trends(r: Roles):
    return r.findings.groupBy("audit_year").agg(F.count("*").alias("n"), to_double(F.sum("amount")).alias("amount"))


OPINIONS = ("Unqualified", "Qualified", "Adverse", "Disclaimer")


@query("SELECT audit_year, " + ", ".join(f"count(*) FILTER (WHERE opinion = '{o}') AS {o.lower()}" for o in OPINIONS) + " FROM findings GROUP BY 1")
def opinion_per_year(r: Roles):
    p = r.findings.groupBy("audit_year").pivot("opinion", list(OPINIONS)).count()
    return p.select("audit_year", *(F.coalesce(F.col(o), F.lit(0)).alias(o.lower()) for o in OPINIONS))


@query(f"""WITH keys AS (SELECT entity_id, coalesce(query_type, 'Unknown') AS k FROM findings WHERE follow_up = 'Recurring' UNION SELECT entity_id, query_type FROM findings WHERE query_type IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT audit_year) >= 2)
    SELECT f.entity_id, k AS query_type, count(DISTINCT audit_year) AS years, {d('coalesce(sum(amount), 0)')} AS amount, count(*) AS findings FROM findings f JOIN keys ON f.entity_id = keys.entity_id AND coalesce(f.query_type, 'Unknown') = k GROUP BY 1, 2""")
def recurring_findings(r: Roles):
    """Keys flagged as recurring, or seen in two years; a null type is Unknown only where flagged."""
    f = r.findings
    flagged = f.where("follow_up = 'Recurring'").select("entity_id", F.coalesce("query_type", F.lit("Unknown")).alias("k"))
    twice = f.where("query_type is not null").groupBy("entity_id", F.col("query_type").alias("k")).agg(F.countDistinct("audit_year").alias("y")).where("y >= 2").select("entity_id", "k")
    keys = flagged.union(twice).distinct()
    rows = f.withColumn("k", F.coalesce("query_type", F.lit("Unknown"))).join(keys, ["entity_id", "k"])
    return rows.groupBy("entity_id", F.col("k").alias("query_type")).agg(F.countDistinct("audit_year").alias("years"), to_double(F.coalesce(F.sum("amount"), zero())).alias("amount"), F.count("*").alias("findings"))


@query("""WITH y AS (SELECT DISTINCT query_type, audit_year FROM findings WHERE query_type IS NOT NULL AND entity_id = 4), g AS (SELECT *, audit_year - lag(audit_year) OVER (PARTITION BY query_type ORDER BY audit_year) AS gap FROM y) SELECT query_type, count(*) FILTER (WHERE gap = 1) AS repeats FROM g GROUP BY 1""")
def consecutive_findings(r: Roles):
    y = r.findings.where("query_type is not null and entity_id = 4").select("query_type", "audit_year").distinct()
    gap = F.col("audit_year") - F.lag("audit_year").over(Window.partitionBy("query_type").orderBy("audit_year"))
    return y.withColumn("gap", gap).groupBy("query_type").agg(F.count_if(F.col("gap") == 1).alias("repeats"))


@query("SELECT doc_id, round(avg(0.5::DOUBLE + 0.1 * (finding_id % 5)), 4) AS confidence FROM findings GROUP BY 1")
def doc_confidence(r: Roles):
    return r.findings.groupBy("doc_id").agg(F.round(F.avg(0.5 + 0.1 * (F.col("finding_id") % 5)), 4).alias("confidence"))


ENRICHED = "SELECT finding_id, entity, query_type, severity, audit_year, CAST(amount AS DOUBLE) AS amount, source FROM findings LEFT JOIN (SELECT doc_id, source FROM documents) USING (doc_id) LEFT JOIN entities USING (entity_id)"


def _enriched(r: Roles):
    docs = r.table("documents").select("doc_id", "source")
    return r.findings.join(docs, "doc_id", "left").join(r.entities, "entity_id", "left").select("finding_id", "entity", "query_type", "severity", "audit_year", F.col("amount").cast("double").alias("amount"), "source")


@query(ENRICHED)
def findings_enriched(r: Roles):
    return _enriched(r)


@query(ENRICHED + " WHERE audit_year = 2021 AND severity = 'critical' AND query_type = 'click'")
def findings_filtered(r: Roles):
    given = {"audit_year": 2021, "severity": "critical", "query_type": "click", "entity_id": None}
    f = r.findings
    for name, value in given.items():
        if value is not None:
            f = f.where(F.col(name) == value)
    return f.join(r.table("documents").select("doc_id", "source"), "doc_id", "left").join(r.entities, "entity_id", "left").select("finding_id", "entity", "query_type", "severity", "audit_year", F.col("amount").cast("double").alias("amount"), "source")


@query("SELECT finding_id, severity, CAST(amount AS DOUBLE) AS amount FROM findings ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, amount DESC NULLS LAST, finding_id LIMIT 25 OFFSET 50")
def findings_page(r: Roles):
    order = F.create_map(*(F.lit(x) for p in (("info", 1), ("warning", 2), ("critical", 3)) for x in p))
    return r.findings.orderBy(order[F.col("severity")].desc(), F.col("amount").desc_nulls_last(), "finding_id").offset(50).limit(25).select("finding_id", "severity", F.col("amount").cast("double").alias("amount"))


@query("SELECT severity, count(*) AS n, " + d("coalesce(sum(amount), 0)") + " AS amount FROM findings GROUP BY 1")
def audit_statistics(r: Roles):
    return r.findings.groupBy("severity").agg(F.count("*").alias("n"), to_double(F.coalesce(F.sum("amount"), zero())).alias("amount"))


@query(f"SELECT entity, severity, count(*) AS n, {d('coalesce(sum(amount), 0)')} AS amount FROM findings JOIN entities USING (entity_id) WHERE entity_type = 'NATIONAL' GROUP BY 1, 2")
def federal_audits(r: Roles):
    e = r.entities.where("entity_type = 'NATIONAL'")
    return r.findings.join(e, "entity_id").groupBy("entity", "severity").agg(F.count("*").alias("n"), to_double(F.coalesce(F.sum("amount"), zero())).alias("amount"))


@query("SELECT printf('FY%d/%02d', audit_year, (audit_year + 1) % 100) AS fy, coalesce(status, 'Unknown') AS status, count(*) AS n FROM findings WHERE entity_id = 7 GROUP BY 1, 2")
def audit_history(r: Roles):
    label = F.format_string("FY%d/%02d", "audit_year", (F.col("audit_year") + 1) % 100)
    return r.findings.where("entity_id = 7").groupBy(label.alias("fy"), F.coalesce("status", F.lit("Unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT entity_id, CASE coalesce(max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 END), 0) WHEN 3 THEN 'adverse' WHEN 2 THEN 'qualified' WHEN 1 THEN 'clean' ELSE 'pending' END AS audit_status FROM entities LEFT JOIN findings USING (entity_id) GROUP BY 1")
def audit_status(r: Roles):
    worst = F.coalesce(F.max(F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 1)), F.lit(0))
    s = r.entities.join(r.findings.select("entity_id", "severity"), "entity_id", "left").groupBy("entity_id").agg(worst.alias("w"))
    return s.select("entity_id", F.when(F.col("w") == 3, "adverse").when(F.col("w") == 2, "qualified").when(F.col("w") == 1, "clean").otherwise("pending").alias("audit_status"))


ACCOUNT = """WITH o AS (SELECT entity_id, audit_year, max(CASE opinion WHEN 'Disclaimer' THEN 4 WHEN 'Adverse' THEN 3 WHEN 'Qualified' THEN 2 WHEN 'Unqualified' THEN 1 END) AS op FROM findings GROUP BY 1, 2),
    oo AS (SELECT entity_id, max(op) AS worst, arg_max(op, audit_year) AS latest FROM o GROUP BY 1),
    rec AS (SELECT entity_id, count(*) FILTER (WHERE y >= 2) AS recurring FROM (SELECT entity_id, query_type, count(DISTINCT audit_year) AS y FROM findings WHERE query_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    un AS (SELECT entity_id, count(*) FILTER (WHERE lower(status) IN ('pending', 'unresolved', 'recurring')) AS unresolved, sum(amount) AS flagged FROM findings GROUP BY 1),
    ab AS (SELECT entity_id, round(CAST(sum(spent) AS DOUBLE) / nullif(CAST(sum(allocated) AS DOUBLE), 0), 4) AS absorption FROM budget_lines GROUP BY 1),
    j AS (SELECT entity_id, entity, region, coalesce(worst, 0) AS worst, coalesce(latest, 0) AS latest, coalesce(recurring, 0) AS recurring, coalesce(unresolved, 0) AS unresolved, flagged, absorption FROM entities LEFT JOIN oo USING (entity_id) LEFT JOIN rec USING (entity_id) LEFT JOIN un USING (entity_id) LEFT JOIN ab USING (entity_id)),
    g AS (SELECT *, greatest(0, CASE WHEN worst >= 3 THEN 1 WHEN latest = 2 THEN 2 ELSE 4 END - CASE WHEN recurring > 5 THEN 1 ELSE 0 END - CASE WHEN unresolved > 10 THEN 1 ELSE 0 END - CASE WHEN absorption < 0.5 THEN 1 ELSE 0 END) AS points FROM j)"""


@query(ACCOUNT + f""" SELECT entity, recurring, unresolved, absorption, ['F', 'D', 'C', 'B', 'A'][CAST(points + 1 AS INTEGER)] AS grade, round(CAST(avg(flagged) OVER (PARTITION BY region) AS DOUBLE), 2) AS region_flagged, round(avg(points) OVER (PARTITION BY region), 2) AS region_points FROM g""")
def accountability(r: Roles):
    """Scorecard of each entity with the means of its region."""
    f = r.findings
    rank = F.when(F.col("opinion") == "Disclaimer", 4).when(F.col("opinion") == "Adverse", 3).when(F.col("opinion") == "Qualified", 2).when(F.col("opinion") == "Unqualified", 1)
    op = f.groupBy("entity_id", "audit_year").agg(F.max(rank).alias("op")).groupBy("entity_id").agg(F.max("op").alias("worst"), F.max_by("op", "audit_year").alias("latest"))
    rec = f.where("query_type is not null").groupBy("entity_id", "query_type").agg(F.countDistinct("audit_year").alias("y")).groupBy("entity_id").agg(F.count_if(F.col("y") >= 2).alias("recurring"))
    un = f.groupBy("entity_id").agg(F.count_if(F.lower("status").isin("pending", "unresolved", "recurring")).alias("unresolved"), F.sum("amount").alias("flagged"))
    ab = r.execution("entity_id").groupBy("entity_id").agg(F.sum("spent").alias("s"), F.sum("allocated").alias("a")).select("entity_id", share(F.col("s"), F.col("a"), 4, 1).alias("absorption"))
    j = r.entities
    for x in (op, rec, un, ab):
        j = j.join(x, "entity_id", "left")
    j = j.fillna(0, ["worst", "latest", "recurring", "unresolved"])
    start = F.when(F.col("worst") >= 3, 1).when(F.col("latest") == 2, 2).otherwise(4)
    drops = sum((F.when(c, 1).otherwise(0) for c in (F.col("unresolved") > 10, F.col("absorption") < 0.5)), F.when(F.col("recurring") > 5, 1).otherwise(0))
    g = j.withColumn("points", F.greatest(F.lit(0), start - drops))
    w = Window.partitionBy("region")
    letters = F.array(*(F.lit(x) for x in "FDCBA"))
    return g.select("entity", "recurring", "unresolved", "absorption", F.element_at(letters, F.col("points") + 1).alias("grade"), F.round((F.sum("flagged").over(w).cast("double") / F.count("flagged").over(w)), 2).alias("region_flagged"), F.round(F.avg("points").over(w), 2).alias("region_points"))


@query("""SELECT finding_id, CASE WHEN finding_id % 3 = 0 THEN 'https://audit.example.org/' || finding_id WHEN finding_id % 3 = 1 THEN 'https://files.example.org/ref/' || finding_id ELSE 'doc:' || doc_id END AS url FROM findings""")
def source_url(r: Roles):
    k = F.col("finding_id")
    ref = F.when(k % 3 == 0, F.concat(F.lit("https://audit.example.org/"), k)).when(k % 3 == 1, F.concat(F.lit("ref/"), k))
    return r.findings.select("finding_id", F.when(ref.startswith("http"), ref).when(ref.isNotNull(), F.concat(F.lit("https://files.example.org/"), ref)).otherwise(F.concat(F.lit("doc:"), "doc_id")).alias("url"))


@query("SELECT count(*) AS total, count(amount) AS with_amount, count(query_type) AS with_type, count(status) AS with_status, round(100.0::DOUBLE * count(amount) / count(*), 2) AS amount_pct FROM findings")
def completeness(r: Roles):
    return r.findings.agg(F.count("*").alias("total"), F.count("amount").alias("with_amount"), F.count("query_type").alias("with_type"), F.count("status").alias("with_status"), F.round(100.0 * F.count("amount") / F.count("*"), 2).alias("amount_pct"))


@query("SELECT severity, status, count(*) AS n FROM findings WHERE lower(query_type) = 'purchase' AND lower(severity) IN ('critical', 'warning') GROUP BY 1, 2")
def audit_queries_filter(r: Roles):
    return r.findings.where((F.lower("query_type") == "purchase") & F.lower("severity").isin("critical", "warning")).groupBy("severity", "status").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT finding_id, entity_id, CAST(amount AS DECIMAL(38,4)) AS x FROM findings WHERE amount IS NOT NULL), s AS (SELECT entity_id, count(*) AS n, sum(x) AS s, sum(CAST(x * x AS DECIMAL(38,8))) AS q FROM e GROUP BY 1),
    z AS (SELECT entity_id, n - 1 AS m, CAST(x AS DOUBLE) AS x, CAST(s - x AS DOUBLE) / (n - 1) AS mean, CAST(q - CAST(x * x AS DECIMAL(38,8)) AS DOUBLE) AS q FROM e JOIN s USING (entity_id) WHERE n > 3), v AS (SELECT *, greatest(q - m * mean * mean, 0) / (m - 1) AS var FROM z)
    SELECT entity_id, count(*) AS checked, count(*) FILTER (WHERE CASE WHEN var = 0 THEN x <> mean ELSE abs(x - mean) / sqrt(var) > 3 END) AS outliers FROM v GROUP BY 1""")
def outliers(r: Roles):
    """Amounts over three standard deviations from the mean of the entity's others, of which there must be three.

    One aggregate of the entities' sums serves every row: its own amount is taken out of them.
    """
    x = F.col("amount").cast("decimal(38,4)")
    square = lambda c: (c.cast("decimal(19,4)") * c.cast("decimal(19,4)")).cast("decimal(38,8)")
    e = r.findings.where("amount is not null").select("entity_id", x.alias("x"))
    s = e.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(square(F.col("x"))).alias("q"))
    m, mean = F.col("n") - 1, (F.col("s") - F.col("x")).cast("double") / (F.col("n") - 1)
    z = e.join(s, "entity_id").where("n > 3").select("entity_id", m.alias("m"), mean.alias("mean"), (F.col("q") - square(F.col("x"))).cast("double").alias("q"), F.col("x").cast("double").alias("x"))
    var = F.greatest(F.col("q") - F.col("m") * F.col("mean") * F.col("mean"), F.lit(0.0)) / (F.col("m") - 1)
    far = F.when(var == 0, F.col("x") != F.col("mean")).otherwise(F.abs(F.col("x") - F.col("mean")) / F.sqrt(var) > 3)
    return z.groupBy("entity_id").agg(F.count("*").alias("checked"), F.count_if(far).alias("outliers"))