"""Remaining dashboard questions: roll-ups of files and reports, quality scores, JSON maps, tables and schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import share, to_double
from .budget import d, grade, health, overall, pct, sums


@query(f"SELECT count(*) AS findings, {d('coalesce(sum(amount), 0)')} AS amount, count(*) FILTER (WHERE severity = 'critical') AS high, count(*) FILTER (WHERE status = 'Pending') AS pending, count(DISTINCT entity_id) AS entities FROM findings")
def analytics_summary(r: Roles):
    return r.findings.agg(F.count("*").alias("findings"), to_double(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(20,4)"))).alias("amount"), F.count_if(F.col("severity") == "critical").alias("high"), F.count_if(F.col("status") == "Pending").alias("pending"), F.countDistinct("entity_id").alias("entities"))


@query(f"SELECT region, count(*) AS findings, {d('sum(amount) FILTER (WHERE severity IN (' + chr(39) + 'critical' + chr(39) + ', ' + chr(39) + 'warning' + chr(39) + '))')} AS serious FROM findings JOIN entities USING (entity_id) GROUP BY 1")
def county_statistics(r: Roles):
    serious = F.sum(F.when(F.col("severity").isin("critical", "warning"), F.col("amount")))
    return r.findings.join(r.entities, "entity_id").groupBy("region").agg(F.count("*").alias("findings"), to_double(serious).alias("serious"))


@query(f"WITH s AS (SELECT entity_id, sum(amount) FILTER (WHERE follow_up = 'Recurring') AS missing, sum(amount) AS total FROM findings GROUP BY 1) SELECT {d('sum(missing)')} AS missing, count(*) FILTER (WHERE missing > 0) AS affected, round(avg(CAST(missing AS DOUBLE) / CAST(total AS DOUBLE)), 6) AS mean_ratio FROM s")
def missing_funds_stats(r: Roles):
    s = r.findings.groupBy("entity_id").agg(F.sum(F.when(F.col("follow_up") == "Recurring", F.col("amount"))).alias("missing"), F.sum("amount").alias("total"))
    return s.agg(to_double(F.sum("missing")).alias("missing"), F.count_if(F.col("missing") > 0).alias("affected"), F.round(F.avg(F.col("missing").cast("double") / F.col("total").cast("double")), 6).alias("mean_ratio"))


@query(f"WITH s AS (SELECT entity_id, sum(amount) AS m FROM findings WHERE follow_up = 'Recurring' GROUP BY 1) SELECT entity, {d('m')} AS missing FROM s JOIN entities USING (entity_id) WHERE m > 0 ORDER BY m DESC, entity LIMIT 10")
def missing_funds_analysis(r: Roles):
    s = r.findings.where("follow_up = 'Recurring'").groupBy("entity_id").agg(F.sum("amount").alias("m")).where("m > 0").join(r.entities, "entity_id")
    return s.orderBy(F.desc("m"), "entity").limit(10).select("entity", to_double(F.col("m")).alias("missing"))


@query("SELECT region, CAST(least(100, floor(100.0::DOUBLE * count(*) FILTER (WHERE n > 0) / count(*)) + 5 * count(*) FILTER (WHERE n > 10)) AS BIGINT) AS score FROM (SELECT region, entity_id, count(finding_id) AS n FROM entities LEFT JOIN (SELECT * FROM findings WHERE severity = 'critical' AND audit_year = 2023) f USING (entity_id) GROUP BY 1, 2) GROUP BY 1")
def transparency_score(r: Roles):
    f = r.findings.where("severity = 'critical' and audit_year = 2023").groupBy("entity_id").agg(F.count("*").alias("n"))
    x = r.entities.join(f, "entity_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.floor(100.0 * F.count_if(F.col("n") > 0) / F.count("*")) + 5 * F.count_if(F.col("n") > 10)
    return x.groupBy("region").agg(F.least(F.lit(100), score).cast("bigint").alias("score"))


@query("SELECT source, lang, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 500) / count(*), 1) AS cached_pct, least(100.0::DOUBLE, count(*) / 50.0::DOUBLE * 100) AS coverage FROM documents GROUP BY 1, 2")
def reports_summary(r: Roles):
    return r.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("n_chars") > 500) / F.count("*"), 1).alias("cached_pct"), F.least(F.lit(100.0), F.count("*") / F.lit(50.0) * 100).alias("coverage"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%rights%' GROUP BY 1, 2 ORDER BY source, lang")
def budget_docs_by_year(r: Roles):
    return r.table("documents").where(F.col("text").ilike("%license%") | F.col("text").ilike("%rights%")).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%/EN/%' AND url ILIKE '%example%' ORDER BY page_id DESC LIMIT 25")
def report_search(r: Roles):
    return r.table("pages").where(F.col("url").ilike("%/EN/%") & F.col("url").ilike("%example%")).orderBy(F.desc("page_id")).limit(25).select("page_id", "url")


@query("SELECT o_orderkey, o_orderpriority AS agency, o_orderstatus AS kind, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders ORDER BY agency, kind, year DESC")
def reports_export(r: Roles):
    """All reports in the order of an export (three keys): a range partitioning and a sort, for ``files.write_json`` or ``write_csv``."""
    rows = r.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("agency"), F.col("o_orderstatus").alias("kind"), F.year("o_orderdate").alias("year"))
    return rows.orderBy("agency", "kind", F.desc("year"))


@query("SELECT source FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 4000)")
def missing_reports(r: Roles):
    docs = r.table("documents")
    return docs.select("source").distinct().join(docs.where("lang = 'es' and n_chars > 4000").select("source"), "source", "left_anti")


@query("""SELECT source, round(0.7 * (100.0::DOUBLE * count(quality) / count(*)) + 0.3 * (100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 200) / count(*)), 2) AS score, CASE WHEN 0.7 * (100.0::DOUBLE * count(quality) / count(*)) + 0.3 * (100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 200) / count(*)) >= 80 THEN 'high' WHEN 0.7 * (100.0::DOUBLE * count(quality) / count(*)) + 0.3 * (100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 200) / count(*)) >= 60 THEN 'medium' ELSE 'low' END AS band FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def quality_score(r: Roles):
    j = r.table("documents").select("doc_id", "source", "n_chars").join(r.table("labels").select("doc_id", "quality"), "doc_id", "left")
    s = j.groupBy("source").agg((0.7 * (100.0 * F.count("quality") / F.count("*")) + 0.3 * (100.0 * F.count_if(F.col("n_chars") > 200) / F.count("*"))).alias("s"))
    return s.select("source", F.round("s", 2).alias("score"), F.when(F.col("s") >= 80, "high").when(F.col("s") >= 60, "medium").otherwise("low").alias("band"))


@query("SELECT severity, status, count(*) AS n, " + d("coalesce(sum(amount), 0)") + " AS amount FROM findings GROUP BY 1, 2")
def findings_severity(r: Roles):
    return r.findings.groupBy("severity", "status").agg(F.count("*").alias("n"), to_double(F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(20,4)"))).alias("amount"))


@query("SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'warning' END AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_map(r: Roles):
    names = F.create_map(*(F.lit(x) for p in (("error", "critical"), ("purchase", "warning"), ("view", "info")) for x in p))
    return r.table("events").groupBy(F.coalesce(names[F.col("event_type")], F.lit("warning")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT entity_id, count(*) AS findings, {d('sum(amount)')} AS amount, string_agg(DISTINCT severity, ',' ORDER BY severity) AS severities FROM findings GROUP BY 1")
def audit_summary_by_entity(r: Roles):
    return r.findings.groupBy("entity_id").agg(F.count("*").alias("findings"), to_double(F.sum("amount")).alias("amount"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))


@query("SELECT 'nation' AS kind, n_name AS name FROM nation WHERE n_name ILIKE '%1%' UNION ALL SELECT 'region', r_name FROM region WHERE r_name ILIKE '%A%'")
def entity_union_search(r: Roles):
    n = r.table("nation").where(F.col("n_name").ilike("%1%")).select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    return n.unionByName(r.table("region").where(F.col("r_name").ilike("%A%")).select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@query(f"""WITH b AS (SELECT fy, sum(allocated) AS a, sum(spent) AS s, sum(committed) AS c FROM budget_lines GROUP BY 1) SELECT fy, {d('a')} AS allocated, {d('s')} AS spent FROM b WHERE CAST(coalesce(a, 0) > 0 AS INTEGER) + CAST(coalesce(s, 0) > 0 AS INTEGER) + CAST(coalesce(c, 0) > 0 AS INTEGER) + CAST(fy % 3 > 0 AS INTEGER) >= 3""")
def fiscal_complete_years(r: Roles):
    """Years with at least three of four figures."""
    b = r.execution("fy").groupBy("fy").agg(*sums(), F.sum("committed").alias("c"))
    there = sum(((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int") for c in ("spent", "c")), (F.coalesce(F.col("allocated"), F.lit(0)) > 0).cast("int")) + (F.col("fy") % 3 > 0).cast("int")
    return b.where(there >= 3).select("fy", to_double(F.col("allocated")).alias("allocated"), to_double(F.col("spent")).alias("spent"))


@query("SELECT DISTINCT fy, printf('FY%d/%02d', fy, (fy + 1) % 100) AS label FROM budget_lines")
def fiscal_years(r: Roles):
    return r.execution("fy").select("fy", F.format_string("FY%d/%02d", "fy", (F.col("fy") + 1) % 100).alias("label"))


@query("SELECT y AS year, printf('FY %d/%02d', y - 1, y % 100) AS label FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)")
def fy_of_calendar_year(r: Roles):
    """The fiscal year that ends in a calendar year."""
    y = r.table("orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", F.format_string("FY %d/%02d", F.col("year") - 1, F.col("year") % 100).alias("label"))


@query("SELECT DISTINCT printf('FY%d/%02d', y, (y + 1) % 100) AS fy, y AS year FROM (SELECT CAST(year(ts) AS INTEGER) AS y FROM events)")
def fy_label(r: Roles):
    """Labels by calendar year of the event, not July to June."""
    return r.table("events").select(F.year("ts").alias("year")).distinct().select(F.format_string("FY%d/%02d", "year", (F.col("year") + 1) % 100).alias("fy"), "year")


@query("WITH m AS (SELECT fy FROM budget_lines WHERE printf('%d/%02d', fy, (fy + 1) % 100) = '1997/98' OR CAST(fy AS VARCHAR) = '1997') SELECT fy, count(*) AS lines FROM budget_lines WHERE fy IN (SELECT fy FROM m) OR NOT EXISTS (SELECT 1 FROM m) GROUP BY 1")
def fy_match(r: Roles):
    """Filter by a label or its first year; a label that fits nothing filters nothing."""
    per = r.execution("fy").groupBy("fy").agg(F.sum("lines").alias("lines"))
    hit = (F.format_string("%d/%02d", "fy", (F.col("fy") + 1) % 100) == "1997/98") | (F.col("fy").cast("string") == "1997")
    return per.withColumns({"hit": hit, "some": F.max(hit).over(overall())}).where("hit or not some").select("fy", "lines")


@query("""WITH b AS (SELECT lower(category) AS c, allocated FROM budget_lines WHERE category LIKE '%LARGE%' OR category LIKE '%PROMO%') SELECT c AS category, round(CAST(sum(allocated) AS DOUBLE) / 1e9, 6) AS billions FROM b GROUP BY 1""")
def unit_conversion(r: Roles):
    b = r.budget_lines.where(F.col("category").contains("LARGE") | F.col("category").contains("PROMO"))
    return b.groupBy(F.lower("category").alias("category")).agg(F.round(F.sum("allocated").cast("double") / 1e9, 6).alias("billions"))




@query("SELECT entity, CASE WHEN n > 0 THEN round(CAST(a AS DOUBLE) / 1e6, 2) END AS budget, n AS issues FROM (SELECT entity, sum(amount) AS a, count(DISTINCT query_type) AS n FROM findings JOIN entities USING (entity_id) GROUP BY 1)")
def json_map_explode(r: Roles):
    """A JSON map of records, one document a region, as rows again."""
    f = r.findings.join(r.entities, "entity_id").groupBy("region", "entity").agg(F.round(F.sum("amount").cast("double") / 1e6, 2).alias("budget"), F.collect_set("query_type").alias("issues"))
    docs = f.groupBy("region").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("budget", "issues"))))).alias("t"))
    rows = docs.select(F.explode(F.from_json("t", "map<string, struct<budget: double, issues: array<string>>>")).alias("entity", "x"))
    return rows.select("entity", "x.budget", F.size("x.issues").cast("bigint").alias("issues"))




@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def records_unwrap(r: Roles):
    """Rows from payloads that are a wrapped list, a bare list or a single object, by the event's type."""
    kind, x = F.col("event_type"), F.col("props")
    t = F.when(kind == "click", F.concat(F.lit('{"records": [{"fields": '), x, F.lit("}]}"))).when(kind == "error", F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
    wrapped = F.from_json("t", "records array<struct<fields: struct<k: bigint>>>")["records"]
    bare = F.when(F.col("t").startswith("["), F.from_json("t", "array<struct<k: bigint>>")).otherwise(F.array(F.from_json("t", "k bigint")))
    return r.table("events").select("event_id", t.alias("t")).select("event_id", F.explode(F.coalesce(F.transform(wrapped, lambda y: y["fields"]), bare)).alias("x")).select("event_id", "x.k")




@query(f"SELECT entity_id, header, value FROM (SELECT entity_id, CAST(fy AS VARCHAR) AS header, {d('sum(allocated)')} * 1000 AS value FROM budget_lines GROUP BY 1, 2)")
def table_melt(r: Roles):
    """A wide table of entities by years, in thousands, as long rows with the unit applied."""
    b = r.execution("entity_id", "fy").groupBy("entity_id", "fy").agg(to_double(F.sum("allocated")).alias("a"))
    wide = b.groupBy("entity_id").agg(F.collect_list(F.col("fy").cast("string")).alias("headers"), F.collect_list("a").alias("cells"))
    cells = wide.select("entity_id", F.explode(F.arrays_zip("headers", "cells")).alias("c"))
    return cells.select("entity_id", F.col("c.headers").alias("header"), (F.col("c.cells") * 1000).alias("value"))


TABLE_HEADERS = "['Item', p_type || ' Budget', CASE WHEN p_size > 25 THEN 'County' ELSE 'Spent' END, p_brand]"


def _part_tables(r: Roles):
    """Each part as a table with headers made of its columns."""
    return r.table("part").select("p_partkey", F.array(F.lit("Item"), F.concat("p_type", F.lit(" Budget")), F.when(F.col("p_size") > 25, "County").otherwise("Spent"), F.col("p_brand")).alias("headers"))


@query(f"SELECT min(p_partkey) AS p_partkey, p_brand FROM (SELECT p_partkey, p_brand, lower(array_to_string({TABLE_HEADERS}, ' ')) AS h FROM part) WHERE contains(h, 'county') AND contains(h, 'budget') GROUP BY p_brand")
def find_table_by_header(r: Roles):
    """The first table of each brand whose headers hold all keywords, in any case."""
    h = F.lower(F.concat_ws(" ", "headers"))
    found = _part_tables(r).where(h.contains("county") & h.contains("budget"))
    return found.groupBy(F.get("headers", 3).alias("p_brand")).agg(F.min("p_partkey").alias("p_partkey"))


@query(f"SELECT p_partkey, " + ", ".join(f"CASE WHEN regexp_matches(lower(h[{i + 1}]), 'budget|spent|total') THEN 'amount' WHEN regexp_matches(lower(h[{i + 1}]), 'county|item|name') THEN 'entity' END AS c{i}" for i in range(4)) + f" FROM (SELECT p_partkey, {TABLE_HEADERS} AS h FROM part)")
def identify_columns(r: Roles):
    """Column roles from header keywords."""
    role = lambda h: F.when(F.lower(h).rlike("budget|spent|total"), "amount").when(F.lower(h).rlike("county|item|name"), "entity")
    return _part_tables(r).select("p_partkey", *(role(F.get("headers", i)).alias(f"c{i}") for i in range(4)))


@query("SELECT o_orderkey, l_linenumber, CASE WHEN n > 0 THEN CAST(l_quantity AS BIGINT) END AS quantity FROM (SELECT o_orderkey, l_linenumber, l_quantity, count(l_orderkey) OVER (PARTITION BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_quantity DESC NULLS LAST, l_linenumber) AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey) WHERE k = 1")
def best_extraction(r: Roles):
    """Of all tries of each order (its lines) the one of highest confidence (quantity), of equals the first; a stub if none."""
    tries = r.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.struct("l_quantity", (-F.col("l_linenumber")).alias("first"))).alias("best"))
    return r.table("orders").select("o_orderkey").join(tries, "o_orderkey", "left").select("o_orderkey", (-F.col("best.first")).alias("l_linenumber"), F.col("best.l_quantity").cast("bigint").alias("quantity"))


def _provenance(r: Roles):
    """Each finding with its sources as an array of structs: where it came from, and a follow-up if it has one."""
    follow = F.struct(F.lit("follow_up").alias("source"), F.col("follow_up").alias("note"))
    return r.findings.select("finding_id", F.concat(F.array(F.struct(F.col("query_type").alias("source"), F.col("status").alias("note"))), F.when(F.col("follow_up").isNotNull(), F.array(follow)).otherwise(F.slice(F.array(follow), 1, 0))).alias("provenance"))


@query("SELECT finding_id, CASE WHEN follow_up IS NOT NULL THEN 2 ELSE 1 END AS sources FROM findings WHERE (query_type = 'purchase' AND status = 'Pending') OR follow_up = 'Recurring'")
def provenance_exists(r: Roles):
    """Rows whose array of structs holds one that fits."""
    fits = lambda x: ((x["source"] == "purchase") & (x["note"] == "Pending")) | ((x["source"] == "follow_up") & (x["note"] == "Recurring"))
    return _provenance(r).where(F.exists("provenance", fits)).select("finding_id", F.size("provenance").alias("sources"))


@query("SELECT finding_id, coalesce(query_type, CASE WHEN follow_up IS NOT NULL THEN 'follow_up' END) AS first_source FROM findings")
def provenance_first(r: Roles):
    """The first source that is named."""
    return _provenance(r).select("finding_id", F.get(F.filter("provenance", lambda x: x["source"].isNotNull()), 0)["source"].alias("first_source"))


@query(f"""WITH b AS (SELECT entity_id, sum(allocated) AS a, sum(spent) AS s FROM budget_lines GROUP BY 1), l AS (SELECT entity_id, sum(coalesce(nullif(outstanding, 0), principal)) AS debt FROM loans GROUP BY 1), p AS (SELECT entity_id, people FROM population WHERE year = 2021), f AS (SELECT entity_id, count(*) FILTER (WHERE severity = 'critical') AS critical FROM findings GROUP BY 1),
    j AS (SELECT entity_id, entity, {pct('s', 'a', 1)} AS u, {pct('debt', 'a', 1)} AS debt_to_budget, round(CAST(a AS DOUBLE) / people, 2) AS per_capita, critical FROM entities JOIN b USING (entity_id) JOIN l USING (entity_id) JOIN p USING (entity_id) JOIN f USING (entity_id)), h AS (SELECT *, round(CASE WHEN u <= 95 THEN least(u, 95.0) WHEN u <= 100 THEN 90.0 ELSE greatest(0.0, 80 - (u - 100)) END, 1) AS score FROM j)
    SELECT entity, u AS utilization, debt_to_budget, per_capita, critical, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B+' WHEN score >= 55 THEN 'B' WHEN score >= 40 THEN 'B-' ELSE 'C' END AS grade, CASE WHEN debt_to_budget < 20 THEN 'sustainable' WHEN debt_to_budget < 40 THEN 'moderate' ELSE 'at_risk' END AS debt_band FROM h""")
def county_comprehensive(r: Roles):
    b = r.execution("entity_id").groupBy("entity_id").agg(*sums())
    owed = r.loans.groupBy("entity_id").agg(F.sum(F.coalesce(F.nullif("outstanding", F.lit(0)), F.col("principal"))).alias("debt"))
    p = r.population.where("year = 2021").select("entity_id", "people")
    f = r.findings.groupBy("entity_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"))
    j = r.entities.join(b, "entity_id").join(owed, "entity_id").join(p, "entity_id").join(f, "entity_id")
    u, ratio = share(F.col("spent"), F.col("allocated"), 1), share(F.col("debt"), F.col("allocated"), 1)
    return j.select("entity", u.alias("utilization"), ratio.alias("debt_to_budget"), F.round(F.col("allocated").cast("double") / F.col("people"), 2).alias("per_capita"), "critical", grade(health(u)).alias("grade"), F.when(ratio < 20, "sustainable").when(ratio < 40, "moderate").otherwise("at_risk").alias("debt_band"))


@query(f"SELECT entity, {d('sum(amount)')} AS amount FROM findings JOIN entities USING (entity_id) WHERE entity_type = 'NATIONAL' AND amount IS NOT NULL GROUP BY 1 ORDER BY sum(amount) DESC, entity LIMIT 3")
def top_ministries(r: Roles):
    e = r.entities.where("entity_type = 'NATIONAL'")
    s = r.findings.where("amount is not null").join(e, "entity_id").groupBy("entity").agg(F.sum("amount").alias("a")).orderBy(F.desc("a"), "entity").limit(3)
    return s.select("entity", to_double(F.col("a")).alias("amount"))


@query("SELECT n_nationkey, n_name, coalesce(orders, 0) AS orders, orders IS NOT NULL AS in_file FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS orders FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def cob_merge(r: Roles):
    """Entities with a flag for those a second file (the large accounts of one segment) mentions."""
    seen = r.table("customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"))
    return r.table("nation").select("n_nationkey", "n_name").join(seen, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.col("orders").isNotNull().alias("in_file"))


@query("SELECT l.line_id, a.finding_id FROM budget_lines l JOIN findings a ON a.finding_id = l.line_id WHERE a.query_type = 'click'")
def annotations_join(r: Roles):
    """Polymorphic reference: the kind is part of the join."""
    a = r.findings.where("query_type = 'click'").select("finding_id")
    return r.budget_lines.select("line_id").join(a, F.col("line_id") == F.col("finding_id")).select("line_id", "finding_id")


@query("SELECT category, query_type, n, correct, round(100.0::DOUBLE * correct / n, 1) AS accuracy FROM (SELECT CAST(conv_id % 6 AS INTEGER) AS category, role AS query_type, count(*) AS n, count(*) FILTER (WHERE length(text) % 2 = 0) AS correct FROM conversations GROUP BY 1, 2)")
def category_perf(r: Roles):
    c = r.table("conversations").groupBy((F.col("conv_id") % 6).cast("int").alias("category"), F.col("role").alias("query_type")).agg(F.count("*").alias("n"), F.count_if(F.length("text") % 2 == 0).alias("correct"))
    return c.withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("n"), 1))


@query("SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_nationkey < 10 AND c_mktsegment <> 'BUILDING' AND c_acctbal > 0 ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def county_table(r: Roles):
    f = r.table("customer").where("c_nationkey < 10 and c_mktsegment <> 'BUILDING' and c_acctbal > 0")
    return f.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")


@query("SELECT kind, o_orderkey FROM (SELECT o_orderpriority AS kind, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= CASE kind WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 3 ELSE 5 END")
def treasury_batch(r: Roles):
    """A different number of newest documents from each class; the literal bound lets every task keep ten rows a class."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    k = r.table("orders").select(F.col("o_orderpriority").alias("kind"), "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 10")
    return k.where(F.col("k") <= F.when(F.col("kind") == "1-URGENT", 10).when(F.col("kind") == "2-HIGH", 3).otherwise(5)).select("kind", "o_orderkey")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY md5('7:' || conv_id || ':' || turn), conv_id, turn LIMIT 20")
def question_sample(r: Roles):
    """A seeded random sample of questions: the least hashes of their keys (sampling is the feature)."""
    h = F.md5(F.concat(F.lit("7:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).cast("binary"))
    return r.table("conversations").where("role = 'user'").orderBy(h, "conv_id", "turn").limit(20).select("conv_id", "turn")


@query("SELECT role, count(*) AS answers, count(*) FILTER (WHERE length(text) > 40) AS correct, CAST(sum(CASE WHEN length(text) > 40 THEN 10 * least(turn + 1, 5) ELSE 0 END) AS BIGINT) AS points FROM conversations GROUP BY 1")
def answer_points(r: Roles):
    """Ten points by difficulty (a turn's place) for each correct (long enough) answer."""
    right = F.length("text") > 40
    return r.table("conversations").groupBy("role").agg(F.count("*").alias("answers"), F.count_if(right).alias("correct"), F.sum(F.when(right, 10 * F.least(F.col("turn") + 1, F.lit(5))).otherwise(0)).cast("bigint").alias("points"))


@query("SELECT loan_id, CASE WHEN n >= 1000 THEN CAST(n // 1000 AS VARCHAR) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS amount, CAST(interest_rate AS VARCHAR) || '%' AS rate, strftime(issue_date, '%d %b %Y') AS issued FROM (SELECT *, CAST(floor(principal) AS BIGINT) AS n FROM loans)")
def formatted_loans(r: Roles):
    """Amounts with grouped digits, rates in percent and dates in words."""
    return r.loans.select("loan_id", F.format_number(F.floor("principal").cast("bigint"), 0).alias("amount"), F.concat(F.col("interest_rate").cast("string"), F.lit("%")).alias("rate"), F.date_format("issue_date", "dd MMM yyyy").alias("issued"))


@query(f"SELECT entity_id, u AS utilization, CASE WHEN u >= 70 THEN 'A' WHEN u >= 55 THEN 'B' WHEN u >= 40 THEN 'C' WHEN u >= 20 THEN 'D' ELSE 'D-' END AS grade FROM (SELECT entity_id, {pct('sum(committed)', 'sum(allocated)', 1)} AS u FROM budget_lines GROUP BY 1)")
def display_grade(r: Roles):
    """The coarser ladder of grades that pages show, over committed shares."""
    b = r.execution("entity_id").groupBy("entity_id").agg(F.sum("committed").alias("c"), F.sum("allocated").alias("a"))
    u = share(F.col("c"), F.col("a"), 1)
    return b.select("entity_id", u.alias("utilization"), F.when(u >= 70, "A").when(u >= 55, "B").when(u >= 40, "C").when(u >= 20, "D").otherwise("D-").alias("grade"))


@query("SELECT min(doc_id) AS doc_id, source, n_chars FROM documents GROUP BY source, n_chars, md5(text)")
def finding_dedup(r: Roles):
    """The first of equal texts of a source."""
    return r.table("documents").groupBy("source", "n_chars", F.md5(F.col("text").cast("binary")).alias("m")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "n_chars")


@query("SELECT s_nationkey, round(avg(s_acctbal), 2) AS mean, max_by(s_suppkey, s_acctbal) AS best, min_by(s_suppkey, s_acctbal) AS worst, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1")
def generator_summary(r: Roles):
    return r.table("supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 2).alias("mean"), F.max_by("s_suppkey", "s_acctbal").alias("best"), F.min_by("s_suppkey", "s_acctbal").alias("worst"), F.count("*").alias("n"))


@query(f"SELECT p_brand AS project, count(*) AS lines, {d('sum(allocated)')} AS contracted, {d('sum(spent)')} AS paid, {pct('sum(spent)', 'sum(allocated)', 1)} AS completion FROM (SELECT subcategory AS p_brand, allocated, spent FROM budget_lines WHERE committed IS NULL) GROUP BY 1")
def stalled_projects(r: Roles):
    s = r.budget_lines.where("committed is null").groupBy(F.col("subcategory").alias("project")).agg(F.count("*").alias("lines"), *sums())
    return s.select("project", "lines", to_double(F.col("allocated")).alias("contracted"), to_double(F.col("spent")).alias("paid"), share(F.col("spent"), F.col("allocated"), 1).alias("completion"))


@query("SELECT finding_id, round(greatest(0, 1 - CASE WHEN amount IS NULL THEN 0.25 ELSE 0 END - CASE WHEN query_type IS NULL THEN 0.25 ELSE 0 END - CASE WHEN status IS NULL THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS confidence FROM findings")
def validate_audit(r: Roles):
    lost = F.when(F.col("amount").isNull(), 0.25).otherwise(0.0) + F.when(F.col("query_type").isNull(), 0.25).otherwise(0.0) + F.when(F.col("status").isNull(), 0.05).otherwise(0.0)
    return r.findings.select("finding_id", F.round(F.greatest(F.lit(0.0), 1 - lost), 2).alias("confidence"))


@query("SELECT f.entity_id, f.finding_id, d.source FROM (SELECT entity_id, max(finding_id) AS finding_id FROM findings GROUP BY 1) f JOIN (SELECT finding_id, doc_id FROM findings) g USING (finding_id) LEFT JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)")
def verify_latest(r: Roles):
    """The latest record of each entity with its source document."""
    last = r.findings.groupBy("entity_id").agg(F.max_by("doc_id", "finding_id").alias("doc_id"), F.max("finding_id").alias("finding_id"))
    return last.join(r.table("documents").select("doc_id", "source"), "doc_id", "left").select("entity_id", "finding_id", "source")


@query("SELECT source, count(*) AS n, max(doc_id) AS newest FROM documents GROUP BY 1 UNION ALL SELECT 'pages', count(*), max(page_id) FROM pages")
def pipeline_counts(r: Roles):
    a = r.table("documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))
    return a.unionByName(r.table("pages").agg(F.count("*").alias("n"), F.max("page_id").alias("newest")).select(F.lit("pages").alias("source"), "n", "newest"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\d+')) AS numbers, CAST(coalesce(TRY_CAST(regexp_extract(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE), -1) AS DOUBLE) AS first_pct FROM documents")
def metric_extract(r: Roles):
    return r.table("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)).cast("bigint").alias("numbers"), F.coalesce(F.regexp_extract("text", r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double"), F.lit(-1.0)).alias("first_pct"))
