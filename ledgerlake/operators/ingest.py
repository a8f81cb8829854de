"""Ingestion: duplicates, upserts, validation, hashes, JSON columns, freshness, schedules and learning statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..plans.registry import Roles, query

TABLES = ("customer", "documents", "events", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def scan_tables(r: Roles):
    out = None
    for t in TABLES:
        x = r.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def band(n: Column) -> Column:
    return F.when(n >= 1000, "healthy").when(n > 0, "sparse").otherwise("empty")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'healthy' WHEN count(*) > 0 THEN 'sparse' ELSE 'empty' END AS status FROM {t}" for t in TABLES))
def data_health(r: Roles):
    return scan_tables(r).withColumn("status", band(F.col("n")))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_partkey, l_suppkey LIMIT 10")
def duplicate_keys(r: Roles):
    return r.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "l_partkey", "l_suppkey").limit(10)


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_rows(r: Roles):
    return r.table("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, md5(source || '|' || lang || '|' || n_chars) AS m, sha256(source || ':' || lang || ':' || n_chars) AS s FROM documents")
def row_hash(r: Roles):
    cols = ("source", "lang", "n_chars")
    return r.table("documents").select("doc_id", F.md5(F.concat_ws("|", *cols).cast("binary")).alias("m"), F.sha2(F.concat_ws(":", *cols).cast("binary"), 256).alias("s"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def new_docs(r: Roles):
    seen = r.table("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return r.table("orders").select("o_orderkey").join(seen, "o_orderkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_list(r: Roles):
    urgent = r.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return r.table("customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


UPSERT = "WITH old AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1), new AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(UPSERT + " SELECT CASE WHEN o.k IS NULL THEN 'created' WHEN n.k IS NULL THEN 'kept' WHEN o.v <> n.v THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n FROM old o FULL JOIN new n ON o.k = n.k GROUP BY 1")
def upsert_stats(r: Roles):
    """What an upsert by natural key would do, from one full join."""
    o = r.table("orders")
    old = o.where("o_orderdate < date '1998-01-01'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("old"))
    new = o.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("new"))
    j = old.join(new, "k", "full")
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "kept").when(F.col("old") != F.col("new"), "updated").otherwise("skipped")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_insert(r: Roles):
    """The last event of each natural key: an aggregate, with partial maxima before the shuffle."""
    return r.table("events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))


VALID = """WITH v AS (SELECT line_id, CASE WHEN committed IS NULL THEN 0.25 ELSE 0 END + CASE WHEN spent < 0 THEN 0.3 ELSE 0 END + CASE WHEN allocated < 1500 THEN 0.1 ELSE 0 END + CASE WHEN spent < allocated * 0.95 THEN 0.1 ELSE 0 END AS penalty FROM budget_lines), c AS (SELECT line_id, round(greatest(0, 1 - penalty)::DOUBLE, 2) AS confidence FROM v)"""


def _confidence(r: Roles):
    penalty = F.when(F.col("committed").isNull(), 0.25).otherwise(0.0) + F.when(F.col("spent") < 0, 0.3).otherwise(0.0) + F.when(F.col("allocated") < 1500, 0.1).otherwise(0.0) + F.when(F.col("spent") < F.col("allocated") * F.lit("0.95").cast("decimal(3,2)"), 0.1).otherwise(0.0)
    return r.budget_lines.select("line_id", F.round(F.greatest(F.lit(0.0), 1 - penalty), 2).alias("confidence"))


@query(VALID + " SELECT confidence, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS valid FROM c GROUP BY 1")
def validate_budget(r: Roles):
    return _confidence(r).groupBy("confidence").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("valid"))


@query(VALID + " SELECT line_id, confidence FROM c WHERE confidence < 0.6")
def review_queue(r: Roles):
    return _confidence(r).where("confidence < 0.6")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT)) AS fallback FROM events")
def json_metric_fallback(r: Roles):
    p = F.from_json("props", "k bigint, missing bigint")
    return r.table("events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], p["k"]).alias("fallback"))


@query("""WITH f AS (SELECT entity_id, CASE WHEN severity = 'critical' THEN ['severity:critical', 'type:' || query_type, 'status:' || status] ELSE ['type:' || query_type, 'status:' || status] END AS issues FROM findings), x AS (SELECT entity_id, unnest(issues) AS issue FROM f), t AS (SELECT count(DISTINCT entity_id) AS n FROM findings)
    SELECT issue, count(*) AS n, count(DISTINCT entity_id) AS entities, round(100.0::DOUBLE * count(DISTINCT entity_id) / max(t.n), 1) AS coverage FROM x, t WHERE issue IS NOT NULL GROUP BY 1""")
def issue_frequency(r: Roles):
    """How often each issue of the findings' lists occurs, and the share of entities it affects."""
    tag = lambda name, c: F.concat(F.lit(name + ":"), c)
    issues = F.array(F.when(F.col("severity") == "critical", "severity:critical"), tag("type", F.col("query_type")), tag("status", F.col("status")))
    f = r.findings.select("entity_id", F.explode(F.array_compact(issues)).alias("issue")).groupBy("issue", "entity_id").agg(F.count("*").alias("n"))
    total = r.findings.agg(F.countDistinct("entity_id").alias("total"))  # one row
    g = f.groupBy("issue").agg(F.sum("n").alias("n"), F.count("*").alias("entities"))
    return g.crossJoin(total).select("issue", "n", "entities", F.round(100.0 * F.col("entities") / F.col("total"), 1).alias("coverage"))


@query("SELECT user_id, count(*) AS events, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS keys FROM events WHERE event_type = 'error' GROUP BY 1")
def provenance_append(r: Roles):
    """Distinct provenance keys appended per user."""
    return r.table("events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("events"), F.countDistinct(F.get_json_object("props", "$.k").cast("bigint")).alias("keys"))


FRESH = "SELECT event_type, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-20') AS days FROM events GROUP BY 1"


@query(f"WITH f AS ({FRESH}) SELECT event_type, CAST(days AS INTEGER) AS days, CASE WHEN days < 45 THEN 'fresh' WHEN days <= 180 THEN 'aging' ELSE 'stale' END AS status FROM f")
def freshness(r: Roles):
    days = F.datediff(F.lit("2024-02-20").cast("date"), F.max("ts").cast("date"))
    f = r.table("events").groupBy("event_type").agg(days.alias("days"))
    return f.withColumn("status", F.when(F.col("days") < 45, "fresh").when(F.col("days") <= 180, "aging").otherwise("stale"))


@query("SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(20,4)))::DOUBLE AS total FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def jobs_lookback(r: Roles):
    return r.table("events").where(F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,4)")).cast("double").alias("total"))


STATES = ("click", "view", "purchase", "error")


@query("SELECT CAST(user_id % 20 AS INTEGER) AS domain, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') AS {s}" for s in STATES) + " FROM events GROUP BY 1")
def ingestion_stats(r: Roles):
    p = r.table("events").groupBy(F.pmod("user_id", F.lit(20)).cast("int").alias("domain"))
    return p.agg(*(F.count_if(F.col("event_type") == s).alias(s) for s in STATES))


@query("SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(doc_id) AS newest, count(*) FILTER (WHERE n_chars > 1000) AS large FROM documents GROUP BY 1")
def manifest_stats(r: Roles):
    return r.table("documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("doc_id").alias("newest"), F.count_if(F.col("n_chars") > 1000).alias("large"))


@query("SELECT DISTINCT d AS day, CAST(date_diff('day', CASE WHEN month(d) IN (1, 2, 3) THEN make_date(year(d) - 1, 12, 31) WHEN month(d) IN (4, 5, 6) THEN make_date(year(d), 3, 31) WHEN month(d) IN (7, 8, 9) THEN make_date(year(d), 6, 30) ELSE make_date(year(d), 9, 30) END, d) AS INTEGER) AS days FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)")
def days_since_quarter_end(r: Roles):
    day = F.col("o_orderdate").cast("date")
    return r.table("orders").select(day.alias("day")).distinct().select("day", F.datediff("day", F.date_sub(F.trunc("day", "quarter"), 1)).alias("days"))


@query("SELECT d AS day, (isodow(d) = 1 AND week(d) % 2 = 0) OR day(d) = 1 OR (month(d) IN (1, 4, 7, 10) AND day(d) BETWEEN 10 AND 20) AS should_run FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def should_run(r: Roles):
    """Calendar rule of a source: even-week Mondays, first days, and the window after a quarter's end."""
    d = r.table("orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    monday = (F.weekday("day") == 0) & (F.weekofyear("day") % 2 == 0)
    return d.select("day", (monday | (F.dayofmonth("day") == 1) | (F.month("day").isin(1, 4, 7, 10) & F.dayofmonth("day").between(10, 20))).alias("should_run"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(max(turn) AS BIGINT) AS longest FROM conversations GROUP BY 1")
def user_stats(r: Roles):
    return r.table("conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn > 3)")
def unanswered_questions(r: Roles):
    c = r.table("conversations")
    return c.where("role = 'user'").select("conv_id").distinct().join(c.where("role = 'assistant' and turn > 3").select("conv_id"), "conv_id", "left_anti")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d), s AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, max(n) AS streak FROM s GROUP BY 1""")
def learning_streak(r: Roles):
    """Longest run of consecutive active days: day minus rank is constant within a run."""
    d = r.table("events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return d.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("streak"))


@query("SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase' AND e.value > 100 AND c.c_mktsegment <> 'MACHINERY'")
def notify_watchers(r: Roles):
    """Fan-out of events to those who watch them: all segments but one."""
    e = r.table("events").where("event_type = 'purchase' and value > 100").select("event_id", F.col("user_id").alias("c_custkey"))
    return e.join(r.table("customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey"), "c_custkey").select("event_id", "c_custkey")


@query("SELECT coalesce(a.n_name, b.n_name) AS name, CASE WHEN a.n_name IS NULL THEN 'extra' ELSE 'missing' END AS side FROM (SELECT n_name FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name FROM nation WHERE n_nationkey >= 5) b ON a.n_name = b.n_name WHERE a.n_name IS NULL OR b.n_name IS NULL")
def missing_extra_counties(r: Roles):
    want = r.table("nation").where("n_nationkey < 20").select(F.col("n_name").alias("name"))
    have = r.table("nation").where("n_nationkey >= 5").select(F.col("n_name").alias("name"))
    return want.join(have, "name", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(want, "name", "left_anti").withColumn("side", F.lit("extra")))


@query("""WITH q AS (SELECT unnest(['7', 'nation_3', 'N05', 'tion_24']) AS q), c AS (SELECT q, n_nationkey AS id, CASE WHEN q = CAST(n_nationkey AS VARCHAR) THEN 1 WHEN lower(n_name) = q THEN 2 WHEN q = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') THEN 3 WHEN n_name ILIKE '%' || q || '%' THEN 4 END AS pr FROM q, nation) SELECT q, arg_min(id, pr * 100 + id) AS entity_id FROM c WHERE pr IS NOT NULL GROUP BY 1""")
def resolve_entity(r: Roles):
    """Candidates by id, slug, code and name, the first kind wins."""
    asked = r.spark.createDataFrame([("7",), ("nation_3",), ("N05",), ("tion_24",)], "q string")
    n = r.table("nation").select(F.col("n_nationkey").alias("id"), "n_name")
    rank = F.when(F.col("q") == F.col("id").cast("string"), 1).when(F.lower("n_name") == F.col("q"), 2).when(F.col("q") == F.concat(F.lit("N"), F.lpad(F.col("id").cast("string"), 2, "0")), 3).when(F.lower("n_name").contains(F.lower("q")), 4)
    c = n.crossJoin(F.broadcast(asked)).withColumn("pr", rank).where("pr is not null")  # four asked names
    return c.groupBy("q").agg(F.min_by("id", F.struct("pr", "id")).alias("entity_id"))


@query("SELECT nation.n_nationkey AS entity_id, count(DISTINCT o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def entities_enriched(r: Roles):
    """Counts by entity from aggregated facts: nothing is joined row by row."""
    c = r.table("customer").select("c_custkey", "c_nationkey")
    n = r.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    per = c.join(n, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("entity_id")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.count("*").alias("customers"))
    return r.table("nation").select(F.col("n_nationkey").alias("entity_id")).join(per, "entity_id", "left").select("entity_id", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT DISTINCT entity_id, doc_id FROM findings WHERE entity_id = 5")
def entity_source_docs(r: Roles):
    return r.findings.where("entity_id = 5").select("entity_id", "doc_id").distinct()
