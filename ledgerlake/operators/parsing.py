"""The text functions at work: on the remarks of all orders, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Roles, query

VALUES = "remarks"


def num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"


KES = r"'(?i)(?:KES|KSh\.?|Kshs\.?)\s*([\d,]+(?:\.\d+)?)\s*(trillion|billion|million|thousand|T|B|M|K)?\b'"


@query(f"""SELECT k, t, round({num(f"nullif(regexp_extract(t, {KES}, 1), '')")} * CASE lower(regexp_extract(t, {KES}, 2)) WHEN 'trillion' THEN 1e12 WHEN 't' THEN 1e12 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END, 2) AS amount FROM {VALUES}""")
def kes_amount(r: Roles):
    return r.remarks.select("k", "t", T.kes_amount(F.col("t")).alias("amount"))


@query(f"""SELECT k, t, coalesce(TRY_CAST(regexp_replace(upper(t), '[^0-9.]', '', 'g') AS DOUBLE) * CASE upper(right(trim(t), 1)) WHEN 'T' THEN 1e12 WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'K' THEN 1e3 ELSE 1 END, 0) AS amount FROM {VALUES}""")
def suffix_amount(r: Roles):
    return r.remarks.select("k", "t", T.suffix_amount(F.col("t")).alias("amount"))


@query(f"""SELECT count(*) FILTER (WHERE regexp_matches(t, 'KES\\s*[\\d,]+')) AS n, sum({num("nullif(regexp_extract(t, 'KES\\s*([\\d,]+)', 1), '')")}) AS total FROM {VALUES}""")
def kes_regex_sum(r: Roles):
    return r.remarks.agg(F.count_if(F.col("t").rlike(r"KES\s*[\d,]+")).alias("n"), F.sum(T.plain_kes(F.col("t"))).alias("total"))


@query(f"""SELECT k, t, CASE WHEN upper(trim(replace(t, '%', ''))) NOT IN ('N/A', 'NA', '-', '') THEN {num("upper(trim(replace(t, '%', '')))")} END AS pct FROM {VALUES}""")
def parse_percentage(r: Roles):
    return r.remarks.select("k", "t", T.percentage(F.col("t")).alias("pct"))


@query(f"SELECT k, t, coalesce(nullif(regexp_extract(t, '\\b([A-Z]{{3}})\\b', 1), ''), 'KES') AS code FROM {VALUES}")
def parse_currency(r: Roles):
    return r.remarks.select("k", "t", T.currency_code(F.col("t")).alias("code"))


@query(f"""SELECT k, t, CASE WHEN regexp_matches(x, '^\\(.*\\)$') THEN -TRY_CAST(regexp_replace(x, '[()]', '', 'g') AS DOUBLE) ELSE TRY_CAST(x AS DOUBLE) END AS v FROM (SELECT k, t, replace(replace(trim(t), '−', '-'), ',', '') AS x FROM {VALUES})""")
def clean_numeric(r: Roles):
    return r.remarks.select("k", "t", T.accounting_number(F.col("t")).alias("v"))


@query(f"""SELECT k, t, TRY_CAST(CASE WHEN regexp_matches(trim(t), '^-?\\d+,\\d{{1,2}}$') THEN replace(trim(t), ',', '.') ELSE replace(trim(t), ',', '') END AS DOUBLE) AS v FROM {VALUES}""")
def decimal_comma(r: Roles):
    return r.remarks.select("k", "t", T.decimal_comma(F.col("t")).alias("v"))


FYP = r"'(?i)(?:FY\s*)?((?:19|20)\d{2})\s*[/-]\s*(?:(?:19|20)?(\d{2}))\b'"


@query(f"""SELECT k, t, CASE WHEN a <> '' THEN 'FY' || a || '/' || b WHEN y <> '' THEN printf('FY%d/%02d', CAST(y AS INTEGER), (CAST(y AS INTEGER) + 1) % 100) END AS label, CASE WHEN a <> '' THEN 0.9::DOUBLE WHEN y <> '' THEN 0.5::DOUBLE END AS confidence
    FROM (SELECT k, t, regexp_extract(t, {FYP}, 1) AS a, regexp_extract(t, {FYP}, 2) AS b, regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1) AS y FROM {VALUES})""")
def fiscal_period_parse(r: Roles):
    return r.remarks.select("k", "t", T.fiscal_label(F.col("t")).alias("label"), T.fiscal_confidence(F.col("t")).alias("confidence"))


@query(f"""SELECT k, t, CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}$') THEN make_date(CAST(left(t, 4) AS BIGINT), CAST(right(t, 2) AS BIGINT), 1) WHEN regexp_matches(t, '^\\d{{4}}-Q[1-4]$') THEN make_date(CAST(left(t, 4) AS BIGINT), CAST(right(t, 1) AS BIGINT) * 3 - 2, 1) WHEN regexp_matches(t, '^\\d{{4}}') THEN make_date(CAST(left(t, 4) AS BIGINT), 1, 1) END AS day FROM {VALUES}""")
def period_to_date(r: Roles):
    return r.remarks.select("k", "t", T.period_date(F.col("t")).alias("day"))


@query(r"""SELECT k, t, round(coalesce(CASE WHEN contains(x, 'B') THEN TRY_CAST(replace(x, 'B', '') AS DOUBLE) * 1e9 WHEN contains(x, 'M') THEN TRY_CAST(replace(x, 'M', '') AS DOUBLE) * 1e6 WHEN regexp_matches(regexp_replace(x, '[.,]', '', 'g'), '^\d+$') THEN TRY_CAST(replace(x, ',', '') AS DOUBLE) END, 0), 2) AS amount FROM (SELECT k, t, trim(replace(t, 'KES', '')) AS x FROM remarks)""")
def strict_amount(r: Roles):
    return r.remarks.select("k", "t", T.strict_amount(F.col("t")).alias("amount"))


@query(r"""SELECT k, t, CASE WHEN regexp_matches(x, '^[-+]?\d+(\.\d+)?$') THEN TRY_CAST(x AS DOUBLE) END AS amount FROM (SELECT k, t, regexp_replace(regexp_replace(trim(t), '[, ]', '', 'g'), '(?i)^(?:KES|Kshs?\.?)\s*', '') AS x FROM remarks)""")
def bill_amount(r: Roles):
    return r.remarks.select("k", "t", T.bill_amount(F.col("t")).alias("amount"))


@query(r"""SELECT k, t, CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2})?$') THEN strftime(TRY_CAST(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') WHEN regexp_matches(t, '^\d{4}-\d{2}$') THEN t || '-01 00:00:00' WHEN regexp_matches(t, '^\d{4}$') THEN t || '-01-01 00:00:00' WHEN regexp_matches(t, '^\d{9,10}$') THEN strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS moment FROM remarks""")
def flexible_date(r: Roles):
    """Any of several forms of a date, as UTC text."""
    return r.remarks.select("k", "t", F.date_format(T.flexible_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("SELECT k, t[1:200] AS start, replace(t, ' County', '') AS short, string_split(t, ' ')[1] AS first_word FROM remarks")
def text_cut(r: Roles):
    """The first 200 characters, the name without its suffix, and the first word."""
    t = F.col("t")
    return r.remarks.select("k", F.substring(t, 1, 200).alias("start"), F.replace(t, F.lit(" County"), F.lit("")).alias("short"), F.get(F.split(t, " ", -1), 0).alias("first_word"))


@query(f"SELECT k, t, regexp_replace(replace(replace(lower(trim(t)), '&', 'and'), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug FROM {VALUES}")
def slugify(r: Roles):
    return r.remarks.select("k", "t", T.slug(F.col("t")).alias("slug"))


NAMES = ", ".join(f"({i}, '{key}', '{name.replace(chr(39), chr(39) * 2)}', '{kind}')" for i, (key, name, kind) in enumerate(T.GAZETTEER))
KEY = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim({0})), '[‘’''`´]', '', 'g'), '-', ' '), '\s+county$', ''), '\s+', ' ', 'g'))"


def names(r: Roles) -> DataFrame:
    """The gazetteer: a fixed list of some sixty names in comparable form, with their canonical names."""
    return r.spark.createDataFrame(T.GAZETTEER, "key string, name string, kind string")


@query(f"""WITH q AS (SELECT k, t, {KEY.format("t")} AS key FROM {VALUES}), e AS (SELECT * FROM (VALUES {NAMES}) v(i, key, name, kind))
    SELECT k, t, name, kind, CASE WHEN name IS NOT NULL THEN 1.0::DOUBLE END AS confidence FROM q LEFT JOIN e USING (key)""")
def normalize_entity(r: Roles):
    """Exact matches of comparable forms."""
    return r.remarks.withColumn("key", T.name_key(F.col("t"))).join(F.broadcast(names(r)), "key", "left").select("k", "t", "name", "kind", F.when(F.col("name").isNotNull(), 1.0).alias("confidence"))


def _cases(rules, default: str | None = None) -> str:
    """Rules by pattern, or by any of several phrases."""
    test = lambda p: f"regexp_matches(t, '{p}')" if isinstance(p, str) else "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in p) + ")"
    return "CASE " + " ".join(f"WHEN {test(p)} THEN '{n}'" for n, p in rules) + (f" ELSE '{default}'" if default else "") + " END"


@query(f"SELECT k, t, {_cases(T.OPINIONS)} AS opinion FROM {VALUES}")
def extract_opinion(r: Roles):
    return r.remarks.select("k", "t", T.opinion(F.col("t")).alias("opinion"))


AMOUNT = f"""round({num(f"nullif(regexp_extract(t, {KES}, 1), '')")} * CASE lower(regexp_extract(t, {KES}, 2)) WHEN 'trillion' THEN 1e12 WHEN 't' THEN 1e12 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 ELSE 1 END, 2)"""


@query(f"SELECT k, t, coalesce({_cases(T.SEVERITY)}, CASE WHEN {AMOUNT} >= 50e6 THEN 'critical' WHEN {AMOUNT} >= 5e6 THEN 'warning' ELSE 'info' END) AS severity FROM {VALUES}")
def classify_severity(r: Roles):
    """By phrases, else by the amount in the text."""
    return r.remarks.select("k", "t", T.severity(F.col("t"), T.kes_amount(F.col("t"))).alias("severity"))


@query(f"SELECT k, t, {_cases(T.QUERY_TYPES)} AS query_type FROM {VALUES}")
def classify_query_type(r: Roles):
    return r.remarks.select("k", "t", T.query_type(F.col("t")).alias("query_type"))


@query(f"SELECT k, t, {_cases(T.LENDERS, 'other')} AS kind FROM {VALUES}")
def classify_loan(r: Roles):
    return r.remarks.select("k", "t", T.lender_kind(F.col("t")).alias("kind"))


@query(f"SELECT k, t, {_cases(T.LENDER_TYPES, 'Other')} AS kind FROM {VALUES}")
def classify_lender(r: Roles):
    return r.remarks.select("k", "t", T.lender_type(F.col("t")).alias("kind"))


@query(f"SELECT k, t, {_cases(T.BILL_TYPES, 'supplier_arrears')} AS kind FROM {VALUES}")
def classify_bill(r: Roles):
    return r.remarks.select("k", "t", T.bill_kind(F.col("t")).alias("kind"))


@query(f"SELECT k, report, coalesce({_cases(T.OPINION_WORDS)}, 'Unknown') AS opinion FROM (SELECT k, t AS report, regexp_extract(t, '(?is)opinion(.{{200}})', 1) AS t FROM {VALUES})")
def opinion_section(r: Roles):
    """The opinion named after the heading, by the other of the two parsers."""
    return r.remarks.select("k", F.col("t").alias("report"), T.opinion_after_heading(F.col("t")).alias("opinion"))


@query(rf"SELECT k, t, trim(nullif(regexp_extract(t, '(?i)recommendation[:-]\s*(.+)\z', 1), '')) AS recommendation FROM {VALUES}")
def extract_recommendation(r: Roles):
    return r.remarks.select("k", "t", T.recommendation(F.col("t")).alias("recommendation"))


@query(f"SELECT k, t, {_cases(T.DOCUMENTS, 'other')} AS kind FROM {VALUES}")
def classify_doc(r: Roles):
    return r.remarks.select("k", "t", T.document_kind(F.col("t")).alias("kind"))


def _points(terms, x: str) -> str:
    return " + ".join(f"CASE WHEN contains({x}, '{w}') THEN {k} ELSE 0 END" for ws, k in terms for w in ws)


@query(f"SELECT k, t, CAST({_points(((T.RELEVANT_HIGH, 10), (T.RELEVANT_MEDIUM, 5)), 'lower(t)')} AS INTEGER) AS score FROM {VALUES}")
def relevance_score(r: Roles):
    return r.remarks.select("k", "t", T.relevance(F.col("t"), T.RELEVANT_HIGH, T.RELEVANT_MEDIUM).alias("score"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, '.'), lambda x: contains(lower(x), ' the '))[1:5], '|') AS sentences FROM documents")
def issue_sentences(r: Roles):
    """The first five sentences with a keyword (a top-k report)."""
    return r.table("documents").select("doc_id", F.array_join(F.slice(F.filter(F.split("text", r"\.", -1), lambda x: F.lower(x).contains(" the ")), 1, 5), "|").alias("sentences"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS links, coalesce(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)[1], '') AS first_link FROM pages")
def html_links(r: Roles):
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return r.table("pages").select("page_id", F.size(links).cast("bigint").alias("links"), F.coalesce(F.get(links, 0), F.lit("")).alias("first_link"))


SITE = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


@query(f"""SELECT page_id, link, CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN {SITE} || link ELSE {SITE} || '/' || link END AS resolved FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages)""")
def url_resolve(r: Roles):
    """Every link of a page, resolved against its site."""
    link, site = F.col("link"), F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    links = r.table("pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("link"))
    return links.select("page_id", "link", F.when(link.startswith("http"), link).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(site, F.lit("/"), link)).alias("resolved"))


FILE = "CASE WHEN regexp_matches(t, '[0-9]') THEN '/wp-content/uploads/' || k || '.PDF?v=1' ELSE '/pages/' || k || '/Logo' END"


def _files(r: Roles) -> DataFrame:
    """A link for each remark: a file if the remark holds a number, else a page."""
    k = F.col("k").cast("string")
    url = F.when(F.col("t").rlike("[0-9]"), F.concat(F.lit("/wp-content/uploads/"), k, F.lit(".PDF?v=1"))).otherwise(F.concat(F.lit("/pages/"), k, F.lit("/Logo")))
    return r.remarks.withColumn("url", url)


@query(f"SELECT k, url, CAST({_points(((T.CANDIDATE_GOOD, 10), (T.CANDIDATE_BAD, -15)), 'lower(both_)')} + CASE WHEN contains(lower(url), '/wp-content/uploads/') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '\\.pdf($|\\?)') THEN 5 ELSE 0 END AS INTEGER) AS score FROM (SELECT k, url, url || chr(10) || t AS both_ FROM (SELECT k, t, {FILE} AS url FROM {VALUES}))")
def candidate_score(r: Roles):
    return _files(r).select("k", "url", T.candidate_score(F.col("url"), F.col("t")).alias("score"))


@query(f"""SELECT page_id, links, chosen, CASE WHEN chosen LIKE 'http%' THEN chosen WHEN chosen LIKE '/%' THEN {SITE} || chosen ELSE {SITE} || '/' || chosen END AS resolved FROM (SELECT page_id, url, len(l) AS links, coalesce(list_filter(l, lambda x: contains(lower(x), 'tion') OR contains(lower(x), 'mente'))[1], l[1]) AS chosen FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)) WHERE links > 0""")
def preferred_link(r: Roles):
    """The first link of a page with a keyword, else its first, resolved against its site."""
    links, site, chosen = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1), F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), F.col("chosen")
    fits = lambda x: F.lower(x).contains("tion") | F.lower(x).contains("mente")
    p = r.table("pages").select("page_id", "url", links.alias("l")).where(F.size("l") > 0).withColumn("chosen", F.coalesce(F.get(F.filter("l", fits), 0), F.get("l", 0)))
    return p.select("page_id", F.size("l").cast("bigint").alias("links"), "chosen", F.when(chosen.startswith("http"), chosen).when(chosen.startswith("/"), F.concat(site, chosen)).otherwise(F.concat(site, F.lit("/"), chosen)).alias("resolved"))


@query("SELECT doc_id, text FROM documents WHERE text ILIKE '%license%' OR source ILIKE 'SRC1' ORDER BY doc_id LIMIT 10")
def search_multi(r: Roles):
    """A page of a search over two columns, by id."""
    return r.table("documents").where(F.col("text").ilike("%license%") | F.col("source").ilike("SRC1")).orderBy("doc_id").limit(10).select("doc_id", "text")


@query("""WITH lines AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS x FROM (SELECT page_id, string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS l FROM pages)), h AS (SELECT *, last_value(CASE WHEN regexp_matches(x, '^[A-Z]') THEN x END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS head FROM lines WHERE x <> '') SELECT page_id, count(*) AS lines, count(DISTINCT head) AS heads, count(*) FILTER (WHERE head IS NULL) AS before FROM h GROUP BY 1""")
def carry_forward_header(r: Roles):
    """The last header line seen is carried to the lines below it, in a fold over the page's own lines."""
    lines = F.filter(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n", -1), lambda x: x != "")
    p = r.table("pages").select("page_id", lines.alias("l")).where(F.size("l") > 0)
    is_head = lambda x: x.rlike("^[A-Z]")
    first = F.array_position(F.transform("l", is_head), True)
    return p.select("page_id", F.size("l").cast("bigint").alias("lines"), F.size(F.array_distinct(F.filter("l", is_head))).cast("bigint").alias("heads"), F.when(first > 0, first - 1).otherwise(F.size("l")).cast("bigint").alias("before"))
