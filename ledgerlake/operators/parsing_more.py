"""Further text functions at work, on the remarks of all orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Roles, query
from ..sources.roles import share
from .budget import HEALTH_SQL, health, pct, sums
from .parsing import NAMES

VALUES = "remarks"
NUMBER = r"'([\d,]*\d(?:\.\d+)?)'"


def num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"


PAT = r"'(?i)\b(KES|KSh|USD)\.?\s*([\d,]+(?:\.\d+)?)\s*(billion|million|thousand)?'"


@query(f"""SELECT k, t, round(coalesce({num(f'regexp_extract(t, {PAT}, 2)')} * CASE lower(regexp_extract(t, {PAT}, 3)) WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 ELSE 1 END * CASE WHEN upper(regexp_extract(t, {PAT}, 1)) = 'USD' THEN 129 ELSE 1 END, {num(f'regexp_extract(t, {NUMBER}, 1)')}), 2) AS amount FROM {VALUES}""")
def money_normalize(r: Roles):
    return r.remarks.select("k", "t", T.money_in_kes(F.col("t")).alias("amount"))


@query(f"""SELECT k, t, round(TRY_CAST(regexp_extract(t, '([\\d.]+)\\s*([BM])\\s*KES', 1) AS DOUBLE) * CASE regexp_extract(t, '([\\d.]+)\\s*([BM])\\s*KES', 2) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 END, 2) AS amount FROM {VALUES}""")
def amount_before_kes(r: Roles):
    return r.remarks.select("k", "t", T.amount_before_kes(F.col("t")).alias("amount"))


@query(f"""SELECT k, t, round(CASE WHEN contains(near, 'billion') THEN v * 1e9 WHEN contains(near, 'million') THEN v * 1e6 WHEN v < 100 THEN v * 1e9 WHEN v < 1e5 THEN v * 1e6 ELSE v END, 2) AS amount FROM (SELECT k, t, {num(f'regexp_extract(t, {NUMBER}, 1)')} AS v, lower(regexp_extract(t, '((?:.{{0,30}})\\d(?:.{{0,30}}))', 1)) AS near FROM {VALUES})""")
def context_amount(r: Roles):
    return r.remarks.select("k", "t", T.context_amount(F.col("t")).alias("amount"))


@query(f"""SELECT k, t, trim(nullif(regexp_extract(t, '(?s)Management [Rr]esponse:\\s*(.*?)(?:\\n[A-Z][A-Z ]+\\n|$)', 1), '')) AS response FROM {VALUES}""")
def extract_responses(r: Roles):
    return r.remarks.select("k", "t", T.response(F.col("t")).alias("response"))


def _ind(word: str, low: int, high: int) -> str:
    v = f"TRY_CAST(regexp_extract(t, '(?i){word}\\D{{0,40}}?(\\d+(?:\\.\\d+)?)\\s*(?:%|per cent|percent)', 1) AS DOUBLE)"
    return f"CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END"


@query(f"SELECT k, t, {_ind('inflation', 0, 50)} AS inflation, {_ind('unemployment', 0, 100)} AS unemployment FROM {VALUES}")
def indicator_extract(r: Roles):
    return r.remarks.select("k", "t", T.indicator(F.col("t"), "inflation", 0, 50).alias("inflation"), T.indicator(F.col("t"), "unemployment", 0, 100).alias("unemployment"))


def _first_county(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{p.lower()}') THEN '{p} County'" for p in T.COUNTIES) + " END"


@query(f"SELECT k, t, coalesce(a, b) AS entity, CASE WHEN a IS NOT NULL THEN 0.9::DOUBLE WHEN b IS NOT NULL THEN 0.6::DOUBLE END AS confidence FROM (SELECT k, t, {_first_county("string_split(t, chr(10))[1]")} AS a, {_first_county('t')} AS b FROM {VALUES})")
def infer_entity(r: Roles):
    """The first name of the list, in its order, that the title (the first line) mentions, else the page."""
    first = lambda c: T.cascade([(F.lower(c).contains(p.lower()), f"{p} County") for p in T.COUNTIES])
    title, page = F.col("title"), F.col("page")
    found = r.remarks.select("k", "t", first(F.get(F.split("t", "\n", -1), 0)).alias("title"), first(F.col("t")).alias("page"))
    return found.select("k", "t", F.coalesce(title, page).alias("entity"), F.when(title.isNotNull(), 0.9).when(page.isNotNull(), 0.6).alias("confidence"))


def _similar(x: str) -> str:
    return f"round(100.0::DOUBLE * (1 - levenshtein(lower(trim(t)), {x}) / greatest(length(trim(t)), length({x}))::DOUBLE), 2)"


@query(f"""WITH s AS (SELECT k, t, i, name, kind, greatest({_similar("lower(name)")}, {_similar("key")}) AS score FROM remarks, (VALUES {NAMES}) p(i, key, name, kind)) SELECT k, t, name, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY k, t ORDER BY score DESC, i) AS n FROM s WHERE score > 70) WHERE n = 1""")
def normalize_entity_fuzzy(r: Roles):
    """Nearest name above 70 %, by its canonical form or its key, of equals the first of the list."""
    return nearest_names(r.remarks, T.GAZETTEER, 70)


def nearest_names(raw: DataFrame, names: list[tuple[str, str, str]], least: int) -> DataFrame:
    """(k, t, name, kind, score) of texts (k, t) with a name (key, name, kind) whose Levenshtein similarity exceeds ``least`` percent.

    The list of names goes to every task.  An edit changes a length by one and takes one letter out of a set of letters at most, so
    lengths and letters tell most pairs apart before their distance is computed, up to the bound that the similarity sets.
    """
    forms = [(i, b, name, kind) for i, (key, name, kind) in enumerate(names) for b in sorted({name.lower(), key})]
    letters = sorted({c for _, b, *_ in forms for c in b})
    bits = F.array(*(F.struct(F.lit(x).alias("letter"), F.lit(1 << i).cast("long").alias("bit")) for i, x in enumerate(letters)))
    mask = lambda c: F.aggregate(bits, F.lit(0).cast("long"), lambda m, x: F.when(F.contains(c, x["letter"]), m.bitwiseOR(x["bit"])).otherwise(m))
    a, b, longest = F.col("a"), F.col("b"), F.greatest("len_a", "len_b")
    few = lambda n: 100 * n <= (100 - least) * longest
    lengths = F.sequence(F.lit(1), F.floor(100 * F.length("b") / least).cast("int"))
    known = raw.sparkSession.createDataFrame(forms, "i int, b string, name string, kind string").select("*", F.length("b").alias("len_b"), mask(b).alias("in_b"), F.explode(lengths).alias("len_a"))
    known = known.where(few(F.abs(F.col("len_a") - F.col("len_b"))))
    low = raw.select("k", "t", F.coalesce(F.lower(F.trim("t")), F.lit("")).alias("a"))
    others = F.length(F.translate("a", "".join(letters), ""))
    texts = low.select("k", "t", "a", F.length("a").alias("len_a"), mask(a).alias("in_a"), others.alias("others"))
    lost = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y)))
    near = few(F.col("others") + lost("in_a", "in_b")) & few(lost("in_b", "in_a"))
    room = F.floor(longest * (100 - least) / 100).cast("int")
    d = F.when(near, F.call_function("levenshtein", a, b, room))  # -1 beyond the room
    d = texts.join(F.broadcast(known), "len_a").select("k", "t", "i", "name", "kind", longest.alias("longest"), d.alias("d")).where("d >= 0")
    scored = d.select("k", "t", "i", "name", "kind", F.round(100.0 * (1 - F.col("d") / F.col("longest")), 2).alias("score")).where(F.col("score") > least)
    best = scored.groupBy("k", "t").agg(F.min(F.struct((-F.col("score")).alias("less"), "i", "name", "kind")).alias("best"))
    return best.select("k", "t", "best.name", "best.kind", (-F.col("best.less")).alias("score"))


CELL = r"trim(regexp_replace({0}, '<[^>]*>', '', 'g'))"
DEBTS = r"'(?i)(total|external|domestic)\s+(?:public\s+)?debt[:\s]+(?:kes\s+)?(\d+(?:[.,]\d+)?)\s*(trillion|billion|million)'"


def _report(r: Roles):
    """A debt report of each entity as an HTML table and a sentence, from its loans."""
    s = r.loans.groupBy("entity_id").agg(F.floor(F.sum("principal")).cast("bigint").alias("total"), F.floor(F.sum(F.when(F.col("debt_category").startswith("EXTERNAL"), F.col("principal")))).cast("bigint").alias("external"), F.floor(F.sum(F.when(F.col("debt_category").startswith("DOMESTIC"), F.col("principal")))).cast("bigint").alias("domestic"))
    row = lambda label, c: F.concat(F.lit(f"<tr><th>{label}</th><td>KES "), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>Item</th><td>Amount</td></tr>"), row("<b>Total</b> public debt", "total"), row("External debt", "external"), row("Domestic debt", "domestic"), F.lit("</table><p>Total public debt: KES "), F.floor(F.col("total") / 1000000).cast("string"), F.lit(" million</p>"))
    return s.select("entity_id", html.alias("html"))


REPORT = """SELECT entity_id, '<table><tr><th>Item</th><td>Amount</td></tr><tr><th><b>Total</b> public debt</th><td>KES ' || total || '</td></tr><tr><th>External debt</th><td>KES ' || coalesce(external, 0) || '</td></tr><tr><th>Domestic debt</th><td>KES ' || coalesce(domestic, 0) || '</td></tr></table><p>Total public debt: KES ' || CAST(floor(total / 1000000) AS BIGINT) || ' million</p>' AS html
    FROM (SELECT entity_id, CAST(floor(sum(principal)) AS BIGINT) AS total, CAST(floor(sum(principal) FILTER (WHERE starts_with(debt_category, 'EXTERNAL'))) AS BIGINT) AS external, CAST(floor(sum(principal) FILTER (WHERE starts_with(debt_category, 'DOMESTIC'))) AS BIGINT) AS domestic FROM loans GROUP BY 1)"""


@query(rf"""WITH h AS ({REPORT}), x AS (SELECT entity_id, unnest(regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1)) AS row FROM h), c AS (SELECT entity_id, lower({CELL.format("regexp_extract(row, '(?s)<th>(.*?)</th>', 1)")}) AS label, TRY_CAST(regexp_replace({CELL.format("regexp_extract(row, '(?s)<td>(.*?)</td>', 1)")}, '[^0-9.]', '', 'g') AS DOUBLE) AS amount FROM x)
    SELECT entity_id, CASE WHEN contains(label, 'total') AND contains(label, 'debt') THEN 'total' WHEN contains(label, 'external') THEN 'external' ELSE 'domestic' END AS category, amount FROM c WHERE amount IS NOT NULL AND ((contains(label, 'total') AND contains(label, 'debt')) OR contains(label, 'external') OR contains(label, 'domestic'))""")
def debt_table_extract(r: Roles):
    """Debt rows of an HTML table: label and amount cells, classed by the label."""
    cell = lambda c, tag: F.trim(F.regexp_replace(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1), "<[^>]*>", ""))
    rows = _report(r).select("entity_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<tr>(.*?)</tr>"), 1)).alias("row"))
    c = rows.select("entity_id", F.lower(cell("row", "th")).alias("label"), F.regexp_replace(cell("row", "td"), "[^0-9.]", "").try_cast("double").alias("amount"))
    label = F.col("label")
    kind = F.when(label.contains("total") & label.contains("debt"), "total").when(label.contains("external"), "external").when(label.contains("domestic"), "domestic")
    return c.select("entity_id", kind.alias("category"), "amount").where("amount is not null and category is not null")


@query(rf"""WITH h AS ({REPORT}) SELECT entity_id, lower(regexp_extract(t, {DEBTS}, 1)) AS category, round(TRY_CAST(replace(regexp_extract(t, {DEBTS}, 2), ',', '') AS DOUBLE) * CASE lower(regexp_extract(t, {DEBTS}, 3)) WHEN 'trillion' THEN 1e12 WHEN 'billion' THEN 1e9 ELSE 1e6 END, 2) AS amount FROM (SELECT entity_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM h) WHERE regexp_matches(t, {DEBTS})""")
def debt_text_extract(r: Roles):
    """The first debt figure of a report's text."""
    pattern = DEBTS.strip("'")
    t = _report(r).select("entity_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t")).where(F.col("t").rlike(pattern))
    unit = F.lower(F.regexp_extract("t", pattern, 3))
    return t.select("entity_id", F.lower(F.regexp_extract("t", pattern, 1)).alias("category"), F.round(T.number(F.regexp_extract("t", pattern, 2)) * F.when(unit == "trillion", 1e12).when(unit == "billion", 1e9).otherwise(1e6), 2).alias("amount"))


@query("SELECT entity_id, CASE WHEN n < 45 THEN 'fresh' WHEN n <= 180 THEN 'aging' ELSE 'stale' END AS status FROM (SELECT entity_id, date_diff('day', max(issue_date), DATE '2001-12-31') AS n FROM loans WHERE debt_category IS NOT NULL GROUP BY 1)")
def freshness_status(r: Roles):
    """Age in days of the newest loan of each entity at the end of 2001."""
    s = r.loans.where("debt_category is not null").groupBy("entity_id").agg(F.datediff(F.lit("2001-12-31").cast("date"), F.max("issue_date")).alias("n"))
    return s.select("entity_id", F.when(F.col("n") < 45, "fresh").when(F.col("n") <= 180, "aging").otherwise("stale").alias("status"))


@query(f"SELECT entity_id, {HEALTH_SQL} AS score FROM (SELECT entity_id, {pct('sum(spent)', 'sum(allocated)', 1)} AS u FROM budget_lines GROUP BY 1)")
def health_score(r: Roles):
    return r.execution("entity_id").groupBy("entity_id").agg(*sums()).select("entity_id", health(share(F.col("spent"), F.col("allocated"), 1)).alias("score"))


@query("""WITH b AS (SELECT entity_id, sum(allocated) AS a, sum(spent) AS s FROM budget_lines GROUP BY 1), l AS (SELECT entity_id, sum(outstanding) AS o FROM loans GROUP BY 1), p AS (SELECT entity_id, sum(amount) AS p FROM bills GROUP BY 1), x AS (SELECT entity_id, CAST(s AS DOUBLE) / CAST(a AS DOUBLE) AS e, CAST(o AS DOUBLE) / CAST(a AS DOUBLE) AS o, CAST(p AS DOUBLE) / CAST(a AS DOUBLE) AS p FROM b JOIN l USING (entity_id) JOIN p USING (entity_id))
    SELECT entity_id, row_number() OVER (ORDER BY e DESC, entity_id) AS by_execution, row_number() OVER (ORDER BY o, entity_id) AS by_debt, row_number() OVER (ORDER BY p, entity_id) AS by_bills FROM x""")
def weighted_health_d(r: Roles):
    """Ranks over the entities (one row each) by three ratios."""
    from pyspark.sql import Window

    b = r.execution("entity_id").groupBy("entity_id").agg(F.sum("allocated").cast("double").alias("a"), F.sum("spent").cast("double").alias("s"))
    o = r.loans.groupBy("entity_id").agg(F.sum("outstanding").cast("double").alias("o"))
    p = r.bills.groupBy("entity_id").agg(F.sum("amount").cast("double").alias("p"))
    x = b.join(o, "entity_id").join(p, "entity_id")
    rank = lambda c: F.row_number().over(Window.orderBy(c, "entity_id"))
    return x.select("entity_id", rank((F.col("s") / F.col("a")).desc()).alias("by_execution"), rank(F.col("o") / F.col("a")).alias("by_debt"), rank(F.col("p") / F.col("a")).alias("by_bills"))
