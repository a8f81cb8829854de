"""Further readers of audit reports and statistics: lines that are findings, amounts with a size word further on, all responses
of the management, signed currency amounts, fiscal periods with their days, and macro figures within sane bounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Roles, query

# The patterns and their order decide the results.
AMOUNTS = (r"(?i)(?:KES|Ksh\.?|KSh\.?|Kshs\.?|K\.Sh\.?|Sh\.?)\s*([\d,]+(?:\.\d+)?)\s*(million|billion|thousand)?", r"(?i)([\d,]+(?:\.\d+)?)\s*(?:million|billion|thousand)?\s*(?:KES|Ksh|KSh)")
MONEY_TOKEN = r"(?i)\b(KES|Ksh|KSh|US\$|USD|,\d{3})\b"
FINDING_WORDS = r"(?i)audit|query|finding|irregular|unaccounted|pending bills|procurement|unsupported|vouch|loss|embezzlement"
CUES = (r"management responses?", r"audit findings?", r"recommendations?", r"basis of opinion", r"qualified opinion|adverse opinion|disclaimer")
RESPONSES = (r"(?:management|entity|auditee)\s+response[s:]?", r"(?:response\s+by\s+management|management\s+comment)[s:]?")
PERIODS = (r"(?i)FY\s*(\d{4})[\/\-](\d{2,4})", r"(?i)(\d{4})[\/\-](\d{2,4})\s*FY", r"(?i)Financial\s+Year\s+(\d{4})[\/\-](\d{2,4})")
POPULATION = (
    r"(?:total\s+)?population[:\s]+([0-9]+\.?[0-9]*)\s*(?:million|m\b)", r"(?:population[:\s]+of[:\s]+)?([0-9]{2,3}(?:,[0-9]{3})+)\s*(?:people|persons|inhabitants)?",
    r"population\s+(?:is|was|stands\s+at|estimated\s+at)[:\s]+([0-9]+\.?[0-9]*)", r"\b([4-5][0-9]\.[0-9])\s*million\s+(?:people|kenyans|population)", r"(?:census|enumeration)[:\s]+(?:total[:\s]+)?([0-9]{2,3}(?:,[0-9]{3})+)",
)
GDP = (
    r"(?:gdp|gross\s+domestic\s+product)[:\s]+(?:ksh\.?|kshs?\.?)?[:\s]*([0-9]+\.?[0-9]*)\s*(?:trillion|tn|t\b)", r"(?:gdp|gross\s+domestic\s+product)[:\s]+(?:of\s+)?(?:ksh\.?|kshs?\.?)?[:\s]*([0-9,]+(?:\.[0-9]+)?)\s*(?:billion|bn|b\b)",
    r"gdp\s+(?:stood\s+at|was|is|estimated\s+at)[:\s]+(?:ksh\.?)?[:\s]*([0-9,]+(?:\.[0-9]+)?)\s*(?:trillion|billion|million)", r"economy\s+(?:recorded|grew\s+by|expanded\s+to)[:\s]+(?:ksh\.?)?[:\s]*([0-9]+\.?[0-9]*)\s*(?:trillion|tn)",
)
RATES = {
    "inflation": (50, (r"inflation[:\s]+(?:rate[:\s]+)?(?:was|is|stood\s+at|recorded\s+at)?[:\s]*([0-9]+\.?[0-9]*)%", r"(?:overall\s+)?inflation\s+(?:averaged|reached|was)[:\s]+([0-9]+\.?[0-9]*)%", r"cpi[:\s]+inflation[:\s]+(?:of\s+)?([0-9]+\.?[0-9]*)%", r"consumer\s+price\s+index[:\s]+([0-9]+\.?[0-9]*)%")),
    "unemployment": (50, (r"unemployment[:\s]+(?:rate[:\s]+)?(?:was|is|stood\s+at)?[:\s]*([0-9]+\.?[0-9]*)%", r"unemployment\s+(?:stood\s+at|was\s+at|recorded\s+at)[:\s]+([0-9]+\.?[0-9]*)%", r"([0-9]+\.?[0-9]*)%\s+unemployment")),
    "poverty": (100, (r"poverty[:\s]+(?:rate[:\s]+)?(?:was|is|stood\s+at)?[:\s]*([0-9]+\.?[0-9]*)%", r"([0-9]+\.?[0-9]*)%\s+(?:of\s+(?:the\s+)?population\s+)?(?:live|living)\s+(?:below|in)\s+poverty", r"poverty\s+(?:incidence|level)[:\s]+([0-9]+\.?[0-9]*)%")),
}

#: A text without these in lower case (one of them) has no match of the pattern at the same place above.
POPULATION_WORDS = ("population", ",", "population", "million", "census|enumeration")
GDP_WORDS = ("gdp|gross", "gdp|gross", "gdp", "economy")
RATE_WORDS = {"inflation": ("inflation", "inflation", "inflation", "consumer"), "unemployment": ("unemployment",) * 3, "poverty": ("poverty",) * 3}


def flat(text: Column) -> Column:
    """White space as single spaces."""
    return F.regexp_replace(text, r"\s+", " ")


def around(pattern: str, n: int) -> str:
    """``pattern`` with up to ``n`` characters before and after its first match; its group is the first."""
    return rf"(?i).{{0,{n}}}?(?:{pattern}).{{0,{n}}}"


def audit_amount(text: Column) -> Column:
    """The first amount in shillings, before the word or after it; a million or billion may stand up to 20 characters on."""

    def read(pattern: str, has_unit: bool) -> Column:
        value = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("decimal(28,4)").cast("double")
        after = F.regexp_extract(text, pattern.replace("(?i)", "(?is)") + "(.{0,20})", 3 if has_unit else 2)
        near = F.when(after.rlike(r"(?i)\bmillion\b"), 1e6).when(after.rlike(r"(?i)\bbillion\b"), 1e9).otherwise(1.0)
        unit = F.lower(F.regexp_extract(text, pattern, 2)) if has_unit else F.lit("")
        return F.round(value * F.when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "thousand", 1e3).otherwise(near), 2)

    return F.coalesce(read(AMOUNTS[0], True), read(AMOUNTS[1], False))


def is_finding(line: Column) -> Column:
    """A money token, a word of audits, or a heading of their sections."""
    return line.rlike(MONEY_TOKEN) | line.rlike(FINDING_WORDS) | line.rlike("(?i)" + "|".join(CUES))


def responses(text: Column) -> Column:
    """All that the management answered: what follows each heading within 2000 characters, up to a heading in capitals."""

    def after(p: str) -> Column:
        heads, parts = F.regexp_extract_all(text, F.lit(f"(?im)(^{p})"), 1), F.split(text, f"(?im)^{p}", -1)
        long = lambda xs, i: F.aggregate(F.slice(xs, 1, i), F.lit(0), lambda n, x: n + F.length(x))
        at = F.transform(F.sequence(F.lit(1), F.size(heads)), lambda i: F.substr(text, 1 + long(parts, i) + long(heads, i), F.lit(2000)))
        return F.when(F.size(heads) > 0, at).otherwise(F.array().cast("array<string>"))

    cut = lambda x: F.trim(F.regexp_replace(x, r"(?s)\n\s*(?:\d+\.?\s+)?[A-Z][A-Z ]{5,}.*\z", ""), F.lit(" \n\t\r"))
    return F.filter(F.transform(F.concat(*map(after, RESPONSES)), cut), lambda x: x != "")


def currency_amount(text: Column) -> Column:
    """The first number, with its sign, once commas and spaces are gone; 0 without one."""
    t = F.regexp_replace(F.trim(text), "[, ]", "")
    return F.coalesce(F.regexp_extract(t, r"(-?\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def currency_of(text: Column, default: str = "KES") -> Column:
    """The first three capitals, once commas and spaces are gone."""
    found = F.regexp_extract(F.regexp_replace(F.trim(text), "[, ]", ""), "([A-Z]{3})", 1)
    return F.when(found != "", found).otherwise(default)


def fiscal_period(text: Column) -> Column:
    """The period in a text, if it has one, as an array: label, first and last day (July to June) and confidence, of two years
    or of the first year."""
    t = F.trim(text)

    def two(p: str) -> Column:
        end = F.regexp_extract(t, p, 2)
        return F.struct(F.regexp_extract(t, p, 1).try_cast("int").alias("a"), F.when(F.length(end) == 2, F.concat(F.lit("20"), end)).otherwise(end).try_cast("int").alias("b"), F.lit(0.9).alias("sure"))

    year = F.regexp_extract(t, r"(\d{4})", 1).try_cast("int")
    tries = F.array(*map(two, PERIODS), F.struct(year.alias("a"), (year + 1).alias("b"), F.lit(0.5).alias("sure")))
    found = F.slice(F.filter(tries, lambda x: x["a"].between(1, 9999) & x["b"].between(1, 9999)), 1, 1)
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))

    def row(x: Column) -> Column:
        label = F.concat(F.lit("FY"), x["a"].cast("string"), F.lit("/"), F.substring(x["b"].cast("string"), 3, 10))
        return F.struct(label.alias("label"), day(x["a"], 7, 1).alias("first"), day(x["b"], 6, 30).alias("last"), x["sure"].alias("confidence"))

    return F.transform(found, row)


def sane(values: list[Column], low: float, high: float) -> Column:
    """The first of the values that is within bounds; each is computed once."""
    return F.get(F.filter(F.array(*values), lambda v: v.between(low, high)), 0)


def seek(text: Column, low: Column, words: str, pattern: str) -> Column:
    """What the group of the first match holds; a text without any of the words, lower cased in ``low``, isn't searched."""
    return F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in words.split("|"))), F.regexp_extract(text, "(?i)" + pattern, 1))


def scale_near(text: Column, pattern: str, n: int, scale: Callable[[Column], Column]) -> Column:
    """``scale`` of the first match with up to ``n`` characters before and after it, in lower case, found in one go through the text."""
    whole = f"(?is)^(.*?)((?:{pattern}).{{0,{n}}})"
    near = F.lower(F.concat(F.right(F.regexp_extract(text, whole, 1), F.lit(n)), F.regexp_extract(text, whole, 2)))
    return F.get(F.transform(F.array(near), scale), 0)


def population(text: Column) -> Column:
    """People in a text of 50 characters or more, between 10 and 100 millions."""
    return people_in(text, flat(text), F.lower(flat(text)))


def people_in(text: Column, t: Column, low: Column) -> Column:
    scale = lambda near: F.when(near.contains("million") | near.contains(" m ") | near.contains("mn"), 1e6).otherwise(1.0)

    def read(p: str, words: str) -> Column:
        v = T.number(seek(t, low, words, p))
        return F.when(v.isNotNull(), F.floor(v * scale_near(t, p, 100, scale)))

    return F.when(F.length(text) >= 50, sane([read(p, w) for p, w in zip(POPULATION, POPULATION_WORDS, strict=True)], 10_000_000, 100_000_000))


def gdp(text: Column) -> Column:
    """Gross domestic product between 1 and 50 trillions."""
    return gdp_in(flat(text), F.lower(flat(text)))


def gdp_in(t: Column, low: Column) -> Column:
    scale = lambda near: F.when(near.rlike("trillion| tn| t "), 1e12).when(near.rlike("billion| bn| b "), 1e9).when(near.contains("million"), 1e6).otherwise(1.0)

    def read(p: str, words: str) -> Column:
        v = T.number(seek(t, low, words, p))
        return F.when(v.isNotNull(), F.round(v * scale_near(t, p, 50, scale), 2))

    return sane([read(p, w) for p, w in zip(GDP, GDP_WORDS, strict=True)], 1e12, 50e12)


def rate(text: Column, name: str) -> Column:
    """The first rate of a name that is within its bounds."""
    return rate_in(flat(text), F.lower(flat(text)), name)


def rate_in(t: Column, low: Column, name: str) -> Column:
    most, patterns = RATES[name]
    return sane([seek(t, low, w, p).try_cast("double") for p, w in zip(patterns, RATE_WORDS[name], strict=True)], 0, most)


def _num(x: str) -> str:
    return f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"


def _amount_sql(p: str, has_unit: bool) -> str:
    after = f"regexp_extract(t, '{p.replace('(?i)', '(?is)')}(.{{0,20}})', {3 if has_unit else 2})"
    near = f"CASE WHEN regexp_matches({after}, '(?i)\\bmillion\\b') THEN 1e6 WHEN regexp_matches({after}, '(?i)\\bbillion\\b') THEN 1e9 ELSE 1 END"
    unit = f"lower(regexp_extract(t, '{p}', 2))" if has_unit else "''"
    return f"round({_num(f"nullif(regexp_extract(t, '{p}', 1), '')")} * CASE {unit} WHEN 'million' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'thousand' THEN 1e3 ELSE {near} END, 2)"


AMOUNT_SQL = f"coalesce({_amount_sql(AMOUNTS[0], True)}, {_amount_sql(AMOUNTS[1], False)})"


@query(f"SELECT k, t, {AMOUNT_SQL} AS amount FROM remarks")
def audit_amounts(r: Roles):
    return r.remarks.select("k", "t", audit_amount(F.col("t")).alias("amount"))


@query(f"""SELECT k, line, t AS finding, {AMOUNT_SQL} AS amount, nullif(trim(regexp_extract(t, '(?i)recommendation[:-]\\s*(.+)$', 1)), '') AS recommendation FROM (SELECT k, trim(unnest(string_split(t, chr(10)))) AS t, CAST(generate_subscripts(string_split(t, chr(10)), 1) AS INTEGER) AS line FROM remarks)
    WHERE t <> '' AND (regexp_matches(t, '{MONEY_TOKEN}') OR regexp_matches(t, '{FINDING_WORDS}') OR regexp_matches(t, '(?i){"|".join(CUES)}'))""")
def finding_lines(r: Roles):
    """The lines of remarks that are findings, with amount and recommendation."""
    lines = r.remarks.select("k", F.posexplode(F.split("t", "\n", -1)).alias("line", "t")).select("k", (F.col("line") + 1).alias("line"), F.trim("t").alias("t"))
    advice = F.trim(F.regexp_extract("t", r"(?i)recommendation[:-]\s*(.+)$", 1))
    return lines.where((F.col("t") != "") & is_finding(F.col("t"))).select("k", "line", F.col("t").alias("finding"), audit_amount(F.col("t")).alias("amount"), F.nullif(advice, F.lit("")).alias("recommendation"))


def _after_sql(p: str) -> str:
    heads, parts = f"regexp_extract_all(t, '(?im)(^{p})', 1)", f"string_split_regex(t, '(?im)^{p}')"
    long = lambda xs: f"list_sum(list_transform({xs}[1:i], lambda s: len(s)))"
    return f"list_transform(range(1, len({heads}) + 1), lambda i: substr(t, 1 + CAST({long(parts)} + {long(heads)} AS BIGINT), 2000))"


_FOUND = f"list_concat({', '.join(map(_after_sql, RESPONSES))})"


@query(rf"SELECT k, CAST(len(x) AS INTEGER) AS n, array_to_string(x, ' | ') AS responses FROM (SELECT k, list_filter(list_transform({_FOUND}, lambda x: trim(regexp_replace(x, '(?s)\n\s*(?:\d+\.?\s+)?[A-Z][A-Z ]{{5,}}.*\z', ''), ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS x FROM remarks) WHERE len(x) > 0")
def management_responses(r: Roles):
    """Every answer of the management in a remark."""
    x = r.remarks.select("k", responses(F.col("t")).alias("x")).where(F.size("x") > 0)
    return x.select("k", F.size("x").alias("n"), F.array_join("x", " | ").alias("responses"))


@query(r"SELECT k, t, coalesce(TRY_CAST(nullif(regexp_extract(x, '(-?\d+\.?\d*)', 1), '') AS DOUBLE), 0) AS amount, coalesce(nullif(regexp_extract(x, '([A-Z]{3})', 1), ''), 'KES') AS currency FROM (SELECT k, t, regexp_replace(trim(t), '[, ]', '', 'g') AS x FROM remarks)")
def currency_amounts(r: Roles):
    return r.remarks.select("k", "t", currency_amount(F.col("t")).alias("amount"), currency_of(F.col("t")).alias("currency"))


_TWO = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {{'a': CAST(regexp_extract(t, '{p}', 1) AS INTEGER), 'b': CAST(CASE WHEN len(regexp_extract(t, '{p}', 2)) = 2 THEN '20' ELSE '' END || regexp_extract(t, '{p}', 2) AS INTEGER), 'c': 0.9::DOUBLE}} END" for p in PERIODS)


@query(rf"""SELECT k, 'FY' || x.a || '/' || substr(CAST(x.b AS VARCHAR), 3) AS label, TRY_CAST(printf('%04d-07-01', x.a) AS DATE) AS first, TRY_CAST(printf('%04d-06-30', x.b) AS DATE) AS last, x.c AS confidence
    FROM (SELECT k, coalesce({_TWO}, CASE WHEN regexp_matches(t, '\d{{4}}') THEN {{'a': CAST(regexp_extract(t, '(\d{{4}})', 1) AS INTEGER), 'b': CAST(regexp_extract(t, '(\d{{4}})', 1) AS INTEGER) + 1, 'c': 0.5::DOUBLE}} END) AS x FROM (SELECT k, trim(t) AS t FROM remarks)) WHERE x IS NOT NULL AND x.a > 0 AND x.b BETWEEN 1 AND 9999""")
def fiscal_periods(r: Roles):
    """The fiscal period of each remark that has one, with its days."""
    return r.remarks.select("k", F.explode(fiscal_period(F.col("t"))).alias("x")).select("k", "x.*")


def _macro_sql(patterns, n: int, units: str, low: str, high: str, whole: bool) -> str:
    out = []
    for p in patterns:
        value, near = f"regexp_extract(x, '{around(p, n)}', 1)", f"lower(regexp_extract(x, '{around(p, n)}', 0))"
        v = f"{_num(f"nullif({value}, '')")} * CASE {units.format(near)} ELSE 1 END"
        v = f"CAST(floor({v}) AS BIGINT)" if whole else f"round({v}, 2)"
        out.append(f"CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END")
    return f"coalesce({', '.join(out)})"


_PEOPLE = _macro_sql(POPULATION, 100, "WHEN contains({0}, 'million') OR contains({0}, ' m ') OR contains({0}, 'mn') THEN 1e6", "10000000", "100000000", True)
_GDP = _macro_sql(GDP, 50, "WHEN regexp_matches({0}, 'trillion| tn| t ') THEN 1e12 WHEN regexp_matches({0}, 'billion| bn| b ') THEN 1e9 WHEN contains({0}, 'million') THEN 1e6", "1e12", "50e12", False)
_RATES = ", ".join(f"coalesce({', '.join(f"CASE WHEN TRY_CAST(regexp_extract(x, '(?i){p}', 1) AS DOUBLE) BETWEEN 0 AND {most} THEN TRY_CAST(regexp_extract(x, '(?i){p}', 1) AS DOUBLE) END" for p in ps)}) AS {n}" for n, (most, ps) in RATES.items())


@query(rf"SELECT k, CASE WHEN len(t) >= 50 THEN {_PEOPLE} END AS population, {_GDP} AS gdp, {_RATES} FROM (SELECT k, t, regexp_replace(t, '\s+', ' ', 'g') AS x FROM surveys)")
def macro_indicators(r: Roles):
    """Population, product and three rates of each statement, where they are sane."""
    x = r.surveys.select("k", "t", flat(F.col("t")).alias("x")).select("k", "t", "x", F.lower("x").alias("low"))
    t, low = F.col("x"), F.col("low")
    return x.select("k", people_in(F.col("t"), t, low).alias("population"), gdp_in(t, low).alias("gdp"), *(rate_in(t, low, n).alias(n) for n in RATES))


_BRACKET = "CASE WHEN {0} < 500000 THEN '<500k' WHEN {0} < 1000000 THEN '500k-1M' WHEN {0} < 2000000 THEN '1M-2M' ELSE '>2M' END"


@query(f"""WITH p AS (SELECT entity_id, arg_max(people, year) AS people FROM population GROUP BY 1), f AS (SELECT entity_id, sum(amount) AS flagged FROM findings GROUP BY 1), e AS (SELECT e.entity_id AS entity_id, {_BRACKET.format("coalesce(people, 0)")} AS bracket, coalesce(flagged, 0) AS flagged FROM entities e LEFT JOIN p ON p.entity_id = e.entity_id LEFT JOIN f ON f.entity_id = e.entity_id)
    SELECT entity_id, bracket, CAST(round(flagged, 2) AS DOUBLE) AS flagged, coalesce(round(CAST(sum(flagged) OVER w - flagged AS DOUBLE) / nullif(count(*) OVER w - 1, 0), 2), 0) AS peers_flagged, count(*) OVER w - 1 AS peers FROM e WINDOW w AS (PARTITION BY bracket)""")
def bracket_peers(r: Roles):
    """Flagged amounts of each entity beside the mean of the others in its bracket of population (one row an entity)."""
    people = r.population.groupBy("entity_id").agg(F.max_by("people", "year").alias("people"))
    flagged = r.findings.groupBy("entity_id").agg(F.sum("amount").alias("flagged"))
    n = F.coalesce("people", F.lit(0))
    bracket = F.when(n < 500_000, "<500k").when(n < 1_000_000, "500k-1M").when(n < 2_000_000, "1M-2M").otherwise(">2M")
    e = r.entities.join(people, "entity_id", "left").join(flagged, "entity_id", "left").select("entity_id", bracket.alias("bracket"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    w = Window.partitionBy("bracket")
    others = F.count("*").over(w) - 1
    mean = F.round((F.sum("flagged").over(w) - F.col("flagged")).cast("double") / F.nullif(others, F.lit(0)), 2)
    return e.select("entity_id", "bracket", F.round("flagged", 2).cast("double").alias("flagged"), F.coalesce(mean, F.lit(0.0)).alias("peers_flagged"), others.alias("peers"))
