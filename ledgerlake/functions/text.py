"""Column expressions that read money, periods, names and findings out of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cascade(rules: list[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(*_pair(rules[0]))
    for r in rules[1:]:
        out = out.when(*_pair(r))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def _pair(rule: tuple[Column, Column | str]) -> tuple[Column, Column]:
    return rule[0], rule[1] if isinstance(rule[1], Column) else F.lit(rule[1])


def number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def kes_amount(text: Column) -> Column:
    """``KES 1,200 million``, ``KSh. 3.5 billion``: the first amount in shillings, null without one."""
    pattern = r"(?i)(?:KES|KSh\.?|Kshs\.?)\s*([\d,]+(?:\.\d+)?)\s*(trillion|billion|million|thousand|T|B|M|K)?\b"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = cascade([(unit.isin("trillion", "t"), F.lit(1e12)), (unit.isin("billion", "b"), F.lit(1e9)), (unit.isin("million", "m"), F.lit(1e6)), (unit.isin("thousand", "k"), F.lit(1e3))], F.lit(1.0))
    return F.round(number(F.regexp_extract(text, pattern, 1)) * scale, 2)


def suffix_amount(text: Column) -> Column:
    """``KES 2.5B``: by the last letter; what isn't a number is 0."""
    digits = F.regexp_replace(F.upper(text), r"[^0-9.]", "").try_cast("double")
    last = F.upper(F.substring(F.trim(text), -1, 1))
    return F.coalesce(digits * cascade([(last == "T", F.lit(1e12)), (last == "B", F.lit(1e9)), (last == "M", F.lit(1e6)), (last == "K", F.lit(1e3))], F.lit(1.0)), F.lit(0.0))


def plain_kes(text: Column) -> Column:
    """Digits after KES, without suffix or decimals."""
    return F.regexp_replace(F.regexp_extract(text, r"KES\s*([\d,]+)", 1), ",", "").try_cast("double")


def percentage(text: Column) -> Column:
    t = F.upper(F.trim(F.replace(text, F.lit("%"), F.lit(""))))
    return F.when(~t.isin("N/A", "NA", "-", ""), F.regexp_replace(t, ",", "").try_cast("double"))


def currency_code(text: Column, default: str = "KES") -> Column:
    found = F.regexp_extract(text, r"\b([A-Z]{3})\b", 1)
    return F.when(found != "", found).otherwise(default)


def accounting_number(text: Column) -> Column:
    """Parentheses and the minus sign both mean negative."""
    t = F.regexp_replace(F.replace(F.trim(text), F.lit("−"), F.lit("-")), ",", "")
    return F.when(t.rlike(r"^\(.*\)$"), -F.regexp_replace(t, r"[()]", "").try_cast("double")).otherwise(t.try_cast("double"))


def decimal_comma(text: Column) -> Column:
    """A single comma before at most two digits is a decimal point; others group thousands."""
    t = F.trim(text)
    return F.when(t.rlike(r"^-?\d+,\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.regexp_replace(t, ",", "")).try_cast("double")


def fiscal_label(text: Column) -> Column:
    """``FY2023/24``, ``2023/2024``, ``2023-24`` or a bare year, as ``FY2023/24``."""
    a = F.regexp_extract(text, r"(?i)(?:FY\s*)?((?:19|20)\d{2})\s*[/-]\s*(?:(?:19|20)?(\d{2}))\b", 1)
    b = F.regexp_extract(text, r"(?i)(?:FY\s*)?((?:19|20)\d{2})\s*[/-]\s*(?:(?:19|20)?(\d{2}))\b", 2)
    y = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.when(a != "", F.concat(F.lit("FY"), a, F.lit("/"), b)).when(y != "", F.format_string("FY%d/%02d", y.try_cast("int"), (y.try_cast("int") + 1) % 100))


def fiscal_confidence(text: Column) -> Column:
    return F.when(text.rlike(r"(?:19|20)\d{2}\s*[/-]\s*(?:(?:19|20)?\d{2})\b"), 0.9).when(text.rlike(r"\b(?:19|20)\d{2}\b"), 0.5)


def period_date(text: Column) -> Column:
    """``YYYY-MM``, ``YYYY-Qn`` or ``YYYY`` as its first day."""
    y = F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    m = F.regexp_extract(text, r"^\d{4}-(\d{2})$", 1).try_cast("int")
    q = F.regexp_extract(text, r"^\d{4}-Q([1-4])$", 1).try_cast("int")
    return F.when(m.isNotNull(), F.make_date(y, m, F.lit(1))).when(q.isNotNull(), F.make_date(y, q * 3 - 2, F.lit(1))).when(y.isNotNull(), F.make_date(y, F.lit(1), F.lit(1)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit("and")), F.lit(" "), F.lit("-")), r"[^a-z0-9-]", "")


def name_key(text: Column) -> Column:
    """Comparable form of an entity name: case, apostrophes, hyphens and a trailing County don't matter."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[‘’'`´]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("-"), F.lit(" ")), r"\s+county$", ""), r"\s+", " "))


# The phrases, classes, names and their order decide the results.
OPINIONS = (("Disclaimer", r"(?i)\bdisclaimer\s+of\s+opinion\b"), ("Adverse", r"(?i)\badverse\s+opinion\b"), ("Unqualified", r"(?i)\bunqualified\s+opinion\b"), ("Qualified", r"(?i)\bqualified\s+opinion\b"))
SEVERITY = (
    ("critical", ("irregular expenditure", "unsupported payment", "unaccounted", "embezzlement", "misappropriation", "fraud")),
    ("warning", ("non-compliance", "late submission", "procurement issue", "weak controls", "pending bills")),
)
QUERY_TYPES = (
    ("Financial Irregularity", ("missing funds", "unaccounted", "irregular payment", "unsupported payment", "unsupported expenditure", "irregular expenditure", "misappropriation", "embezzlement", "fraud", "loss of funds")),
    ("Asset Management", ("missing asset", "unverified asset", "disposal without authority", "asset register", "unaccounted assets", "idle assets", "asset management")),
    ("Procurement", ("tender irregular", "single sourc", "price inflation", "procurement irregular", "procurement process", "direct procurement", "restricted tender", "procurement plan")),
    ("Non-Compliance", ("non-compliance", "failure to comply", "contrary to", "violation of", "statutory requirement", "not in accordance", "failed to follow")),
    ("Payroll/HR", ("ghost worker", "salary irregular", "unapproved allowance", "payroll", "staff cost", "personnel emolument", "human resource")),
    ("Revenue Under-Collection", ("revenue under-collection", "own-source revenue", "revenue shortfall", "revenue target", "uncollected revenue", "below target")),
    ("Cash Management", ("bank reconciliation", "overdraft", "cash management", "cash book", "unreconciled", "cash balance", "imprest")),
    ("Weak Internal Controls", ("missing documentation", "approval gap", "weak internal control", "weak controls", "internal control", "lack of documentation", "inadequate documentation", "segregation of duties")),
)
COUNTIES = (
    "Nairobi", "Mombasa", "Kisumu", "Nakuru", "Kiambu", "Machakos", "Uasin Gishu", "Kajiado", "Kakamega", "Bungoma", "Kericho", "Bomet", "Turkana", "West Pokot", "Samburu", "Trans Nzoia",
    "Elgeyo Marakwet", "Nandi", "Baringo", "Laikipia", "Narok", "Siaya", "Homa Bay", "Migori", "Kisii", "Nyamira", "Busia", "Vihiga", "Embu", "Meru", "Tharaka Nithi", "Kitui", "Makueni",
    "Nyandarua", "Nyeri", "Kirinyaga", "Garissa", "Wajir", "Mandera", "Marsabit", "Isiolo", "Kilifi", "Tana River", "Lamu", "Taita Taveta",
)


#: Known names with their canonical form, in the order in which equal matches are decided.
COUNTY_NAMES = (
    ("mombasa", "Mombasa County"), ("kwale", "Kwale County"), ("kilifi", "Kilifi County"), ("tana river", "Tana River County"), ("lamu", "Lamu County"), ("taita taveta", "Taita-Taveta County"),
    ("garissa", "Garissa County"), ("wajir", "Wajir County"), ("mandera", "Mandera County"), ("marsabit", "Marsabit County"), ("isiolo", "Isiolo County"), ("meru", "Meru County"),
    ("tharaka nithi", "Tharaka-Nithi County"), ("embu", "Embu County"), ("kitui", "Kitui County"), ("machakos", "Machakos County"), ("makueni", "Makueni County"), ("nyandarua", "Nyandarua County"),
    ("nyeri", "Nyeri County"), ("kirinyaga", "Kirinyaga County"), ("muranga", "Murang'a County"), ("kiambu", "Kiambu County"), ("turkana", "Turkana County"), ("west pokot", "West Pokot County"),
    ("samburu", "Samburu County"), ("trans nzoia", "Trans-Nzoia County"), ("uasin gishu", "Uasin Gishu County"), ("elgeyo marakwet", "Elgeyo-Marakwet County"), ("nandi", "Nandi County"), ("baringo", "Baringo County"),
    ("laikipia", "Laikipia County"), ("nakuru", "Nakuru County"), ("narok", "Narok County"), ("kajiado", "Kajiado County"), ("kericho", "Kericho County"), ("bomet", "Bomet County"), ("kakamega", "Kakamega County"),
    ("vihiga", "Vihiga County"), ("bungoma", "Bungoma County"), ("busia", "Busia County"), ("siaya", "Siaya County"), ("kisumu", "Kisumu County"), ("homa bay", "Homa Bay County"), ("homabay", "Homa Bay County"),
    ("migori", "Migori County"), ("kisii", "Kisii County"), ("nyamira", "Nyamira County"), ("nairobi", "Nairobi County"),
)
MINISTRY_NAMES = (
    ("health", "Ministry of Health"), ("education", "Ministry of Education"), ("treasury", "National Treasury"), ("defense", "Ministry of Defense"), ("interior", "Ministry of Interior and National Administration"),
    ("transport", "Ministry of Transport and Infrastructure"), ("agriculture", "Ministry of Agriculture and Livestock Development"),
)
AGENCY_NAMES = (("kra", "Kenya Revenue Authority"), ("kenha", "Kenya National Highways Authority"), ("nema", "National Environment Management Authority"))
LENDERS = (
    ("external_multilateral", ("world bank", "imf", "afdb", "eib", "ifad", "ifc")),
    ("external_bilateral", ("china", "japan", "france", "germany", "united states", "korea", "india", "belgium", "uk", "italy")),
    ("external_commercial", ("eurobond", "syndicated", "commercial")),
    ("domestic_bonds", ("treasury bond", "infrastructure bond", "green bond", "m-akiba", "retail bond")),
    ("domestic_bills", ("treasury bill", "t-bill", "91-day", "182-day", "364-day")),
    ("domestic_overdraft", ("central bank", "cbk", "overdraft")),
    ("pending_bills", ("pending bill", "arrears")),
    ("county_guaranteed", ("county", "nairobi", "mombasa", "kisumu", "nakuru")),
)
LENDER_TYPES = (("Multilateral", ("world bank", "imf", "african development", "adb")), ("Bilateral", ("china", "france", "japan", "uk", "usa")), ("Commercial", ("bond", "eurobond", "commercial")))
BILL_TYPES = (("salary", ("salary", "wage")), ("pension", ("pension",)), ("statutory", ("statutory",)), ("court_awards", ("court", "award")))
DOCUMENTS = (("audit", ("audit", "auditor")), ("budget", ("budget", "allocation")), ("report", ("implementation", "review", "expenditure")), ("loan", ("debt", "loan", "borrowing")))
OPINION_WORDS = (("Unqualified", ("unqualified",)), ("Qualified", ("qualified",)), ("Adverse", ("adverse",)), ("Disclaimer of Opinion", ("disclaimer of opinion",)))

CANDIDATE_GOOD = ("report", "budget", "implementation", "birr", "county", "national", "fy", "financial", "annual")
CANDIDATE_BAD = ("logo", "branding", "letterhead", "template", "guideline")
RELEVANT_HIGH = ("cbirr", "budget implementation", "county", "absorption")
RELEVANT_MEDIUM = ("quarterly", "review", "performance", "budget")

GAZETTEER = [(key, name, kind) for kind, names in (("county", COUNTY_NAMES), ("ministry", MINISTRY_NAMES), ("agency", AGENCY_NAMES)) for key, name in names]


def phrase_class(text: Column, classes, default: str | None = None) -> Column:
    """The first class of which the text holds a phrase, in any case."""
    return cascade([(holds_any(text, w), n) for n, w in classes], default)


def opinion(text: Column) -> Column:
    return cascade([(text.rlike(p), n) for n, p in OPINIONS])


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def severity(text: Column, amount: Column) -> Column:
    """By the first class with a phrase in the text, else by the amount."""
    return cascade([(holds_any(text, w), n) for n, w in SEVERITY] + [(amount >= 50e6, "critical"), (amount >= 5e6, "warning")], "info")


def query_type(text: Column) -> Column:
    return phrase_class(text, QUERY_TYPES)


def lender_kind(text: Column) -> Column:
    """One of eight kinds of loan by the lender's name."""
    return phrase_class(text, LENDERS, "other")


def lender_type(text: Column) -> Column:
    """The coarser classes of debt reports."""
    return phrase_class(text, LENDER_TYPES, "Other")


def bill_kind(text: Column) -> Column:
    return phrase_class(text, BILL_TYPES, "supplier_arrears")


def document_kind(title: Column) -> Column:
    return phrase_class(title, DOCUMENTS, "other")


def opinion_after_heading(text: Column) -> Column:
    """The first of the words, in their order, in the 200 characters after the first "Opinion" that so many follow."""
    near = F.regexp_extract(text, r"(?is)opinion(.{200})", 1)
    return F.coalesce(F.when(near != "", phrase_class(near, OPINION_WORDS)), F.lit("Unknown"))


def recommendation(text: Column) -> Column:
    """What follows ``Recommendation:`` in the last line."""
    found = F.regexp_extract(text, r"(?i)recommendation[:-]\s*(.+)\z", 1)
    return F.when(found != "", F.trim(found))


def relevance(text: Column, strong: tuple[str, ...], weak: tuple[str, ...]) -> Column:
    t = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(t.contains(w), k).otherwise(0) for ws, k in ((strong, 10), (weak, 5)) for w in ws])


def candidate_score(url: Column, title: Column) -> Column:
    """How much a file looks like a report: ten for each good term of either, less fifteen for a bad one, a bonus for its path and kind."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    points = [F.when(u.contains(w) | t.contains(w), k).otherwise(0) for ws, k in ((CANDIDATE_GOOD, 10), (CANDIDATE_BAD, -15)) for w in ws]
    return reduce(lambda a, b: a + b, points) + F.when(u.contains("/wp-content/uploads/"), 8).otherwise(0) + F.when(u.rlike(r"\.pdf($|\?)"), 5).otherwise(0)


def money_in_kes(text: Column, usd_rate: float = 129.0) -> Column:
    """Amount in shillings of a KES or USD figure with an optional word for its size; a bare number as it is."""
    pattern = r"(?i)\b(KES|KSh|USD)\.?\s*([\d,]+(?:\.\d+)?)\s*(billion|million|thousand)?"
    unit = F.lower(F.regexp_extract(text, pattern, 3))
    scale = cascade([(unit == "billion", F.lit(1e9)), (unit == "million", F.lit(1e6)), (unit == "thousand", F.lit(1e3))], F.lit(1.0))
    rate = F.when(F.upper(F.regexp_extract(text, pattern, 1)) == "USD", usd_rate).otherwise(1.0)
    found = number(F.regexp_extract(text, pattern, 2)) * scale * rate
    return F.round(F.coalesce(found, number(F.regexp_extract(text, r"([\d,]*\d(?:\.\d+)?)", 1))), 2)


def amount_before_kes(text: Column) -> Column:
    """The figure that stands before the word KES, scaled by its B or M; null without either."""
    pattern = r"([\d.]+)\s*([BM])\s*KES"
    unit = F.regexp_extract(text, pattern, 2)
    return F.round(F.regexp_extract(text, pattern, 1).try_cast("double") * F.when(unit == "B", 1e9).when(unit == "M", 1e6), 2)


def context_amount(text: Column) -> Column:
    """The first figure, scaled by a size word near it; small figures without one are billions, middling ones millions."""
    v = number(F.regexp_extract(text, r"([\d,]*\d(?:\.\d+)?)", 1))
    near = F.lower(F.regexp_extract(text, r"((?:.{0,30})\d(?:.{0,30}))", 1))
    return F.round(F.when(near.contains("billion"), v * 1e9).when(near.contains("million"), v * 1e6).when(v < 100, v * 1e9).when(v < 1e5, v * 1e6).otherwise(v), 2)


def response(text: Column) -> Column:
    """What follows ``Management response:`` up to a line in capitals."""
    found = F.regexp_extract(text, r"(?s)Management [Rr]esponse:\s*(.*?)(?:\n[A-Z][A-Z ]+\n|$)", 1)
    return F.when(found != "", F.trim(found))


def indicator(text: Column, word: str, low: float, high: float) -> Column:
    """The percentage after ``word``, null outside its sane range."""
    v = F.regexp_extract(text, rf"(?i){word}\D{{0,40}}?(\d+(?:\.\d+)?)\s*(?:%|per cent|percent)", 1).try_cast("double")
    return F.when((v >= low) & (v <= high), v)


def similarity(text: Column, name: str, least: int = 70) -> Column:
    """Levenshtein similarity to ``name`` in percent of the longer one, null where it can't exceed ``least``.

    A text that similar is at most ``100 / least`` times as long as the name, so the distance is computed up to a bound.
    """
    d = F.levenshtein(text, F.lit(name), len(name) * (100 - least) // least + 1)
    return F.when(d >= 0, F.round(100.0 * (1 - d / F.greatest(F.length(text), F.lit(len(name)))), 2))


def strict_amount(text: Column) -> Column:
    """An amount that is nothing but a number, with an optional KES before it and a B or M in it; anything else is 0."""
    t = F.trim(F.replace(text, F.lit("KES"), F.lit("")))
    plain = F.when(F.regexp_replace(t, "[.,]", "").rlike(r"^\d+$"), number(t))
    value = F.when(t.contains("B"), F.replace(t, F.lit("B"), F.lit("")).try_cast("double") * 1e9).when(t.contains("M"), F.replace(t, F.lit("M"), F.lit("")).try_cast("double") * 1e6).otherwise(plain)
    return F.round(F.coalesce(value, F.lit(0.0)), 2)


def bill_amount(text: Column) -> Column:
    """A pending bill's amount: a number with an optional currency before it; null for dashes and words."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), "[, ]", ""), r"(?i)^(?:KES|Kshs?\.?)\s*", "")
    return F.when(t.rlike(r"^[-+]?\d+(\.\d+)?$"), t.try_cast("double"))


def flexible_time(text: Column) -> Column:
    """ISO date or time, ``YYYY-MM``, ``YYYY`` or epoch seconds, in UTC."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2})?$"), F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp"))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")).try_cast("timestamp"))
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")).try_cast("timestamp"))
    epoch = F.when(text.rlike(r"^\d{9,10}$"), F.timestamp_seconds(text.try_cast("bigint")))
    return F.coalesce(day, month, year, epoch)
