"""Names by the share of matching blocks, mentions and sections, against plain versions."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest

from ledgerlake.functions import text as T
from ledgerlake.operators import mentions as M
from ledgerlake.operators import names as N


def plain_name(raw, names):
    a = raw.strip(" ").lower()
    if not a:
        return None
    bare = lambda x: re.sub(r"\s+county$", "", x)
    plain = re.sub("[‘’'`´]", "", a)
    forms = {a, bare(a), a.replace("-", " "), bare(a.replace("-", " ")), plain, bare(plain)}
    for _, key, name, kind in sorted(names):
        if key in forms:
            return name, kind, 100
    found, most = None, 70
    for _, key, name, kind in sorted(names):
        score = max(round(100 * SequenceMatcher(None, a, x).ratio()) for x in (name.lower(), key))
        if score > most:
            found, most = (name, kind, score), score
    return found


def spoiled(r, name):
    s = list(name)
    for _ in range(r.randint(0, 4)):
        at = r.randrange(len(s) + 1)
        r.choice([lambda: s.insert(at, r.choice("aeinrstk '-")), lambda: s.pop(min(at, len(s) - 1)) if len(s) > 1 else None, lambda: s.reverse() if r.random() < 0.1 else None])()
    return "".join(s)


@pytest.mark.parametrize("table", ["gazetteer", "many"])
def test_best_name_of_all(spark, table):
    r = random.Random(7)
    if table == "gazetteer":
        names = [(i, *x) for i, x in enumerate(T.GAZETTEER)]
    else:
        stem = lambda: "".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(2, 12)))
        names = [(i, k, k.title() + r.choice([" County", "", " of " + stem()]), "x") for i, k in enumerate({stem() for _ in range(150)})]
    raw = [spoiled(r, r.choice(names)[1 + r.randint(0, 1)]) for _ in range(250)] + ["", " ", None, "Trans-Nzoia County", "MURANG'A county", "a", "zz", "x" * 300, "Ministry of Helth", "nairobbi"]
    want = {t: w for t in raw if t is not None and (w := plain_name(t, names))}
    df = N.match_names(spark.createDataFrame([(t,) for t in raw], "t string"), spark.createDataFrame(names, "i int, key string, name string, kind string"))
    rows = df.collect()
    assert {x["t"]: (x["name"], x["kind"], x["score"]) for x in rows} == want and len(rows) == len(want)
    assert all(x["confidence"] == x["score"] / 100 for x in rows)


@pytest.mark.parametrize("size", range(2, 46))
def test_keys_of_the_join_are_never_missed(size):
    """Texts that are close enough share a pair of characters, or a character where both are short."""
    m = next(m for m in range(size) if 200 * m > 70.5 * size)
    blocks = 1 + (size - 2 * m)
    assert m >= 1 if size < N.SHORT else m - blocks >= 1


def test_mentions_inside_words_and_of_any_length(spark):
    texts = [(1, "NAIROBI and nairobi, Nairobians"), (2, "aaaa"), (3, None), (4, ""), (5, "x🙂yz x🙂y"), (6, "ab" * 5000 + "needle"), (7, "nairob")]
    names = [(1, "Nairobi"), (2, "aa"), (3, "🙂y"), (4, "needle"), (5, ""), (6, None), (7, "z"), (8, "nairobi county"), (9, "NAIROBI")]
    got = {(x["id"], x["entity"]): x["n"] for x in M.mentions(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(names, "entity int, name string")).collect()}
    want = {(i, e): t.lower().count(n.lower()) for i, t in texts if t for e, n in names if n and n.lower() in t.lower()}
    assert got == want
    none = spark.createDataFrame([], "entity int, name string")
    assert M.mentions(spark.createDataFrame(texts, "id int, t string"), none).count() == 0


def plain_section(text, name):
    out, found = [], False
    for line in text.split("\n"):
        if name in line.lower():
            found = True
        elif not found:
            continue
        elif len(out) >= 20:
            break
        out.append(line)
    return "\n".join(out) if found else None


def test_sections(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [("\n".join(r.choice(["x", "y Kwale", "", "KWALE"]) if r.random() < p else "z" for _ in range(n)),) for n in (1, 5, 19, 20, 21, 60) for p in (0.05, 0.5, 0.97) for _ in range(4)]
    got = spark.createDataFrame(rows, "t string").select("t", M.section(F.col("t"), F.lit("kwale")).alias("s")).collect()
    assert all(x["s"] == plain_section(x["t"], "kwale") for x in got) and any(x["s"] is None for x in got)


LONG = "the money of this office could not be traced to any voucher, ledger or schedule that was put before us in the year"


def test_findings_carry_the_header(spark):
    text = "\n\n".join([
        f"Fraud: {LONG}. Ksh. 3.5 billion was lost.", f"County Government of  Taita Taveta\n{LONG}: irregular, KSh 1,200 or so, in million", "fraud, but short", f"{LONG} without any of the words",
        f"County Assembly of Kwale\nshort", f"{LONG}; a delay of Kshs 5", f"variance and theft: {LONG} KSH 7 " + "x" * 600,
    ])
    got = [tuple(x) for x in M.findings_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "report int, text string")).drop("report", "finding").orderBy("seq").collect()]
    assert got == [
        (1, "OAG-0001", "National Government", "national-government", "CRITICAL", 3.5e9), (2, "OAG-0002", "Taita Taveta County", "taita-taveta-county", "HIGH", 1.2e9),
        (3, "OAG-0003", "Kwale County", "kwale-county", "LOW", None), (4, "OAG-0004", "Kwale County", "kwale-county", "CRITICAL", 7.0),
    ]
    longest = M.findings_of(spark.createDataFrame([(1, text)], "report int, text string")).where("seq = 4").first()["finding"]
    assert len(longest) == 500
