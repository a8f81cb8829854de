"""Names matched to a table of known names: exactly in one of several forms, else by the share of matching blocks.

The ratio of two texts is 2 M / T: T their lengths together, M the characters in their matching blocks (the longest common
substring, then the same to its left and right).  It has to exceed 70 % rounded, so M >= 0.3525 T, and as k blocks have k - 1
gaps of at least one character, two texts of 18 characters or more together share a pair of neighbouring characters, and
shorter ones a character.  Those are the keys of the join; lengths and the characters in common, counted, bound M before the
blocks are looked for.  Both sides are tables of any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Roles, query

LEAST = 70
SHORT = 18


def matched(a: Column, b: Column) -> Column:
    """Characters of ``a`` and ``b`` in their matching blocks."""

    @F.pandas_udf("int")
    def blocks(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([sum(m.size for m in SequenceMatcher(None, s, t).get_matching_blocks()) for s, t in zip(x, y, strict=True)], dtype="int32")

    return blocks(a, b)


def pieces(c: Column) -> Column:
    """Pairs of neighbouring characters, and single ones of a text that may meet one of under ``SHORT`` with it."""
    cut = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(cut(2), F.when(F.length(c) < SHORT, cut(1)).otherwise(F.array().cast("array<string>"))))


def numbered(c: Column) -> Column:
    """Each character with how often it has occurred so far: two texts share as many of these as they can match characters."""
    upto = lambda i: F.substr(c, F.lit(1), i)
    one = lambda i: F.substr(c, i, F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(one(i), (i - F.length(F.replace(upto(i), one(i), F.lit("")))).cast("string")))


def close(m: Column, total: Column) -> Column:
    """Whether 2 ``m`` / ``total`` exceeds ``LEAST`` percent once it is rounded half to even."""
    return 200 * m > (LEAST + 0.5) * total


def forms(t: Column) -> Column:
    """A name as it is, without a trailing County, with spaces for hyphens, without apostrophes."""
    bare = lambda c: F.regexp_replace(c, r"\s+county$", "")
    flat, plain = F.replace(t, F.lit("-"), F.lit(" ")), F.regexp_replace(t, "[‘’'`´]", "")
    return F.array_distinct(F.array(t, bare(t), flat, bare(flat), plain, bare(plain)))


def match_names(raw: DataFrame, names: DataFrame) -> DataFrame:
    """name, kind, score and confidence of each text ``t`` that a name fits; names: (i, key, name, kind),
    where ``i`` is anything that sorts.

    The first name of the list in one of the text's forms has confidence 1; else the one of the largest ratio above
    ``LEAST``, by its own form or its key, of equals the first.  Null and blank texts fit nothing; repeated texts are matched once.
    """
    texts = raw.select("t").distinct().withColumn("a", F.lower(F.trim("t"))).where("a <> ''")
    exact = texts.select("t", F.explode(forms(F.col("a"))).alias("key")).join(names, "key").groupBy("t").agg(F.min(F.struct("i", "name", "kind")).alias("x"))
    exact = exact.select("t", "x.name", "x.kind", F.lit(100).alias("score"))
    known = names.select("i", "name", "kind", F.explode(F.array_distinct(F.array(F.lower("name"), "key"))).alias("b")).where("b <> ''")
    longest = known.agg(F.max(F.length("b")).alias("longest"))  # one row
    rest = texts.join(exact, "t", "left_anti").crossJoin(F.broadcast(longest)).where(close(F.least(F.length("a"), F.col("longest")), F.length("a") + F.least(F.length("a"), F.col("longest"))))
    total = F.length("a") + F.length("b")
    fits = close(F.least(F.length("a"), F.length("b")), total) & (F.when(total < SHORT, 1).otherwise(2) == F.length("piece"))
    left = rest.select("t", "a", numbered(F.col("a")).alias("x"), F.explode(pieces(F.col("a"))).alias("piece"))
    right = known.select("i", "name", "kind", "b", numbered(F.col("b")).alias("y"), F.explode(pieces(F.col("b"))).alias("piece"))
    near = left.join(right, "piece").where(fits & close(F.size(F.array_intersect("x", "y")), total)).select("t", "a", "i", "name", "kind", "b").distinct()
    scored = near.withColumn("m", matched(F.col("a"), F.col("b"))).where(close(F.col("m"), total)).withColumn("score", F.bround(200.0 * F.col("m") / total, 0).cast("int"))
    best = scored.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("less"), "i", "name", "kind")).alias("x")).select("t", "x.name", "x.kind", (-F.col("x.less")).alias("score"))
    return exact.unionByName(best).withColumn("confidence", F.col("score") / 100.0)


NAMES = ", ".join(f"({i}, '{key}', '{name.replace(chr(39), chr(39) * 2)}', '{kind}')" for i, (key, name, kind) in enumerate(T.GAZETTEER))
_BARE = r"regexp_replace({0}, '\s+county$', '')"
_FLAT, _PLAIN = "replace(a, '-', ' ')", "regexp_replace(a, '[‘’''`´]', '', 'g')"
_BLOCK = "list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(list_filter(range(1, len(a) - i + 2), lambda l: contains(b, substr(a, i, l))), lambda l: {'l': l, 'i': -i, 'j': -instr(b, substr(a, i, l))}))))"


def names_sql(raw: str, names: str) -> str:
    """The same by all pairs, with the blocks found by recursion."""
    return rf"""WITH RECURSIVE known AS ({names}), q AS (SELECT DISTINCT t, lower(trim(t)) AS a FROM {raw} WHERE trim(t) <> ''),
    x AS (SELECT t, arg_min({{'name': name, 'kind': kind}}, i) AS e FROM (SELECT t, unnest([a, {_BARE.format("a")}, {_FLAT}, {_BARE.format(_FLAT)}, {_PLAIN}, {_BARE.format(_PLAIN)}]) AS key FROM q) JOIN known USING (key) GROUP BY t),
    o AS (SELECT DISTINCT i, name, kind, unnest([lower(name), key]) AS b FROM known),
    p AS (SELECT row_number() OVER () AS id, t, i, name, kind, a, b, len(a) + len(b) AS total FROM q, o WHERE t NOT IN (SELECT t FROM x) AND 200 * least(len(a), len(b)) > {LEAST + 0.5} * (len(a) + len(b))
        AND 200 * list_sum(list_transform(list_distinct(string_split(b, '')), lambda c: least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, ''))))) > {LEAST + 0.5} * (len(a) + len(b))),
    m AS (SELECT id, a, b, {_BLOCK} AS z FROM p UNION ALL SELECT id, a, b, {_BLOCK} AS z FROM (SELECT id, unnest([{{'a': substr(a, 1, -z.i - 1), 'b': substr(b, 1, -z.j - 1)}}, {{'a': substr(a, z.l - z.i), 'b': substr(b, z.l - z.j)}}], recursive := true) FROM m WHERE z IS NOT NULL) WHERE a <> '' AND b <> ''),
    s AS (SELECT id, sum(z.l) AS n FROM m WHERE z IS NOT NULL GROUP BY id),
    f AS (SELECT t, name, kind, CAST(round_even(200.0 * n / total, 0) AS INTEGER) AS score, i FROM p JOIN s USING (id) WHERE 200 * n > {LEAST + 0.5} * total),
    r AS (SELECT t, e.name AS name, e.kind AS kind, 100 AS score FROM x UNION ALL SELECT t, name, kind, score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, i) AS k FROM f) WHERE k = 1)
    SELECT {raw}.*, name, kind, score, CAST(score AS DOUBLE) / 100.0::DOUBLE AS confidence FROM {raw} JOIN r USING (t)"""


@query(names_sql("remarks", f"SELECT * FROM (VALUES {NAMES}) v(i, key, name, kind)"))
def normalize_entity_ratio(r: Roles):
    """The known name that each remark gives, with its confidence."""
    names = r.spark.createDataFrame([(i, *x) for i, x in enumerate(T.GAZETTEER)], "i int, key string, name string, kind string")
    return r.remarks.join(match_names(r.remarks, names), "t").select("k", "t", "name", "kind", "score", "confidence")


KNOWN = "SELECT DISTINCT lower(p_name) AS i, lower(p_name) AS key, lower(p_name) AS name, p_type AS kind FROM part"
TITLES = "SELECT p_partkey AS k, lower(substr(p_name, 1, 1 + CAST(p_partkey % len(p_name) AS INTEGER))) || substr(p_name, 3 + CAST(p_partkey % len(p_name) AS INTEGER)) AS t FROM part"


@query(names_sql("titles", "SELECT i, key, name, min(kind) AS kind FROM (" + KNOWN + ") GROUP BY ALL").replace("WITH RECURSIVE ", f"WITH RECURSIVE titles AS ({TITLES}), ", 1))
def match_part_names(r: Roles):
    """Names of parts as read with a letter lost, matched to the table of all names."""
    part, at = r.table("part"), (F.col("p_partkey") % F.length("p_name")).cast("int")
    titles = part.select(F.col("p_partkey").alias("k"), F.concat(F.lower(F.substr("p_name", F.lit(1), at + 1)), F.substr("p_name", at + 3)).alias("t"))
    known = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_type").alias("kind"))
    names = known.select(F.col("name").alias("i"), F.col("name").alias("key"), "name", "kind")
    return titles.join(match_names(titles, names), "t").select("k", "t", "name", "kind", "score", "confidence")
