"""Metadata of any shape: metrics by a year that is itself a key, merged objects, and hashes that ignore the order of keys.

Objects are variants, so no field has to be known beforehand.  What isn't JSON counts as no object; so does JSON that names a
key twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from ..sources.roles import fy_label

OBJECT = "map<string,variant>"
FALLBACK = "FY1995/96"


def fields(v: Column, path: str = "$") -> Column:
    """An object as a map; null if there is none."""
    return F.try_variant_get(v, path, OBJECT)


def metrics_of(meta: Column, year: Column, fallback: Column) -> Column:
    """The metrics of ``year``; of ``fallback`` where it has none or an empty object."""
    every = fields(meta, "$.metrics")
    found = lambda key: F.filter(F.array(fields(F.try_element_at(every, key))), lambda m: F.size(m) > 0)
    return F.coalesce(F.get(found(year), F.lit(0)), F.get(found(fallback), F.lit(0)))


def metric(metrics: Column, name: str, default: Column) -> Column:
    """A metric as a number, ``default`` where it is missing."""
    return F.coalesce(F.try_variant_get(F.try_element_at(metrics, F.lit(name)), "$", "double"), default)


def merged(left: Column, right: Column) -> Column:
    """The fields of both objects; the right side's value counts where both have one, even if it is a JSON null."""
    none = F.create_map().cast(OBJECT)
    return F.map_zip_with(F.coalesce(fields(left), none), F.coalesce(fields(right), none), lambda _, a, b: F.coalesce(b, a))


def canonical(v: Column) -> Column:
    """JSON without spaces whose objects list their keys in order at every level; characters beyond ASCII are escaped.

    Variants keep their keys in order.  Numbers have one form each: 1.50 is 1.5, 1e3 is 1000.0.
    """
    text = F.to_json(v)
    code = lambda x: F.ascii(x)  # noqa: E731  the code point
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    pair = lambda n: F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000) % 1024))
    escaped = F.array_join(F.transform(F.split(text, "", -1), lambda x: F.when(code(x) < 127, x).when(code(x) < 0x10000, unit(code(x))).otherwise(pair(code(x)))), "")
    return F.when(text.rlike(r"[^\x00-\x7E]"), escaped).otherwise(text)


def content_hash(v: Column) -> Column:
    """SHA-256 of the canonical form; null where there is no JSON."""
    return F.sha2(canonical(v), 256)


def _meta(r: Roles) -> DataFrame:
    """(entity_id, meta): allocated and spent by fiscal year as JSON, cut short for some entities."""
    s = r.execution("entity_id", "fy").groupBy("entity_id", "fy").agg(F.floor(F.sum("allocated")).cast("bigint").alias("allocated"), F.floor(F.sum("spent")).cast("bigint").alias("spent"))
    year = F.concat(F.lit('"'), fy_label(F.col("fy")), F.when(F.col("fy") % 4 == 1, '":{}').otherwise(F.concat(F.lit('":{"spent":'), "spent", F.lit(',"allocated":'), "allocated", F.lit("}"))))
    text = F.concat(F.lit('{"source":"x","metrics":{'), F.array_join(F.sort_array(F.collect_list(year)), ","), F.lit("}}"))
    return s.groupBy("entity_id").agg(text.alias("t")).select("entity_id", F.when(F.col("entity_id") % 7 == 3, F.left("t", F.lit(30))).otherwise(F.col("t")).alias("meta"))


@query(f"""WITH s AS (SELECT entity_id, fy, CAST(floor(sum(allocated)) AS BIGINT) AS allocated, CAST(floor(sum(spent)) AS BIGINT) AS spent FROM budget_lines GROUP BY 1, 2), e AS (SELECT DISTINCT entity_id FROM s), y AS (SELECT DISTINCT fy FROM s UNION SELECT max(fy) + 1 FROM s), m AS (SELECT * FROM s WHERE entity_id % 7 <> 3 AND fy % 4 <> 1)
    SELECT entity_id, printf('FY%d/%02d', fy, (fy + 1) % 100) AS year, CAST(coalesce(a.allocated, b.allocated, 0) AS DOUBLE) AS allocated, CAST(coalesce(a.spent, b.spent, -1) AS DOUBLE) AS spent FROM e CROSS JOIN y LEFT JOIN m a USING (entity_id, fy) LEFT JOIN (SELECT entity_id, allocated, spent FROM m WHERE printf('FY%d/%02d', fy, (fy + 1) % 100) = '{FALLBACK}') b USING (entity_id)""")
def metric_by_year(r: Roles):
    """Metrics of every entity for every fiscal year and one more, with a fallback year; broken metadata has none."""
    fy = r.execution("fy").select("fy").distinct()
    years = fy.unionByName(fy.agg((F.max("fy") + 1).alias("fy")))  # some ten rows
    m = _meta(r).select("entity_id", F.try_parse_json("meta").alias("meta")).crossJoin(F.broadcast(years)).select("entity_id", fy_label(F.col("fy")).alias("year"), "meta")
    m = m.select("entity_id", "year", metrics_of(F.col("meta"), F.col("year"), F.lit(FALLBACK)).alias("m"))
    return m.select("entity_id", "year", metric(F.col("m"), "allocated", F.lit(0.0)).alias("allocated"), metric(F.col("m"), "spent", F.lit(-1.0)).alias("spent"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN props_ WHEN event_id % 5 = 0 THEN '{"by":{"id":' || user_id || ',"kind":"' || event_type || '"},"k":null}' ELSE '{"by":{"id":' || user_id || ',"kind":"' || event_type || '"},' || props_[2:] END AS merged FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN '{}' ELSE replace(props, ' ', '') END AS props_ FROM events) WHERE event_id % 13 <> 0 OR event_id % 5 = 0 OR event_id % 11 = 0
    UNION ALL SELECT event_id, '{"by":{"id":' || user_id || ',"kind":"' || event_type || '"}}' FROM events WHERE event_id % 13 = 0 AND event_id % 5 <> 0 AND event_id % 11 <> 0""")
def merged_metadata(r: Roles):
    """An event's properties with its later metadata over them; either may be broken."""
    e = F.col("event_id")
    late = F.concat(F.when(e % 5 == 0, '{"k": null, ').otherwise("{"), F.lit('"by": {"kind": "'), "event_type", F.lit('", "id": '), "user_id", F.lit("}}"))
    left = F.try_parse_json(F.when(e % 13 == 0, F.lit("[1]")).otherwise(F.col("props")))
    right = F.try_parse_json(F.when(e % 11 == 0, F.left(late, F.lit(9))).otherwise(late))
    return r.table("events").select("event_id", canonical(F.to_variant_object(merged(left, right))).alias("merged"))


@query("""SELECT event_id, sha256('{"k":[' || user_id || ',{"a":{},"b":"' || event_type || '"}],"\\u00e9":' || replace(props, ' ', '') || ',"\\ud83d\\ude42":"\\u20ac"}') AS digest FROM events""".replace("\\\\", "\\"))
def payload_hash(r: Roles):
    """A hash of each event's payload, written with its keys in another order and some space."""
    payload = F.concat(F.lit('{ "🙂" : "€", "é":'), "props", F.lit(', "k": ['), "user_id", F.lit(', {"b":"'), "event_type", F.lit('", "a" : {}}]}'))
    return r.table("events").select("event_id", content_hash(F.try_parse_json(payload)).alias("digest"))
