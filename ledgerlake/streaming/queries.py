"""Registered streaming queries; each has the batch SQL with the same result as its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Roles, query
from . import metrics
from .jobs import appended, changes, complete, merged, read_stream, subscribed, windowed
from .schedule import REFRESH_HOURS, due

TOTAL = "round(CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE), 2)"


def _events(r: Roles):
    return read_stream(r.spark, r.sf_dir, "events")


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {TOTAL} AS total FROM events GROUP BY 1, 2")
def events_tumbling(r: Roles):
    return merged(windowed(_events(r), F.window("ts", "1 day"), "event_type"), ["start", "event_type"], "n", mode="update")


@query(f"SELECT strftime(date_trunc('day', ts) - k * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {TOTAL} AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def events_sliding(r: Roles):
    """Two-day windows that start every day."""
    return merged(windowed(_events(r), F.window("ts", "2 days", "1 day"), "event_type"), ["start", "event_type"], "n", mode="update")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, {TOTAL} AS total FROM s GROUP BY user_id, k""")
def events_session(r: Roles):
    """Sessions of a user with gaps under six hours."""
    return complete(windowed(_events(r), F.session_window("ts", "6 hours"), "user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(r: Roles):
    """Each natural key once, however often and however late it arrives: the state holds every key."""
    return appended(_events(r).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert(r: Roles):
    return merged(_events(r).select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query("SELECT event_id, c_custkey FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error' AND value > 50 AND c_acctbal >= 0")
def stream_alerts(r: Roles):
    """A stream joined with the static table of watchers."""
    watchers = r.table("customer").where("c_acctbal >= 0").select("c_custkey")
    e = _events(r).where("event_type = 'error' and value > 50").select("event_id", F.col("user_id").alias("c_custkey"))
    return appended(e.join(watchers, "c_custkey").select("event_id", "c_custkey"))


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def stream_changes(r: Roles):
    """A version of a user's record whenever its content is another than before."""
    return appended(changes(_events(r), "user_id", "event_id", "event_type"))


@query("SELECT s.event_id AS sub_id, e.event_id AS event_id, CAST(epoch(date_trunc('second', s.ts)) - epoch(date_trunc('second', e.ts)) AS BIGINT) AS lag_s FROM events s JOIN events e ON e.user_id = s.user_id AND e.ts <= s.ts AND e.ts >= s.ts - INTERVAL 3 DAY WHERE s.event_type = 'signup' AND e.event_type IN ('error', 'purchase')")
def stream_subscribed(r: Roles):
    """Errors and purchases of a user in the three days before a signup."""
    subs = _events(r).where("event_type = 'signup'").select(F.col("event_id").alias("sub_id"), F.col("user_id").alias("item"), "ts")
    return appended(subscribed(subs, _events(r).where("event_type in ('error', 'purchase')").select("event_id", F.col("user_id").alias("item"), "ts")))


@query("SELECT event_id, user_id, 'watch_started' AS alert_type, 'Now watching: ' || user_id AS title FROM events WHERE event_type = 'signup'")
def stream_welcome(r: Roles):
    """An alert for every subscription."""
    return appended(_events(r).where("event_type = 'signup'").select("event_id", "user_id", F.lit("watch_started").alias("alert_type"), F.concat(F.lit("Now watching: "), "user_id").alias("title")))


_LE = ", ".join([f"count(*) FILTER (WHERE value <= {b}) AS le{i}" for i, b in enumerate(metrics.BOUNDS)] + [f"count(value) AS le{len(metrics.BOUNDS)}"])
_LAST = len(metrics.BOUNDS)
_P95 = f"CASE WHEN le{_LAST} = 0 THEN NULL " + " ".join(
    f"WHEN le{i} >= 0.95::DOUBLE * le{_LAST} THEN {(0.0, *metrics.BOUNDS)[i]}::DOUBLE + {b - (0.0, *metrics.BOUNDS)[i]}::DOUBLE * (0.95::DOUBLE * le{_LAST} - {f'le{i - 1}' if i else 0}) / (le{i} - {f'le{i - 1}' if i else 0})" for i, b in enumerate(metrics.BOUNDS)
) + f" ELSE {metrics.BOUNDS[-1]}::DOUBLE END"


@query(f"WITH b AS (SELECT strftime(date_trunc('minute', ts) - k * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS start, event_type, {_LE} FROM events, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2) SELECT start, event_type, le{_LAST} AS n, round({_P95}, 4) AS p95 FROM b")
def latency_quantiles(r: Roles):
    """The 95th percentile of values in windows of five minutes that start every minute, from buckets."""
    g = _events(r).withWatermark("ts", "2 days").groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "event_type").agg(*metrics.bucket_counts(F.col("value")))
    counts = g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", *(f"le{i}" for i in range(_LAST + 1)))
    last = merged(counts, ["start", "event_type"], f"le{_LAST}", mode="update")
    return last.select("start", "event_type", F.col(f"le{_LAST}").alias("n"), F.round(metrics.quantile(0.95), 4).alias("p95"))


def _rates_sql(length: int, slide: int) -> str:
    return f"""WITH s AS (SELECT user_id, event_type, ts, event_id % 1000 AS v FROM events), d AS (SELECT *, lag(ts) OVER w AS prev, lag(v) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, v)), x AS (SELECT event_type, prev, CASE WHEN v < before THEN v ELSE v - before END AS grown, to_timestamp(floor(epoch(ts) / {slide}) * {slide} - k * {slide}) AT TIME ZONE 'UTC' AS start FROM d, (SELECT unnest(range(0, {length // slide})) AS k) WHERE prev IS NOT NULL)
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(CAST(sum(grown) AS DOUBLE) / {length}, 6) AS rate FROM x WHERE prev >= start GROUP BY 1, 2"""


def _rates(r: Roles, length: str, slide: str, seconds: int):
    samples = r.table("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 1000).alias("value"))
    return metrics.rates(samples, ("user_id", "event_type"), ("event_type",), length, slide, seconds)


@query(_rates_sql(300, 60))
def counter_rates(r: Roles):
    """Growth a second of each type's counters (one a user, starting again at 1000) in sliding windows of five minutes."""
    return _rates(r, "5 minutes", "1 minute", 300)


@query(_rates_sql(86400, 21600))
def counter_rates_daily(r: Roles):
    """The same in windows of a day that start every six hours."""
    return _rates(r, "1 day", "6 hours", 86400)


_HOURS = ", ".join(f"('{d}', {i}, {h})" for i, (d, h) in enumerate(REFRESH_HOURS.items()))


@query(f"""WITH s AS (SELECT * FROM (VALUES {_HOURS}) v(domain, i, hours)), n AS (SELECT CAST(floor(max(epoch(ts))) AS BIGINT) AS now FROM events), l AS (SELECT domain, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events JOIN s ON event_id % 601 = i WHERE value < 20 GROUP BY 1)
    SELECT domain, last, last IS NULL OR now - last > hours * 3600 AS due FROM s LEFT JOIN l USING (domain), n""")
def domains_due(r: Roles):
    """Sources due at the newest event, from a table of runs: an event for a source is a run of it, one of under 20 went well."""
    names = F.array(*map(F.lit, REFRESH_HOURS))
    e = r.table("events").select((F.col("event_id") % 601).cast("int").alias("i"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "value")
    runs = e.where(F.col("i") < len(REFRESH_HOURS)).select(F.get(names, F.col("i")).alias("domain"), "at", (F.col("value") < 20).alias("ok"))
    schedule = r.spark.createDataFrame(list(REFRESH_HOURS.items()), "domain string, hours int").crossJoin(e.agg(F.max("at").alias("now")))  # one row
    return due(runs, schedule, F.lit(2**62)).drop("due").join(schedule, "domain").select("domain", "last", (F.col("last").isNull() | (F.col("now") - F.col("last") > F.col("hours") * 3600)).alias("due"))
