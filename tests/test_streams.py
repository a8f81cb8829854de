"""Streams that are taken up again, see late rows, changes and subscriptions, and jobs that never overlap."""

from __future__ import annotations

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlake.sources.storage import new_path
from ledgerlake.streaming import jobs, metrics
from ledgerlake.streaming.schedule import GRACE, Runs

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY0 = datetime.datetime(2024, 1, 1)


def event(i, day, user=1, kind="a", value=1.0):
    return (i, DAY0 + datetime.timedelta(days=day), user, kind, value)


class Feed:
    """A folder to which files are added between the calls of a job."""

    def __init__(self, spark, form=EVENTS):
        self.spark, self.form = spark, form
        self.path, self.root = new_path(spark, "feed"), new_path(spark, "job")
        self.n = 0

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.form).coalesce(1).write.parquet(f"{self.path}/f{self.n:03d}")

    def stream(self):
        return jobs.follow(self.spark, f"{self.path}/*", self.spark.createDataFrame([], self.form).schema, 1)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_windows_drop_late_rows_and_go_on(spark):
    f = Feed(spark)
    run = lambda: rows(jobs.merged(jobs.windowed(f.stream(), F.window("ts", "1 day"), "event_type"), ["start", "event_type"], "n", f.root, "update"), "start", "n", "total")
    f.add(event(1, 0.1), event(2, 0.2))
    f.add(event(3, 10.1))
    assert run() == [("2024-01-01 00:00:00", 2, 2.0), ("2024-01-11 00:00:00", 1, 1.0)]
    f.add(event(4, 0.3), event(5, 9.5), event(6, 10.2, value=4.0))  # the first is later than two days
    assert run() == [("2024-01-01 00:00:00", 2, 2.0), ("2024-01-10 00:00:00", 1, 1.0), ("2024-01-11 00:00:00", 2, 5.0)]
    assert run() == run()  # nothing new


def test_last_rows_survive_restarts_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 3)
    f = Feed(spark)
    want = {}
    for n in range(6):
        batch = [event(10 * n + k, n, user=(n + k) % 4, value=float(n)) for k in range(3)]
        f.add(*batch)
        if n % 2:
            f.add(event(0, 0, user=n % 4, value=-1.0))  # an old row of a key doesn't replace a newer one
        for e in batch:
            want[e[2]] = max(want.get(e[2], (0, 0.0)), (e[0], e[4]))
        if n % 2:
            want.setdefault(n % 4, (0, -1.0))
        got = jobs.merged(f.stream().select("user_id", "event_id", "value"), ["user_id"], "event_id", f.root)
        assert rows(got, "user_id", "event_id", "value") == sorted((u, *v) for u, v in want.items())
    assert len(jobs._paths(spark, f.root)) <= 4 and jobs._found(spark, f.root, "v")


def test_appended_rows_are_read_once(spark):
    f = Feed(spark)
    f.add(event(1, 0), event(2, 0, user=2))
    once = lambda: rows(jobs.appended(f.stream().select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), f.root), "user_id", "event_type")
    assert once() == [(1, "a"), (2, "a")]
    f.add(event(3, 400), event(4, 400, kind="b"))  # a key comes again after more than a year
    assert once() == [(1, "a"), (1, "b"), (2, "a")]


def test_a_change_is_a_version_at_any_age(spark):
    f = Feed(spark, "url string, seq int, digest string")
    run = lambda: rows(jobs.appended(jobs.changes(f.stream(), "url", "seq", "digest"), f.root), "url", "version", "seq", "digest")
    f.add(("x", 1, "p"), ("x", 3, "p"), ("x", 2, "q"), ("y", 1, "p"))
    first = [("x", 1, 1, "p"), ("x", 2, 2, "q"), ("x", 3, 3, "p"), ("y", 1, 1, "p")]
    assert run() == first
    f.add(("x", 900, "p"), ("y", 0, "z"), ("y", 1, "p"))  # unchanged, from before, repeated
    assert run() == first
    f.add(("y", 2, "r"), ("x", 901, "s"))
    assert run() == sorted([*first, ("x", 4, 901, "s"), ("y", 2, 2, "r")])


def test_subscriptions_meet_their_past(spark):
    f = Feed(spark)

    def run():
        subs = f.stream().where("event_type = 'sub'").select(F.col("event_id").alias("sub_id"), F.col("user_id").alias("item"), "ts")
        events = f.stream().where("event_type = 'a'").select("event_id", F.col("user_id").alias("item"), "ts")
        return rows(jobs.appended(jobs.subscribed(subs, events), f.root), "sub_id", "event_id", "lag_s")

    f.add(event(1, 1), event(2, 5), event(3, 5, user=2))
    assert run() == []
    f.add(event(10, 6, kind="sub"), event(11, 6.5, kind="sub"), event(4, 7))
    assert run() == [(10, 2, 86400), (11, 2, 129600)]
    f.add(event(12, 7.5, user=2, kind="sub"), event(5, 5.5))  # an event that comes after its subscription
    assert run() == [(10, 2, 86400), (10, 5, 43200), (11, 2, 129600), (11, 5, 86400), (12, 3, 216000)]


def test_rates_survive_resets(spark):
    at = lambda s: DAY0 + datetime.timedelta(seconds=s)
    samples = spark.createDataFrame([("x", at(0), 5), ("x", at(60), 11), ("x", at(120), 2), ("x", at(170), 4), ("y", at(100), 1), ("y", at(400), 31)], "s string, ts timestamp, value int")
    assert rows(metrics.increases(samples, "s"), "s", "by") == [("x", 2), ("x", 2), ("x", 6), ("y", 30)]
    got = dict(rows(metrics.rates(samples, ("s",), (), "5 minutes", "1 minute", 300), "start", "rate"))
    assert got["2024-01-01 00:00:00"] == round(10 / 300, 6) and got["2024-01-01 00:02:00"] == round(2 / 300, 6) and "2024-01-01 00:03:00" not in got


@pytest.mark.parametrize(("values", "q", "want"), [([0.5] * 10, 0.5, 0.5), ([1.0, 2.0, 3.0, 4.0], 0.5, 2.5), ([500.0, 600.0], 0.95, 100.0), ([20.0] * 4, 0.95, 24.25), ([None], 0.5, None)])
def test_quantiles_from_buckets(spark, values, q, want):
    df = spark.createDataFrame([(v,) for v in values], "v double").agg(*metrics.bucket_counts(F.col("v")))
    got = df.select(metrics.quantile(q).alias("q")).first()["q"]
    assert got == want if want is None else abs(got - want) < 1e-9


def test_jobs_run_once_when_due(spark):
    f, seen = Feed(spark), []
    runs = Runs(spark, new_path(spark, "runs"), {"debt": 24, "audits": 168, "none": 1})

    def debt():
        seen.append(len(rows(jobs.appended(f.stream().select("event_id"), f.root), "event_id")))

    def broken():
        raise ValueError("no answer")

    f.add(event(1, 0))
    assert runs.run_due({"debt": debt, "audits": broken}, 1_000_000) == {"audits": False, "debt": True}
    f.add(event(2, 0))
    assert runs.run_due({"debt": debt, "audits": broken}, 1_000_000 + 24 * 3600) == {"audits": False}  # not longer than its interval
    assert runs.run_due({"debt": debt}, 1_000_000 + 90 * 24 * 3600) == {"debt": True}  # many were missed, one run
    assert seen == [1, 2]


def test_overlapping_calls_run_a_job_once(spark):
    root, count = new_path(spark, "runs"), []
    now = int(datetime.datetime.now().timestamp())
    inside, leave = threading.Event(), threading.Event()

    def slow():
        count.append(1)
        inside.set()
        leave.wait(60)

    first = Runs(spark, root, {"x": 1})
    t = threading.Thread(target=first.run_due, args=({"x": slow}, now))
    t.start()
    assert inside.wait(60)
    assert Runs(spark, root, {"x": 1}).run_due({"x": slow}, now) == {}  # held
    leave.set()
    t.join()
    assert Runs(spark, root, {"x": 1}).run_due({"x": slow}, now) == {} and len(count) == 1
    other = Runs(spark, root, {"y": 1})
    assert other._hold("y", now) and not other._hold("y", now) and other._hold("y", now + GRACE + 10)  # a dead caller's file
