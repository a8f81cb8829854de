"""Which sources are due, and runs of their jobs that never overlap.

The table of runs is the only memory: a source is due if it has no run that went well, or if the last one is longer ago than its
interval.  However many intervals were missed, it is run once.  A job that runs holds a file that only one caller can
create; one that a dead caller left behind is taken over after ``GRACE`` seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hours between refreshes of a source.
REFRESH_HOURS = {"debt": 24, "population": 720, "economic": 168, "counties": 168, "budgets": 168, "audits": 168}
GRACE = 3600
RUNS = "domain string, at long, ok boolean"


def due(runs: DataFrame, schedule: DataFrame, now: Column) -> DataFrame:
    """(domain, last, due) of every source; runs: (domain, at, ok), schedule: (domain, hours), times in seconds."""
    last = runs.where(F.col("ok") & (F.col("at") <= now)).groupBy("domain").agg(F.max("at").alias("last"))
    return schedule.join(last, "domain", "left").select("domain", "last", (F.col("last").isNull() | (now - F.col("last") > F.col("hours") * 3600)).alias("due"))


class Runs:
    """The runs of jobs under a root folder."""

    def __init__(self, spark: SparkSession, root: str, hours: dict[str, int] | None = None) -> None:
        self.spark, self.root = spark, root
        self.schedule = spark.createDataFrame(list((hours or REFRESH_HOURS).items()), "domain string, hours int")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def table(self) -> DataFrame:
        if not self._fs.exists(self._path(f"{self.root}/runs")):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).json(f"{self.root}/runs")

    def due(self, now: int) -> list[str]:
        """The sources that are due, by name: as many as there are jobs."""
        return [r["domain"] for r in due(self.table(), self.schedule, F.lit(now)).where("due").orderBy("domain").collect()]

    def _hold(self, domain: str, now: int) -> bool:
        lock = self._path(f"{self.root}/running/{domain}")
        if self._fs.exists(lock) and now * 1000 - self._fs.getFileStatus(lock).getModificationTime() > GRACE * 1000:
            self._fs.delete(lock, False)
        return bool(self._fs.createNewFile(lock))

    def run_due(self, jobs: dict[str, Callable[[], object]], now: int) -> dict[str, bool]:
        """Run the job of every source that is due and that nobody runs; whether each went well."""
        done = {}
        for domain in self.due(now):
            if domain not in jobs or not self._hold(domain, now):
                continue
            try:
                if domain not in self.due(now):  # another caller was faster
                    continue
                try:
                    jobs[domain]()
                    done[domain] = True
                except Exception:  # noqa: BLE001  a failed job is due again; the others still run
                    done[domain] = False
                self.spark.createDataFrame([(domain, now, done[domain])], RUNS).coalesce(1).write.mode("append").json(f"{self.root}/runs")
            finally:
                self._fs.delete(self._path(f"{self.root}/running/{domain}"), False)
        return done
