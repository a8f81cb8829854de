"""Rates of counters and quantiles of histograms over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def increases(samples: DataFrame, *series: str) -> DataFrame:
    """(series, prev, ts, by): how much a counter grew since the sample before; after a reset, all that it shows."""
    w = Window.partitionBy(*series).orderBy("ts", "value")
    s = samples.select(*series, "ts", "value", F.lag("ts").over(w).alias("prev"), F.lag("value").over(w).alias("before")).where("prev is not null")
    return s.select(*series, "prev", "ts", F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before")).alias("by"))


def rates(samples: DataFrame, series: tuple[str, ...], by: tuple[str, ...], length: str, slide: str, seconds: int) -> DataFrame:
    """(start, by, rate): growth a second of all series together, from pairs of samples that both lie in the window."""
    grown = increases(samples, *series).select(*by, "prev", "by", F.window("ts", length, slide).alias("w")).where(F.col("prev") >= F.col("w.start"))
    return grown.groupBy("w", *by).agg((F.sum("by") / seconds).alias("rate")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *by, F.round("rate", 6).alias("rate"))


def bucket_counts(value: Column) -> list[Column]:
    """Cumulative counts by upper bound, the last without one."""
    return [F.count_if(value <= b).alias(f"le{i}") for i, b in enumerate(BOUNDS)] + [F.count(value).alias(f"le{len(BOUNDS)}")]


def quantile(q: float) -> Column:
    """The ``q`` quantile by linear interpolation in the first cumulative bucket that reaches it; the first starts at 0, and
    beyond the last bound the last bound is the answer."""
    n = len(BOUNDS)
    rank = q * F.col(f"le{n}")
    out = F.when(F.col(f"le{n}") == 0, F.lit(None).cast("double"))
    for i, high in enumerate(BOUNDS):
        below, low = (F.col(f"le{i - 1}"), BOUNDS[i - 1]) if i else (F.lit(0), 0.0)
        out = out.when(F.col(f"le{i}") >= rank, F.lit(low) + (high - low) * (rank - below) / (F.col(f"le{i}") - below))
    return out.otherwise(F.lit(BOUNDS[-1]))
