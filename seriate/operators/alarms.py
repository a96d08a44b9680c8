"""Alarm logs (ts, type, severity) as weighted intensity series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import float_floordiv


#: Bins that one row of the growing grid stands for.
GRID = 1 << 16


def type_name(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "_").otherwise(c)


def type_weights(alarms: DataFrame) -> DataFrame:
    """(type, n, weight): the rarest type weighs 1.0, each more frequent one (then by name) 0.5 more.

    The window runs over one row per type.
    """
    counts = alarms.groupBy(type_name(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    return counts.select("type", "n", (1.0 + 0.5 * (F.row_number().over(W.orderBy("n", "type")) - 1)).alias("weight"))


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def extent(alarms: DataFrame, dt: float) -> DataFrame:
    """(t0, first, n_bins): one row; no alarms give none."""
    ends = alarms.agg(F.min("ts").alias("t0"), F.min(micros(F.col("ts"))).alias("first"), F.max(micros(F.col("ts"))).alias("last")).where(F.col("t0").isNotNull())
    span = (F.col("last") - F.col("first")) / 1e6
    return ends.select("t0", "first", (float_floordiv(span, F.lit(float(dt))) + 1).cast("bigint").alias("n_bins"))


def intensity(alarms: DataFrame, dt: float = 60.0) -> DataFrame:
    """(bin, value): the weighted severities of each ``dt`` seconds from the first alarm on, 0 where there are none.

    Severities are summed per bin and type before the weights are joined, so
    the log itself is never shuffled by row.
    """
    if dt <= 0:
        raise ValueError("dt must be positive")
    ends = extent(alarms, dt)  # one row
    at = float_floordiv((micros(F.col("ts")) - F.col("first")) / 1e6, F.lit(float(dt))).cast("bigint")
    sums = alarms.crossJoin(F.broadcast(ends.select("first"))).groupBy(at.alias("bin"), type_name(F.col("type")).alias("type")).agg(F.sum("severity").alias("severity"))
    weighted = sums.join(type_weights(alarms).select("type", "weight"), "type", "left").groupBy("bin").agg(F.sum(F.coalesce("weight", F.lit(1.0)) * F.col("severity")).alias("value"))
    # The grid grows in two steps, so that neither an array nor a task holds a long log's bins.
    runs = ends.select("n_bins", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1, F.lit(GRID).cast("bigint"))).alias("run")).repartition("run")
    grid = runs.select(F.explode(F.sequence(F.col("run"), F.least(F.col("run") + GRID, F.col("n_bins")) - 1)).alias("bin"))
    return grid.join(weighted, "bin", "left").select("bin", F.coalesce("value", F.lit(0.0)).alias("value"))
