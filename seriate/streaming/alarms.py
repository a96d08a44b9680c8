"""Alarm intensities of an unbounded log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intensity(log: DataFrame, weights: DataFrame, dt: str = "60 seconds", late: str = "10 minutes", anchor: str = "0 seconds") -> DataFrame:
    """(bin, value): weighted severities per window of ``dt``, final once ``late`` has passed.

    A stream has no first alarm to anchor its bins to, so ``anchor`` (an offset
    from the epoch) is declared; ``weights`` (type, weight) has one row per
    type and is static.
    """
    known = F.broadcast(weights.select(F.col("type").alias("kind"), "weight"))  # one row per type
    kind = F.when(F.coalesce("type", F.lit("")) == "", "_").otherwise(F.col("type"))
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("kind", kind).join(known, "kind", "left")
    bins = rows.groupBy(F.window("ts", dt, startTime=anchor)).agg(F.sum(F.coalesce("weight", F.lit(1.0)) * F.col("severity")).alias("value"))
    return bins.select(F.col("window.start").alias("bin"), "value")
