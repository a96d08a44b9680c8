"""Fitting, predicting, quantising and reconstructing, all over one sort by (series, segment, idx).

Everything a segment needs is a window aggregate over its own points, so that
after the points are partitioned by series nothing is shuffled or joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..params import PREDICTORS, CodecParams


def of_segment() -> WindowSpec:
    return W.partitionBy("series_id", "seg_id")


def in_order() -> WindowSpec:
    return of_segment().orderBy("idx")


def fitted(seg_points: DataFrame) -> DataFrame:
    """Adds n, mean, slope, intercept, variance and seed of each point's segment.

    The slope is a sum of values shifted by the first, weighted by centred
    places: exact where values are whole, so that a level segment has slope 0
    and ties with its mean, which a running covariance misses by its rounding.
    """
    whole = in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = seg_points.select("*", F.count("*").over(whole).alias("n"), F.avg("value").over(whole).alias("mean"), F.avg("t").over(whole).alias("centre"), F.var_pop("value").over(whole).alias("variance"), F.first("value").over(whole).alias("seed"))
    off = F.col("t") - F.col("centre")
    df = df.select("*", F.sum(off * (F.col("value") - F.col("seed"))).over(whole).alias("rise"), F.sum(off * off).over(whole).alias("run"))
    df = df.withColumn("slope", F.when(F.col("run") > 0, F.col("rise") / F.col("run")).otherwise(0.0))
    return df.select(*seg_points.columns, "n", "mean", "slope", (F.col("mean") - F.col("slope") * F.col("centre")).alias("intercept"), "variance", "seed")


def predicted(kind: int) -> Column:
    """What predictor 0, 1 or 2 expects at a point; the walk starts at the seed and follows original values."""
    if kind == 0:
        return F.col("mean")
    if kind == 1:
        return F.col("intercept") + F.col("slope") * F.col("t")
    return F.coalesce(F.lag("value").over(in_order()), F.col("seed"))


def rebuilt(kind: Column | int, q: Column, q_step: Column) -> Column:
    """The value decoded from quantised residuals; the walk adds up what it has decoded."""
    walk = F.col("seed") + F.sum(q * q_step).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    if isinstance(kind, int):
        return walk if kind == 2 else predicted(kind) + q * q_step
    return F.when(kind == 0, predicted(0) + q * q_step).when(kind == 1, predicted(1) + q * q_step).otherwise(walk)


def _quantised(df: DataFrame, kind: int, p: CodecParams, tag: str = "") -> DataFrame:
    df = df.withColumn(f"pred{tag}", predicted(kind)).withColumn(f"residual{tag}", F.col("value") - F.col(f"pred{tag}"))
    df = df.withColumn(f"q_step{tag}", F.greatest(F.lit(p.c_q) * F.stddev_pop(f"residual{tag}").over(of_segment()), F.lit(p.q_min)))
    return df.withColumn(f"q{tag}", F.rint(F.col(f"residual{tag}") / F.col(f"q_step{tag}")).cast("bigint"))


def coded(seg_points: DataFrame, p: CodecParams) -> DataFrame:
    """Points with predictor_type, pred, residual, q_step and q; ``auto`` takes the least error, then the lowest type."""
    df = fitted(seg_points)
    if p.predictor != "auto":
        kind = PREDICTORS[p.predictor]
        return _quantised(df.withColumn("predictor_type", F.lit(kind)), kind, p)
    for k in range(3):
        df = _quantised(df, k, p, str(k))
        df = df.withColumn(f"back{k}", rebuilt(k, F.col(f"q{k}"), F.col(f"q_step{k}")))
        df = df.withColumn(f"mse{k}", F.avg(F.pow(F.col("value") - F.col(f"back{k}"), 2)).over(of_segment()))
    err = [F.when(F.isnan(f"mse{k}"), float("inf")).otherwise(F.col(f"mse{k}")) for k in range(3)]
    best = F.when((err[1] < err[0]) & (err[1] <= err[2]), 1).when((err[2] < err[0]) & (err[2] < err[1]), 2).otherwise(0)
    df = df.withColumn("predictor_type", best)
    pick = lambda c: F.element_at(F.array(*(F.col(f"{c}{k}") for k in range(3))), F.col("predictor_type") + 1).alias(c)
    return df.select(*seg_points.columns, "n", "mean", "slope", "intercept", "variance", "seed", "predictor_type", *map(pick, ("pred", "residual", "q_step", "q")), *(f"mse{k}" for k in range(3)))


def segments(points: DataFrame) -> DataFrame:
    """One row per segment of coded points, without a further shuffle."""
    keys = ["series_id", "seg_id", "start_idx", "n", "predictor_type", "mean", "slope", "intercept", "q_step", "seed"]
    rows = points.groupBy("series_id", "seg_id").agg(*(F.first(c).alias(c) for c in keys[2:]))
    return rows.select("series_id", "seg_id", "start_idx", (F.col("start_idx") + F.col("n") - 1).alias("end_idx"), F.col("n").alias("len"), "predictor_type", "mean", "slope", "intercept", "q_step", F.col("seed").alias("seed_value"))


def reconstructed(points: DataFrame) -> DataFrame:
    """Coded points with the decoded value."""
    return points.withColumn("decoded", rebuilt(F.col("predictor_type"), F.col("q"), F.col("q_step")))


def errors(points: DataFrame) -> DataFrame:
    """RMSE and greatest absolute error of each series."""
    d = F.col("value") - F.col("decoded")
    return points.groupBy("series_id").agg(F.count("*").alias("n_points"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs_error"))
