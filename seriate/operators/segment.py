"""Cutting series into segments: (series_id, idx, value) gains seg_id, start_idx and t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MOST_POINTS, CodecParams


def checked(points: DataFrame) -> DataFrame:
    """``points`` that fail the query on values no codec can hold."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return points.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("non-finite value in series "), "series_id"))).otherwise(v))


def fixed(points: DataFrame, length: int) -> DataFrame:
    """Segments of ``length`` points, the last one shorter; a narrow projection."""
    if length <= 0:
        raise ValueError("segment_length must be positive")
    seg = F.expr(f"idx div {int(length)}")
    return points.select("series_id", "idx", "value", seg.alias("seg_id"), (seg * length).alias("start_idx"), (F.col("idx") - seg * length).alias("t"))


def _then(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


#: Starts that the fold gathers before it puts them aside, so that it never copies all that it has found.
GATHERED = 256


def starts(sorted_points: Column, model: str, least: int, most: int, threshold: float) -> Column:
    """Start positions of adaptive segments, by one ordered fold with constant state.

    A segment's first ``least`` points are taken unconditionally; then points
    are added while the model's mean squared error over the segment stays at or
    under ``threshold`` and it is not full.  The error follows from running
    sums of values shifted by the segment's first.
    """
    names = ("n", "closed", "x0", "prev", "sy", "syy", "sty", "sdd", "new", "aside")

    def state(*cols: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in zip(names, cols, strict=True)))

    zero, none = F.lit(0.0), F.array().cast("array<bigint>")
    nothing = F.array().cast("array<array<bigint>>")
    first_closed = F.lit(least == 1 and (threshold < 0 or most == 1))

    def fold(s: Column, p: Column) -> Column:
        n, y, d = s["n"] + 1, p["value"] - s["x0"], p["value"] - s["prev"]
        grown = F.struct(n.alias("n"), (s["sy"] + y).alias("sy"), (s["syy"] + y * y).alias("syy"), (s["sty"] + s["n"] * y).alias("sty"), (s["sdd"] + d * d).alias("sdd"))

        def decide(g: Column) -> Column:
            m = g["n"].cast("double")
            spread = g["syy"] - g["sy"] * g["sy"] / m
            if model == "mean":
                sse = spread
            elif model == "linear":
                lean = g["sty"] - (m - 1) / 2 * g["sy"]
                sse = F.when(m > 1, spread - lean * lean / (m * (m * m - 1) / 12)).otherwise(zero)
            else:
                sse = g["sdd"]
            over = (g["n"] >= least) & (F.greatest(sse, zero) / m > threshold)
            take = (s["n"] > 0) & ~s["closed"] & ((g["n"] <= least) | ~over)
            full, own = F.size(s["new"]) >= GATHERED, F.array(p["idx"])
            found = F.when(full, own).otherwise(F.concat(s["new"], own)), F.when(full, F.concat(s["aside"], F.array(s["new"]))).otherwise(s["aside"])
            new = state(F.lit(1).cast("bigint"), first_closed, p["value"], p["value"], zero, zero, zero, zero, *found)
            return F.when(take, state(g["n"], over | (g["n"] >= most) & (g["n"] >= least), s["x0"], p["value"], g["sy"], g["syy"], g["sty"], g["sdd"], s["new"], s["aside"])).otherwise(new)

        return _then(grown, decide)

    start = state(F.lit(0).cast("bigint"), F.lit(False), zero, zero, zero, zero, zero, zero, none, nothing)
    return F.aggregate(sorted_points, start, fold, lambda s: F.flatten(F.concat(s["aside"], F.array(s["new"]))))


def packed(points: DataFrame) -> DataFrame:
    """(series_id, pts): each series' points in order, of which the format allows 10 million."""
    out = points.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("pts"))
    too_long = F.raise_error(F.concat(F.lit("Suspicious n_points in series "), "series_id"))
    return out.withColumn("pts", F.when(F.size("pts") > MOST_POINTS, too_long).otherwise(F.col("pts")))


def adaptive(points: DataFrame, model: str, least: int, most: int, threshold: float) -> DataFrame:
    """Segments that end where the model's error would pass the threshold; one shuffle by series."""
    if least <= 0 or most < least:
        raise ValueError("0 < min_segment_length <= max_segment_length is required")
    cuts = packed(points).withColumn("starts", starts(F.col("pts"), "linear" if model == "auto" else model, least, most, threshold))
    # Each point gets its segment from arrays beside the points, so no row carries a whole series but the first.
    own = F.transform("starts", lambda start, at: F.array_repeat(F.struct(at.cast("bigint").alias("seg_id"), start.alias("start_idx")), (F.coalesce(F.get("starts", at + 1), F.size("pts").cast("bigint")) - start).cast("int")))
    rows = cuts.select("series_id", F.explode(F.arrays_zip(F.col("pts").alias("p"), F.flatten(own).alias("s"))).alias("z"))
    return rows.select("series_id", "z.p.idx", "z.p.value", "z.s.seg_id", "z.s.start_idx", (F.col("z.p.idx") - F.col("z.s.start_idx")).alias("t"))


def segmented(points: DataFrame, p: CodecParams) -> DataFrame:
    if p.segment_mode == "fixed":
        return fixed(points, p.segment_length)
    return adaptive(points, p.predictor, p.min_segment_length, p.max_segment_length, p.mse_threshold)
