"""The encoded size of a series, from its layout alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import varint_length, zigzag

#: Fixed values of the binary layout: file header, segment entry, residual header, block header.
HEADER, ENTRY, RESIDUALS, BLOCK = 28, 64, 16, 12


def context_json(dt: Column, t0: Column, unit: Column) -> Column:
    """The compact JSON header of a series."""
    return F.to_json(F.struct(F.struct(dt.cast("double").alias("dt"), t0.alias("t0")).alias("sampling"), unit.alias("unit")))


def encoded_size(coded: DataFrame, meta: DataFrame, coding: str = "varint") -> DataFrame:
    """(series_id, n_points, n_segments, encoded_bytes, ratio) without packing a byte."""
    each = varint_length(zigzag(F.col("q"))) if coding == "varint" else F.lit(4)
    sums = coded.groupBy("series_id").agg(F.count("*").alias("n_points"), F.max("seg_id").alias("last"), F.sum(each).alias("residual_bytes"))
    text = meta.select("series_id", F.octet_length(context_json(F.col("dt"), F.col("t0"), F.col("unit"))).alias("context_bytes"))
    n = F.col("last") + 1
    rows = sums.join(text, "series_id").select("series_id", "n_points", n.alias("n_segments"), (HEADER + F.col("context_bytes") + ENTRY * n + RESIDUALS + BLOCK * n + F.col("residual_bytes")).alias("encoded_bytes"))
    return rows.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_points") * 8.0, F.col("encoded_bytes")), F.lit(0.0)))
