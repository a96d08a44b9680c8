"""Generators of demo series and alarm logs; a row's random numbers come from the md5 of seed and row number, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("trend", "sine_noise", "flat_spike", "ramp_then_burst", "multi_bump")


def uniform(seed: int, row: Column) -> Column:
    """A number from 0 to under 1: the first 52 bits of md5(seed:row)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _noise(size: float, seed: int, row: Column) -> Column:
    return (uniform(seed, row) * 2 - 1) * size if size > 0 else F.lit(0.0)


def _wave(amplitude: float, period: float, i: Column) -> Column:
    return amplitude * F.sin(2 * math.pi * i / period)


def _near(i: Column, centre: int, width: int) -> Column:
    return (i >= centre - width // 2) & (i < centre + width // 2)


def series(spark: SparkSession, kind: str, n: int = 300, seed: int = 42) -> DataFrame:
    """(series_id, idx, value) of one of :data:`KINDS`, with the shapes' default parameters."""
    i = F.col("idx")
    if kind == "trend":
        v = 0.05 * i
    elif kind == "sine_noise":
        v = _wave(1.0, 60.0, i) + 0.01 * i + _noise(0.1, seed, i)
    elif kind == "flat_spike":
        v = F.when(_near(i, n // 2, 30), 3.0).otherwise(1.5)
    elif kind == "ramp_then_burst":
        turn = n // 2
        v = 0.03 * i + F.when(i < turn, _noise(0.1, seed, i)).otherwise(_wave(6.0, 10.0, i - turn) + _noise(0.2, seed, i))
    elif kind == "multi_bump":
        bump = _near(i, 60, 15) | _near(i, 150, 15) | _near(i, 240, 15)
        v = F.when(bump, 3.0).otherwise(1.0) + _noise(0.1, seed, i)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return spark.range(n).select(F.lit(kind).alias("series_id"), F.col("id").alias("idx")).select("series_id", "idx", v.cast("double").alias("value"))


def alarms(spark: SparkSession, seed: int = 42) -> DataFrame:
    """An hour of (ts, type, severity): sparse A, then A and B, then bursts of five C every two minutes."""
    slots = [
        (0, 30, 40, 0.2, ["A"], [1]),
        (1200, 20, 60, 0.5, ["A", "B"], [1, 2, 3]),
    ]
    parts = []
    for k, (start, step, n, odds, kinds, weights) in enumerate(slots):
        one = spark.range(n).where(uniform(seed + k, F.col("id")) < odds)
        parts.append(one.select((F.lit(start) + F.col("id") * step).alias("s"), _choice(kinds, seed + 10 + k).alias("type"), _choice(weights, seed + 20 + k).cast("double").alias("severity")))
    burst = spark.range(50).select((F.lit(2400) + F.floor(F.col("id") / 5) * 120 + F.col("id") % 5 * 5).alias("s"), F.lit("C").alias("type"), _choice([2, 3], seed + 30).cast("double").alias("severity"))
    rows = parts[0].unionByName(parts[1]).unionByName(burst)
    return rows.select((F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s"))).alias("ts"), "type", "severity")


def _choice(values: list, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, F.col("id")) * len(values)) + 1).cast("int"))
