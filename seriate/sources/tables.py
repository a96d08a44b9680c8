"""Series and alarm logs drawn from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(df: DataFrame, key: str | Column, value: str | Column, order: list[str]) -> DataFrame:
    """(series_id, idx, value) of ``df``'s rows, one series per key, numbered in ``order``, ties by value; one shuffle by series."""
    rows = df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("series_id"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value"))
    at = W.partitionBy("series_id").orderBy(*(f"o{i}" for i in range(len(order))), "value")
    return rows.select("series_id", (F.row_number().over(at) - 1).cast("bigint").alias("idx"), "value")


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"])


def type_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", ["l_shipdate", "l_orderkey", "l_linenumber"])


def event_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("type"), F.col("value").alias("severity"))


def meta(points: DataFrame, dt: float = 1.0, t0: str = "1970-01-01T00:00:00Z", unit: str = "unknown") -> DataFrame:
    """(series_id, n_points, dt, t0, unit) of each series."""
    return points.groupBy("series_id").agg(F.count("*").alias("n_points")).select("series_id", "n_points", F.lit(float(dt)).alias("dt"), F.lit(t0).alias("t0"), F.lit(unit).alias("unit"))
