"""Segmentation, compact encoding and semantic profiling of time series on Spark."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

__version__ = "0.1.0"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers that the driver's machine starts find this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in sys.path:
        sys.path.insert(0, root)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    return spark
