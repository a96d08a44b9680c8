"""One series in memory: the whole codec as two calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from . import ship
from .params import API
from .sources import blobs


@dataclass
class TimeSeries:
    values: list[float] = field(default_factory=list)
    dt: float = 1.0
    t0: str = "1970-01-01T00:00:00Z"
    unit: str = "unknown"


def encode_timeseries(ts: TimeSeries, spark: SparkSession, **params) -> bytes:
    """The encoded series; parameters as in :class:`seriate.params.CodecParams`."""
    p = API.but(**params)
    if not ts.values:
        raise ValueError("an empty series cannot be encoded")
    ship(spark)
    points = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(ts.values)], "series_id string, idx bigint, value double")
    meta = spark.createDataFrame([("s", float(ts.dt), ts.t0, ts.unit)], "series_id string, dt double, t0 string, unit string")
    return bytes(blobs.encode(points, meta, p).first()["payload"])


def decode_timeseries(data: bytes, spark: SparkSession) -> TimeSeries:
    from .functions.blobs import parse

    m = parse(data)
    ship(spark)
    rows = blobs.decode(spark.createDataFrame([("s", bytes(data))], "series_id string, payload binary")).orderBy("idx").collect()
    return TimeSeries([r["value"] for r in rows], m.dt, m.t0, m.unit)
