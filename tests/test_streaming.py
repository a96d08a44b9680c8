from datetime import datetime, timedelta

import pandas as pd

from seriate.operators import segment
from seriate.streaming import alarms, segments


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_stream_closes_the_segments_of_the_batch(spark, tmp_path):
    xs = [float((i * 7919) % 13) + (20 if i > 60 else 0) for i in range(150)]
    for k in range(3):
        part = pd.DataFrame({"series_id": "s", "idx": range(50 * k, 50 * k + 50), "value": xs[50 * k : 50 * k + 50]})
        part.to_parquet(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema("series_id string, idx bigint, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = sorted((r.start_idx, r.end_idx) for r in drained(segments.adaptive(stream, "mean", 8, 32, 14.0), "closed"))
    batch = segment.adaptive(spark.read.parquet(str(tmp_path)), "mean", 8, 32, 14.0).groupBy("seg_id").agg({"idx": "min", "t": "max"}).orderBy("seg_id").collect()
    want = [(r["min(idx)"], r["min(idx)"] + r["max(t)"]) for r in batch]
    assert got == want[:-1]


def test_stream_bins(spark, tmp_path):
    t0 = datetime(2025, 1, 1)
    rows = [(t0 + timedelta(seconds=s), k, v) for s, k, v in [(5, "a", 1.0), (50, "b", 2.0), (70, "", 1.0), (5000, "a", 1.0), (9000, "a", 1.0)]]
    spark.createDataFrame(rows, "ts timestamp, type string, severity double").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("ts timestamp, type string, severity double").parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.5), ("_", 2.0)], "type string, weight double")
    got = {r.bin: r.value for r in drained(alarms.intensity(log, weights, "1 minute", "10 minutes"), "bins")}
    assert got[t0] == 4.0 and got[t0 + timedelta(minutes=1)] == 2.0
