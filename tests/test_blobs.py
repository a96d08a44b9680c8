import struct

import numpy as np
import pytest

from seriate.api import TimeSeries, decode_timeseries, encode_timeseries
from seriate.functions import blobs
from seriate.sources import blobs as source

END = blobs.SUFFIX


def made(coding="varint", n=3):
    e = np.zeros(1, blobs.ENTRY)
    e["end_idx"], e["q_step"], e["mean"] = n - 1, 0.5, 1.0
    ctx = blobs.context(1, "0", "step")
    return blobs.head(n, 1, ctx) + blobs.body(e, [np.arange(n)], coding), blobs.HEADER.size + len(ctx)


def patched(data, at, fmt, *values):
    out = bytearray(data)
    struct.pack_into(fmt, out, at, *values)
    return bytes(out)


def corrupt():
    good, seg = made()
    res = seg + blobs.ENTRY.itemsize
    block = res + blobs.RESIDUALS.size
    raw, _ = made("raw")
    return [
        (good[:10], "contain header"), (patched(good, 0, "4s", b"XXXX"), "magic"), (patched(good, 4, "<H", 2), "version"),
        (patched(good, 12, "<I", 20_000_000), "Suspicious n_points"), (patched(good, 16, "<I", 2_000_000), "Suspicious n_segments"),
        (patched(good, 8, "<I", 10_000), "header_len"), (patched(good, 28, "2s", b"[["), "context"), (good[: seg + 10], "segment table"), (good[: res + 3], "residual section header"),
        (patched(good, res, "<I", 7), "coding_type"), (good[: block + 2], "residual block header"), (good[:-1], "residual block data"),
        (patched(good, block, "<I", 5), "seg_id"), (patched(raw, block + 4, "<I", 2), "seg_len"), (patched(good, block + 4, "<I", 9), "varint"),
        (patched(good, block + 4, "<I", 2), "length mismatch"), (patched(good, seg + 8, "<I", 3), "predictor_type"), (patched(good, seg + 4, "<I", 99), "beyond n_points"),
        (good[: block + 8] + struct.pack("<I", 12) + b"\xff" * 12, "too long"),
    ]


@pytest.mark.parametrize("case", range(19))
def test_corrupt_blobs_are_named(case):
    data, says = corrupt()[case]
    with pytest.raises(blobs.CorruptBlobError, match=f"(?i){says}"):
        blobs.parse(data)


def test_metadata_does_not_read_residuals():
    good, seg = made()
    assert blobs.parse(patched(good, seg + blobs.ENTRY.itemsize, "<I", 7), False).coding_type == 7
    assert blobs.parse(good).residuals[0].tolist() == [0, 1, 2]


def test_missing_context_keys_have_defaults():
    e = np.zeros(1, blobs.ENTRY)
    m = blobs.parse(blobs.head(1, 1, b"{}") + blobs.body(e, [np.zeros(1, int)], "raw"))
    assert (m.dt, m.t0, m.unit) == (1.0, "1970-01-01T00:00:00Z", "unknown")


def test_gaps_are_zero_and_later_segments_win(spark):
    e = np.zeros(2, blobs.ENTRY)
    e["start_idx"], e["end_idx"], e["mean"], e["q_step"] = [1, 2], [3, 2], [5.0, 9.0], 1.0
    data = blobs.head(6, 2, b"{}") + blobs.body(e, [np.zeros(3, int), np.ones(1, int)], "varint")
    df = spark.createDataFrame([("s", data)], "series_id string, payload binary")
    assert [r.value for r in source.decode(df).orderBy("idx").collect()] == [0.0, 5.0, 10.0, 5.0, 0.0, 0.0]


def test_raw_residuals_must_fit(spark):
    with pytest.raises(ValueError, match="32 bits"):
        blobs.body(np.zeros(1, blobs.ENTRY), [np.array([2**31])], "raw")


@pytest.mark.parametrize("params", [{}, {"segment_mode": "adaptive", "predictor": "auto", "residual_coding": "varint", "min_segment_length": 30, "max_segment_length": 80, "mse_threshold": 0.2}])
def test_api_round_trip(spark, params):
    xs = [0.1 * i for i in range(200)]
    data = encode_timeseries(TimeSeries(xs, 60.0, "2025-01-01T00:00:00Z", "kW"), spark, **params)
    back = decode_timeseries(data, spark)
    assert (back.dt, back.t0, back.unit) == (60.0, "2025-01-01T00:00:00Z", "kW")
    assert back.values == pytest.approx(xs, abs=1e-3)


def test_empty_series_and_unknown_parameters(spark):
    with pytest.raises(ValueError):
        encode_timeseries(TimeSeries([]), spark)
    with pytest.raises(ValueError):
        encode_timeseries(TimeSeries([1.0]), spark, predictor="cubic")


def test_files_are_found_once_and_by_suffix(spark, tmp_path):
    data, _ = made()
    source.write(spark.createDataFrame([("b", data), ("a", data)], "series_id string, payload binary"), str(tmp_path / "x"))
    (tmp_path / "x/deep").mkdir()
    (tmp_path / f"x/deep/c{END}").write_bytes(data)
    (tmp_path / "x/no.txt").write_text("no")
    found = lambda *a, **k: [r.series_id for r in source.read(spark, *a, **k).collect()]
    x = str(tmp_path / "x")
    assert found(x) == [f"a{END}", f"b{END}"]
    assert found(x, recursive=True) == [f"a{END}", f"b{END}", f"c{END}"]
    assert found(x, f"{x}/a{END}", f"{x}/no.txt") == [f"a{END}", f"b{END}"]
    assert found(f"{x}/no.txt") == []


def test_files_in_a_store_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.seriate.link./in", f"file://{tmp_path}/in")
    data, _ = made()
    rows = spark.createDataFrame([("b", data), ("a", b"old"), ("c" + END, data)], "series_id string, payload binary")
    at = "viewfs://seriate/in/x"
    source.write(rows, at)
    source.write(spark.createDataFrame([("a", data)], rows.schema), at)
    assert sorted(p.name for p in (tmp_path / "in/x").iterdir() if not p.name.startswith(".")) == [f"a{END}", f"b{END}", f"c{END}"]
    assert {bytes(r.payload) for r in source.read(spark, at).collect()} == {data}
    with pytest.raises(ValueError, match="not a file name"):
        source.write(spark.createDataFrame([("d", data), ("e/f", data)], rows.schema), at)
    assert not list((tmp_path / "in/x").glob("d*")) and not list((tmp_path / "in/x").glob(".staging*"))
    # A folder that names no store, as `spark.checkpoint.dir` may, is one of the default store.
    assert source.qualified(spark, f"{tmp_path}/") == f"file:{tmp_path}" and source.qualified(spark, at) == at
