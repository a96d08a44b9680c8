import pytest
from pyspark.sql import functions as F

from seriate.functions import text as fmt
from seriate.sources import generate, text


@pytest.mark.parametrize("raw", ["1", " -2.5 ", "+.5", "3.", "1e3", "1_000", "inf", "-Infinity", "1d", "1f", "0x1p3", "value", "", "1__0", "_1", "1 2", "\t7 "])
def test_numbers_are_those_of_python(spark, raw):
    try:
        want = float(raw)
    except ValueError:
        want = None
    got = spark.createDataFrame([(raw,)], "s string").select(text.number(F.col("s"))).first()[0]
    assert got == want or raw == "\t7 " and got in (7.0, None)


def test_series_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"# value\r\nvalue\r\n1.5,x\n\n  2 \r nonsense,3\n,4\n-1e1\n")
    (tmp_path / "empty.csv").write_text("value\n")
    points, meta = text.series_from_text(spark, str(tmp_path), 60.0, "0", "kW")
    assert [(r.series_id, r.idx, r.value) for r in points.orderBy("idx").collect()] == [("a.csv", 0, 1.5), ("a.csv", 1, 2.0), ("a.csv", 2, -10.0)]
    assert {r.series_id for r in meta.collect()} == {"a.csv", "empty.csv"}


def test_value_and_tag_files(spark, tmp_path):
    f = tmp_path / "v.csv"
    f.write_text("1.0\n2.0\nx\n3\n")
    assert [r.value for r in text.values_from_csv(spark, str(f)).collect()] == [2.0, 3.0]
    f.write_text("seg_id,start,end,len,pred,patt,sal,energy,mean,slope,Q\n0.0,0,9,10,linear,flat,1,2.5,0.1,0.2,0.3\n")
    r = text.tags_from_csv(spark, str(f)).first()
    assert (r.seg_id, r.energy, r.pred, r.Q) == (0, 2.5, "linear", 0.3)


def test_time_patterns():
    assert text.datetime_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    with pytest.raises(ValueError):
        text.datetime_pattern("%Q")


def test_number_texts():
    assert [fmt.g(x, 10) for x in (0.1, 1e-7, 12345678901.0)] == ["0.1", "1e-07", "1.23456789e+10"]
    assert fmt.profile_row({"file": "a", "dt": 1.0, "frac_flat": 0.125, "sal_avg": 1.0}) == ["a", "1", "0.125000", "1.000"]


@pytest.mark.parametrize("kind", generate.KINDS)
def test_generators(spark, kind):
    rows = generate.series(spark, kind).collect()
    assert len(rows) == 300 and rows == generate.series(spark, kind).collect()


def test_generator_kind_is_checked(spark):
    with pytest.raises(ValueError):
        generate.series(spark, "square")
