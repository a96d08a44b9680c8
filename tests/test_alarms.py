from datetime import datetime, timedelta

import pytest

from seriate.operators import alarms
from seriate.sources import generate, text

T0 = datetime(2025, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=s), k, float(v)) for s, k, v in rows], "ts timestamp_ntz, type string, severity double")


def values(df):
    rows = df.orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(len(rows)))
    return [r.value for r in rows]


def test_weights_grow_with_frequency_and_merge_empty_types(spark):
    rows = [(0, "a", 1), (1, "a", 1), (2, "b", 1), (3, "", 1), (4, "_", 1), (5, None, 1)]
    got = [(r.type, r.n, r.weight) for r in alarms.type_weights(log(spark, rows)).orderBy("weight").collect()]
    assert got == [("b", 1, 1.0), ("a", 2, 1.5), ("_", 3, 2.0)]


def test_bins_start_at_the_first_alarm_and_are_dense(spark):
    assert values(alarms.intensity(log(spark, [(30, "a", 1), (89.9, "a", 2), (90, "b", 4), (270, "a", 1)]), 60)) == [4.5, 4.0, 0.0, 0.0, 1.5]
    assert values(alarms.intensity(log(spark, [(0, "a", 3)]), 60)) == [3.0]
    assert values(alarms.intensity(log(spark, []), 60)) == []


def test_fractional_bins_divide_as_floats_do(spark):
    got = values(alarms.intensity(log(spark, [(0, "a", 1), (1.0, "a", 1)]), 0.1))
    assert len(got) == int(1.0 // 0.1) + 1 and got[-1] == 1.0


def test_width_must_be_positive(spark):
    with pytest.raises(ValueError):
        alarms.intensity(log(spark, []), 0)


def test_csv_log(spark, tmp_path):
    f = tmp_path / "log.csv"
    f.write_text("when,type,severity\n2025-01-01T00:00:00, A ,2\n,B,1\n2025-01-01T00:00:30+00:00,,x\n2025-01-01T02:00:00+01:00,C,\n")
    got = sorted(tuple(r) for r in text.alarms_from_csv(spark, str(f), "when").collect())
    assert got == [(T0, "A", 2.0), (T0 + timedelta(seconds=30), "", 1.0), (T0 + timedelta(hours=1), "C", 1.0)]
    f.write_text("when,type\n01/02/2025 03:04:05,A\n")
    assert text.alarms_from_csv(spark, str(f), "when", time_format="%d/%m/%Y %H:%M:%S").first().ts == datetime(2025, 2, 1, 3, 4, 5)
    assert text.alarms_from_csv(spark, str(f), "absent").count() == 0


def test_generated_log(spark):
    df = generate.alarms(spark)
    assert df.where("type = 'C'").count() == 50
    assert df.collect() == generate.alarms(spark).collect()
