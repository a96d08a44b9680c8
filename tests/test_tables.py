from seriate.sources import tables


def test_rows_that_tie_in_their_order_are_numbered_alike_whatever_order_they_come_in(spark):
    rows = [("s", 1, float(v)) for v in (16, 13, 40, 2)] + [("s", 0, 50.0)]
    for some in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(some, "k string, o bigint, v double").coalesce(1)
        got = [r.value for r in tables.series(df, "k", "v", ["o"]).orderBy("idx").collect()]
        assert got == [50.0, 2.0, 13.0, 16.0, 40.0]
