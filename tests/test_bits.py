from pyspark.sql import functions as F

from seriate.functions import bits
from seriate.functions.blobs import unvarints, varints

EDGES = [0, 1, -1, 63, -64, 64, -65, 8191, -8192, 8192, 2**31 - 1, -(2**31), 2**31, 2**63 - 1, -(2**63)]


def test_zigzag_and_lengths(spark):
    df = spark.createDataFrame([(v,) for v in EDGES], "v bigint").select("v", bits.zigzag(F.col("v")).alias("z"))
    rows = df.select("v", "z", bits.unzigzag(F.col("z")).alias("back"), bits.varint_length(F.col("z")).alias("n")).collect()
    for r in rows:
        z = (2 * r.v if r.v >= 0 else -2 * r.v - 1)
        assert r.z & (2**64 - 1) == z and r.back == r.v
        assert r.n == len(varints([r.v])) == max(1, -(-z.bit_length() // 7))


def test_varints_round_trip():
    assert unvarints(varints(EDGES), len(EDGES)).tolist() == EDGES
    assert unvarints(b"\x01\x02\xff", 2).tolist() == [-1, 1]
    assert varints([]) == b"" and unvarints(b"", 0).tolist() == []


def test_floor_division_of_floats(spark):
    rows = [(1.0, 0.1), (7.5, 2.5), (0.3, 0.1), (10.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(bits.float_floordiv(F.col("a"), F.col("b"))).collect()] == [a // b for a, b in rows]
