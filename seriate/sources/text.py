"""Text sources: series, alarm logs, profiles, tags and single value columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as a number: decimal, with exponent, infinite or not a number; digits may be parted by ``_``.
NUMBER = r"^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:inf|infinity|nan))$"
SPACE = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def number(c: Column) -> Column:
    """A string as a double; null if it is none."""
    s = stripped(c)
    return F.when(s.rlike(NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))


def series_from_text(spark: SparkSession, path: str, dt: float = 1.0, t0: str = "1970-01-01T00:00:00Z", unit: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(points, meta) of text files of one series each, named by their base name.

    Blank lines, lines that begin with ``#`` and lines whose first comma field
    is no number are passed over.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("series_id"), F.col("value").alias("text"))
    lines = files.select("series_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line")).withColumn("line", stripped(F.col("line")))
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).select("series_id", "at", number(F.split("line", ",")[0]).alias("value")).where("value is not null")
    points = rows.select("series_id", (F.row_number().over(W.partitionBy("series_id").orderBy("at")) - 1).cast("bigint").alias("idx"), "value")
    meta = files.select("series_id").distinct().withColumns({"dt": F.lit(float(dt)), "t0": F.lit(t0), "unit": F.lit(unit)})
    return points, meta


#: strptime's directives as datetime patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%I": "hh", "%p": "a", "%%": "%"}


def datetime_pattern(fmt: str) -> str:
    out, at = "", 0
    while at < len(fmt):
        if fmt[at] == "%":
            if fmt[at : at + 2] not in DIRECTIVES:
                raise ValueError(f"unsupported directive: {fmt[at : at + 2]}")
            out, at = out + DIRECTIVES[fmt[at : at + 2]], at + 2
        else:
            out, at = out + (f"'{fmt[at]}'" if fmt[at].isalpha() else fmt[at]), at + 1
    return out


def timestamp(c: Column, fmt: str | None = None) -> Column:
    """A time without zone; ISO texts with an offset become UTC.  Unreadable texts raise."""
    s = stripped(c)
    if fmt:
        return F.to_timestamp_ntz(s, F.lit(datetime_pattern(fmt)))
    aware = s.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & s.rlike(r"\d[T ]\d")
    return F.when(aware, F.to_utc_timestamp(s.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(s.cast("timestamp_ntz"))


def alarms_from_csv(spark: SparkSession, path: str, time_column: str = "timestamp", type_column: str = "type", severity_column: str = "severity", time_format: str | None = None) -> DataFrame:
    """(ts, type, severity): rows without a time are dropped, a missing type is empty, a missing severity 1."""
    raw = spark.read.csv(path, header=True)
    if time_column not in raw.columns:
        return spark.createDataFrame([], "ts timestamp_ntz, type string, severity double")
    kind = stripped(F.coalesce(F.col(type_column), F.lit(""))) if type_column in raw.columns else F.lit("")
    weight = F.coalesce(number(F.col(severity_column)), F.lit(1.0)) if severity_column in raw.columns else F.lit(1.0)
    rows = raw.where(F.length(F.coalesce(F.col(time_column), F.lit(""))) > 0)
    return rows.select(timestamp(F.col(time_column), time_format).alias("ts"), kind.alias("type"), weight.alias("severity"))


def profiles_from_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def tags_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Exported tags with their numbers as numbers."""
    whole, real = ("seg_id", "start", "end", "len", "sal"), ("energy", "mean", "slope", "Q")
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.col(c).cast("double").cast("int").alias(c) if c in whole else F.col(c).cast("double").alias(c) if c in real else F.col(c) for c in raw.columns))


def values_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a one-column file whose first row is its header."""
    raw = spark.read.csv(path, header=True)
    return raw.select(number(F.col(f"`{raw.columns[0]}`")).alias("value")).where("value is not null")
