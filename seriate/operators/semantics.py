"""From segment tables to tags, motifs, profiles, events and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import rules

PREDICTOR_NAMES = ("mean", "linear", "rw")
#: The header of profile files.
PROFILE_COLUMNS = (
    "file", "n_points", "dt", "unit", "n_segments", "frac_flat", "frac_trend", "frac_oscillation", "frac_noisy", "sal_min", "sal_max", "sal_avg",
    "energy_min", "energy_max", "energy_avg", "n_motifs_flat", "n_motifs_trend", "n_motifs_oscillation", "n_motifs_noisy",
)


def by_path(files: DataFrame) -> DataFrame:
    """(series_id, payload) of files (path, payload), keyed by their whole paths, so that equal base names stay apart."""
    return files.select(F.col("path").alias("series_id"), "payload")


def in_series() -> WindowSpec:
    return W.partitionBy("series_id").orderBy("seg_id")


def tags(segments: DataFrame, variant: str = "cli") -> DataFrame:
    """Segments with predictor name, pattern, salience and energy."""
    kind, length = F.col("predictor_type"), F.col("len")
    name = F.coalesce(F.get(F.array(*map(F.lit, PREDICTOR_NAMES)), kind.cast("int")), F.concat(F.lit("#"), kind.cast("string")))
    e = rules.energy(F.col("slope"), F.col("q_step"), length)
    df = segments.withColumn("pred", name).withColumn("patt", rules.pattern(kind, F.col("slope"), F.col("q_step"), length, variant)).withColumn("energy", e)
    return df.withColumn("sal", rules.salience(length, F.col("energy")))


def islands(tagged: DataFrame) -> DataFrame:
    """Tagged segments with the number of their run of equal patterns."""
    turned = F.when(F.col("patt") == F.lag("patt").over(in_series()), 0).otherwise(1)
    df = tagged.withColumn("turned", turned)
    return df.withColumn("motif_id", F.sum("turned").over(in_series().rowsBetween(W.unboundedPreceding, 0)) - 1).drop("turned")


def motifs(tagged: DataFrame) -> DataFrame:
    runs = islands(tagged).groupBy("series_id", "motif_id", "patt")
    return runs.agg(F.min("seg_id").alias("seg_start"), F.max("seg_id").alias("seg_end"), F.count("*").alias("n_segs"), F.sum("len").alias("total_len"), F.sum("energy").alias("total_energy")).withColumnRenamed("patt", "pattern")


def pattern_points(tagged: DataFrame) -> DataFrame:
    """Points, segments and motifs of each pattern of each series, by points, then by first appearance."""
    df = islands(tagged).groupBy("series_id", "patt").agg(F.sum("len").alias("points"), F.count("*").alias("n_segs"), F.count_distinct("motif_id").alias("n_motifs"), F.min("seg_id").alias("first_seg"))
    share = W.partitionBy("series_id")
    order = share.orderBy(F.desc("points"), "first_seg")
    return df.select("series_id", F.col("patt").alias("pattern"), "points", (F.col("points") / F.greatest(F.sum("points").over(share), F.lit(1))).alias("fraction"), "n_segs", "n_motifs", F.row_number().over(order).alias("rank"))


def summary(segments: DataFrame) -> DataFrame:
    """Extremes of a series' segments, as the verbose report has them."""
    return segments.groupBy("series_id").agg(
        F.count("*").alias("n_segments"), F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.avg("len").alias("len_avg"),
        F.min("slope").alias("slope_min"), F.max("slope").alias("slope_max"), F.min("q_step").alias("q_min"), F.max("q_step").alias("q_max"),
    )


def profiles(tagged: DataFrame, meta: DataFrame | None = None, dt: float = 1.0, unit: str = "unknown") -> DataFrame:
    """One row per series of ``meta`` (series_id, n_points, dt, unit), with 6 decimals (saliences 3), as files would hold them.

    Without ``meta`` the series are those of the segments, whose lengths add
    up to the points, and all share ``dt`` and ``unit``; nothing is joined.

    A pattern's motifs are counted as its segments whose predecessor has
    another pattern, so segments are aggregated once.
    """
    opens = F.coalesce(F.lag("patt").over(in_series()) != F.col("patt"), F.lit(True))
    df = tagged.withColumn("opens", opens)
    points = [F.sum(F.when(F.col("patt") == k, F.col("len")).otherwise(0)).alias(f"pts_{k}") for k in rules.PATTERNS]
    counts = [F.count_if((F.col("patt") == k) & F.col("opens")).alias(f"n_motifs_{k}") for k in rules.PATTERNS]
    marks = [f(c).alias(f"{short}_{n}") for c, short in (("sal", "sal"), ("energy", "energy")) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    agg = df.groupBy("series_id").agg(F.count("*").alias("n_segments"), F.sum("len").alias("pts"), *points, *counts, *marks)
    if meta is None:
        row = agg.withColumns({"n_points": F.col("pts"), "dt": F.lit(float(dt)), "unit": F.lit(unit)})
    else:
        row = meta.select("series_id", "n_points", "dt", "unit").join(agg, "series_id", "left")
    total = F.when(F.col("n_points") > 0, F.col("n_points")).otherwise(F.greatest(F.coalesce("pts", F.lit(0)), F.lit(1)))
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    return row.select(
        F.col("series_id").alias("file"), "n_points", "dt", "unit", or_zero("n_segments").alias("n_segments"),
        *(F.round(or_zero(f"pts_{k}") / total, 6).alias(f"frac_{k}") for k in rules.PATTERNS),
        *(F.round(or_zero(f"sal_{n}").cast("double"), 3).alias(f"sal_{n}") for n in ("min", "max", "avg")),
        *(F.round(or_zero(f"energy_{n}"), 6).alias(f"energy_{n}") for n in ("min", "max", "avg")),
        *(or_zero(f"n_motifs_{k}").alias(f"n_motifs_{k}") for k in rules.PATTERNS),
    )


def _numbers(df: DataFrame, lenient: bool) -> dict:
    """The rules' columns as numbers; missing columns are 0, and unreadable values 0 or an error."""
    out = {}
    for c in PROFILE_COLUMNS[4:]:
        whole = c.startswith("n_")
        if c not in df.columns:
            out[c] = F.lit(0)
        elif lenient:
            number = F.col(c).try_cast("double")
            out[c] = F.coalesce(number.cast("bigint") if whole else number, F.lit(0))
        else:
            out[c] = F.coalesce(F.col(c).cast("bigint" if whole else "double"), F.lit(0))
    return out


def events(profile: DataFrame) -> DataFrame:
    """(file, event_type): every event of every profile; values that are no numbers raise."""
    return profile.select("file", F.explode(rules.events(_numbers(profile, False))).alias("event_type"))


def clusters(profile: DataFrame) -> DataFrame:
    """Profiles with their cluster as the last column, replacing one there is; unreadable values count as 0."""
    return profile.withColumn("cluster", rules.cluster(_numbers(profile, True)))
