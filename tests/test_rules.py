import pytest
from pyspark.sql import functions as F

from seriate.functions import rules
from seriate.operators import semantics

NAN = float("nan")


def one(spark, cols, make):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} double" for k in names))
    return df.select(make({k: F.col(k) for k in names})).first()[0]


@pytest.mark.parametrize(
    "kind,slope,q,variant,want",
    [
        (1, 0.0019, 0.049, "cli", "flat"), (1, 0.002, 0.049, "cli", "noisy"), (1, 0.0, 0.05, "cli", "noisy"), (1, 0.01, 5.0, "cli", "trend"), (1, -0.01, 5.0, "cli", "trend"),
        (0, 0.5, 5.0, "cli", "noisy"), (2, 0.0099, 0.2, "cli", "oscillation"), (1, 0.0099, 0.3999, "cli", "oscillation"), (1, 0.0, 0.4, "cli", "noisy"), (0, 0.0, 0.3, "cli", "noisy"),
        (2, 0.5, 0.3, "cli", "noisy"), (2, 0.5, 0.3, "core", "oscillation"), (2, 0.5, 0.05, "core", "oscillation"), (1, 0.0, 0.3001, "core", "noisy"), (1, 0.0, 0.05, "core", "oscillation"),
        (1, NAN, 0.3, "cli", "noisy"), (1, 0.0, NAN, "cli", "noisy"), (1, NAN, 0.01, "core", "noisy"),
    ],
)
def test_patterns(spark, kind, slope, q, variant, want):
    assert one(spark, {"k": float(kind), "s": slope, "q": q}, lambda c: rules.pattern(c["k"].cast("int"), c["s"], c["q"], F.lit(10), variant)) == want


@pytest.mark.parametrize("variant,want", [("cli", "noisy"), ("core", "flat")])
def test_empty_segments(spark, variant, want):
    r = spark.range(1).select(rules.pattern(F.lit(1), F.lit(0.5), F.lit(0.1), F.lit(0), variant), rules.energy(F.lit(0.5), F.lit(0.1), F.lit(0)), rules.salience(F.lit(0), F.lit(9.0))).first()
    assert tuple(r) == (want, 0.0, 0)


@pytest.mark.parametrize("e,want", [(0.99, 0), (1.0, 1), (4.99, 1), (5.0, 2), (NAN, 2)])
def test_salience(spark, e, want):
    assert one(spark, {"e": e}, lambda c: rules.salience(F.lit(1), c["e"])) == want


def profile(**given):
    base = dict.fromkeys((*(f"frac_{k}" for k in rules.PATTERNS), *(f"n_motifs_{k}" for k in rules.PATTERNS), "energy_avg", "n_segments"), 0.0)
    names = {"flat": "frac_flat", "trend": "frac_trend", "osc": "frac_oscillation", "noisy": "frac_noisy", "e": "energy_avg", "n": "n_segments", "mf": "n_motifs_flat", "mt": "n_motifs_trend", "mo": "n_motifs_oscillation", "mn": "n_motifs_noisy"}
    return base | {names[k]: float(v) for k, v in given.items()}


@pytest.mark.parametrize(
    "given,want",
    [
        (dict(trend=0.9, flat=0.05, osc=0.05, noisy=0.2, e=50.1, n=3), "alarm_burst_regime"), (dict(trend=0.9, e=50, n=3), "trend_dominated"), (dict(trend=0.9, e=51, n=4), "trend_dominated"),
        (dict(trend=0.7, osc=0.05, noisy=0.05, e=20.1, n=4), "ramp_then_burst"), (dict(trend=0.7, osc=0.1, e=20, n=4), "trend_dominated"),
        (dict(flat=0.71, osc=0.06, mo=1, n=4), "flat_with_spike"), (dict(flat=0.71, osc=0.06, mo=1, n=5), "mostly_flat"), (dict(osc=0.6), "oscillation_dominated"), (dict(trend=0.6), "trend_dominated"),
        (dict(flat=0.7), "mostly_flat"), (dict(noisy=0.5), "noisy_dominated"), (dict(trend=0.2, osc=0.2, mo=1), "multi_bump"), (dict(trend=0.21, osc=0.21, flat=0.3, mo=1), "trend_oscillation_mix"),
        (dict(flat=0.51, trend=0.11), "flat_with_trend_bump"), (dict(flat=0.51, trend=0.1, e=15.1), "high_energy_mixed"), (dict(e=15), "mixed_other"),
        (dict(trend=1, n=2, mt=1, e=10), "trend_dominated"), (dict(trend=0.296667, osc=0.703333, n=6, mt=1, mo=1, e=17.2), "oscillation_dominated"), (dict(flat=0.786667, trend=0.213333, n=4, mf=2, mt=1, e=16.9), "flat_with_trend_bump"),
    ],
)
def test_clusters(spark, given, want):
    assert one(spark, profile(**given), rules.cluster) == want


@pytest.mark.parametrize(
    "given,want",
    [
        (dict(), ["none"]), (dict(osc=0.61, mo=1), ["oscillation_dominated"]), (dict(osc=0.6, mo=1), ["none"]), (dict(trend=0.61, mt=1), ["single_trend_regime"]), (dict(trend=0.61, mt=2), ["none"]),
        (dict(trend=0.6, mt=1), ["mixed_trend_regime"]), (dict(trend=0.3, mt=1), ["none"]), (dict(trend=0.21, osc=0.21), ["trend_oscillation_mix"]), (dict(flat=0.51, trend=0.11, mt=1), ["flat_with_trend_bump"]),
        (dict(flat=0.51, trend=0.11, mt=2), ["none"]), (dict(noisy=0.31), ["noisy_segments_present"]), (dict(e=15.1), ["high_energy"]), (dict(e=15), ["none"]), (dict(osc=0.7, mo=1, trend=0.3, noisy=0.4, e=16), ["oscillation_dominated", "trend_oscillation_mix", "noisy_segments_present", "high_energy"]),
    ],
)
def test_events(spark, given, want):
    assert one(spark, profile(**given), rules.events) == want


def test_unreadable_profiles(spark):
    df = spark.createDataFrame([("f", "x", "1.0")], "file string, frac_noisy string, n_segments string")
    assert semantics.clusters(df).first()["cluster"] == "mixed_other"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        semantics.events(df).collect()


def test_cluster_column_is_replaced_or_last(spark):
    df = spark.createDataFrame([("f", "old", "1")], "file string, cluster string, extra string")
    assert semantics.clusters(df).columns == ["file", "cluster", "extra"]
    assert semantics.clusters(df.drop("cluster")).columns[-1] == "cluster"


def test_motifs_and_profile_of_a_series_without_segments(spark):
    schema = "series_id string, seg_id bigint, len bigint, predictor_type int, slope double, q_step double"
    rows = [("s", k, 10, 1, s, 0.01) for k, s in enumerate([0.5, 0.5, 0.0, 0.5])]
    tagged = semantics.tags(spark.createDataFrame(rows, schema).withColumn("mean", F.lit(0.0)))
    got = semantics.motifs(tagged).orderBy("motif_id").collect()
    assert [(m.seg_start, m.seg_end, m.pattern, m.total_len) for m in got] == [(0, 1, "trend", 20), (2, 2, "flat", 10), (3, 3, "trend", 10)]
    meta = spark.createDataFrame([("s", 40, 1.0, "u"), ("none", 5, 1.0, "u")], "series_id string, n_points bigint, dt double, unit string")
    p = {r.file: r for r in semantics.profiles(tagged, meta).collect()}
    assert (p["s"].frac_trend, p["s"].n_motifs_trend, p["s"].n_motifs_flat, p["s"].n_segments) == (0.75, 2, 1, 4)
    assert (p["none"].n_segments, p["none"].frac_flat, p["none"].energy_avg) == (0, 0.0, 0.0)
    assert [(b.pattern, b.points) for b in semantics.pattern_points(tagged).orderBy("rank").collect()] == [("trend", 30), ("flat", 10)]
