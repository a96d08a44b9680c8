"""The rule tables: patterns, salience, events and clusters, as column expressions.

Thresholds and labels are fixed values that results depend on; rules are tried
from top to bottom, and the first that holds gives the label, except for
events, which are independent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERNS = ("flat", "trend", "oscillation", "noisy")


def _number(c: Column, holds: Column) -> Column:
    """NaN never satisfies a comparison (Spark would sort it above all numbers)."""
    return ~F.isnan(c) & holds


def pattern(predictor: Column, slope: Column, q_step: Column, length: Column, variant: str = "cli") -> Column:
    s = F.abs(slope)
    finite = lambda rule: _number(s, _number(q_step, rule))
    flat = finite((s < 0.002) & (q_step < 0.05))
    trend = _number(s, (predictor == 1) & (s >= 0.01))
    if variant == "cli":
        none, swing = "noisy", finite(predictor.isin(1, 2) & (s < 0.01) & (q_step >= 0.2) & (q_step < 0.4))
    elif variant == "core":
        none, swing = "flat", _number(q_step, predictor.isin(1, 2) & (q_step >= 0.05) & (q_step <= 0.3))
    else:
        raise ValueError(f"Unknown variant: {variant}")
    return F.when(length <= 0, none).when(flat, "flat").when(trend, "trend").when(swing, "oscillation").otherwise("noisy")


def energy(slope: Column, q_step: Column, length: Column) -> Column:
    return F.when(length <= 0, 0.0).otherwise(F.abs(slope) * length + q_step * length)


def salience(length: Column, e: Column) -> Column:
    return F.when(length <= 0, 0).when(_number(e, e < 1.0), 0).when(_number(e, e < 5.0), 1).otherwise(2)


def events(p: dict[str, Column]) -> Column:
    """The array of event labels of a profile, ``none`` where no rule holds."""
    flat, trend, osc, noisy = (p[f"frac_{k}"] for k in PATTERNS)
    single = (trend > 0.6) & (p["n_motifs_trend"] == 1)
    rules = [
        ("oscillation_dominated", (osc > 0.6) & (p["n_motifs_oscillation"] >= 1)),
        ("single_trend_regime", single),
        ("mixed_trend_regime", ~single & (trend > 0.3) & (trend <= 0.6) & (p["n_motifs_trend"] >= 1)),
        ("trend_oscillation_mix", (trend > 0.2) & (osc > 0.2)),
        ("flat_with_trend_bump", (flat > 0.5) & (trend > 0.1) & (trend < 0.4) & (p["n_motifs_trend"] == 1) & (osc < 0.1) & (noisy < 0.1)),
        ("noisy_segments_present", noisy > 0.3),
        ("high_energy", p["energy_avg"] > 15.0),
    ]
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    return F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)


def cluster(p: dict[str, Column]) -> Column:
    """The cluster label of a profile."""
    flat, trend, osc, noisy = (p[f"frac_{k}"] for k in PATTERNS)
    lively, e, n = osc + noisy, p["energy_avg"], p["n_segments"]
    rules = [
        ("alarm_burst_regime", (trend >= 0.9) & (flat <= 0.05) & (osc <= 0.05) & (noisy <= 0.2) & (e > 50) & (n <= 3)),
        ("ramp_then_burst", (trend >= 0.7) & (lively >= 0.1) & (e > 20) & (n >= 4)),
        ("flat_with_spike", (flat > 0.7) & (lively > 0.05) & (lively < 0.4) & (trend < 0.2) & (p["n_motifs_oscillation"] + p["n_motifs_noisy"] == 1) & (n <= 4)),
        ("oscillation_dominated", osc >= 0.6),
        ("trend_dominated", trend >= 0.6),
        ("mostly_flat", (flat >= 0.7) & (trend < 0.2) & (osc < 0.2)),
        ("noisy_dominated", noisy >= 0.5),
        ("multi_bump", (trend >= 0.2) & (trend <= 0.7) & (osc >= 0.2) & (osc < 0.6) & (flat < 0.3) & (p["n_motifs_oscillation"] >= 1)),
        ("flat_with_trend_bump", (flat > 0.5) & (trend > 0.1) & (trend < 0.4) & (osc < 0.1) & (noisy < 0.1)),
        ("trend_oscillation_mix", (trend > 0.2) & (osc > 0.2)),
        ("high_energy_mixed", e > 15),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise("mixed_other")
