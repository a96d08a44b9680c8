"""The readable report on one encoded series, from small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text
from . import semantics


def describe(meta: DataFrame, segments: DataFrame) -> dict[str, DataFrame]:
    """The report's tables: meta (with the ratio to plain doubles), tags, summary, motifs and breakdown."""
    tagged = semantics.tags(segments)
    with_ratio = meta.selectExpr("*", "n_points * 8 AS raw_bytes", "coalesce(try_divide(n_points * 8.0D, n_bytes), 0.0D) AS ratio")
    return {"meta": with_ratio, "tags": tagged, "summary": semantics.summary(segments), "motifs": semantics.motifs(tagged), "breakdown": semantics.pattern_points(tagged)}


def lines(tables: dict[str, DataFrame], name: str, verbose: bool = False) -> list[str]:
    """The report on the only series in ``tables``; the segment table of one series is small."""
    m = tables["meta"].first()
    tags = [r.asDict() for r in tables["tags"].orderBy("seg_id").collect()]
    out = [f"File        : {name}", f"Size        : {m.n_bytes} bytes", "", "Time series :", f"  points    : {m.n_points}", f"  dt        : {m.dt} s", f"  t0        : {m.t0}", f"  unit      : {m.unit}", f"  segments  : {m.n_segments}", ""]
    out += ["Compression (vs raw float64):", f"  raw_size  : {m.raw_bytes} bytes", f"  ratio     : {m.ratio:.3f}x", "", "Segments overview:", *text.aligned(text.TAGS, map(text.tag_row, tags))]
    if not verbose or not tags:
        return out
    s = tables["summary"].first()
    energies, sal = [r["energy"] for r in tags], [r["sal"] for r in tags]
    counts: dict[str, int] = {}
    for r in tags:
        counts[r["patt"]] = counts.get(r["patt"], 0) + 1
    out += ["", "Stats:", f"  seg_len : min={s.len_min}, max={s.len_max}, avg={s.len_avg:.2f}", f"  slope   : min={s.slope_min:.6f}, max={s.slope_max:.6f}", f"  Q       : min={s.q_min:g}, max={s.q_max:g}"]
    out += [f"  energy  : min={min(energies):.3f}, max={max(energies):.3f}, avg={sum(energies) / len(energies):.3f}", "  patterns: " + ", ".join(f"{k}={v}" for k, v in counts.items()), f"  salience: min={min(sal)}, max={max(sal)}, avg={sum(sal) / len(sal):.2f}"]
    out += ["Motifs:", *text.aligned(text.MOTIFS, (text.motif_row(r.asDict()) for r in tables["motifs"].orderBy("motif_id").collect()))]
    rows = tables["breakdown"].orderBy("rank").collect()
    return [*out, "Profile:", *text.aligned(("pattern", "points", "frac_pts", "segs", "motifs"), ([r.pattern, str(r.points), f"{r.fraction:.3f}", str(r.n_segs), str(r.n_motifs)] for r in rows))]
