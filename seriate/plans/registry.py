"""Registered queries over the driver tables and their DuckDB counterparts.

Doubles are rounded on both sides, mostly to 6 decimals.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import unzigzag, varint_length, zigzag
from ..operators import alarms, coding, segment, semantics, sizes
from ..params import PREDICTORS, CodecParams
from ..sources import blobs, generate, tables, text

Query = Callable[[SparkSession, str], DataFrame]
#: Users have some 60 events, suppliers some 600 lines.
USER = CodecParams(segment_length=16, min_segment_length=8, max_segment_length=32, mse_threshold=700.0)
SUPPLIER = CodecParams(segment_length=32)
UNIT = {"dt": 1.0, "t0": "0", "unit": "step"}

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- SQL fragments -------------------------------------------------------

_POINTS = {
    "user": "pts AS (SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value FROM events)",
    "supplier": "pts AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, CAST(l_quantity AS DOUBLE) AS value FROM lineitem)",
}


def _seg(length: int) -> str:
    return f"seg AS (SELECT series_id, idx, value, idx // {length} AS seg_id, idx // {length} * {length} AS start_idx, idx % {length} AS t FROM pts)"


_FIT = """fit AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean,
  CASE WHEN count(*) OVER w = 1 THEN 0.0 ELSE regr_slope(value, t) OVER w END AS slope,
  CASE WHEN count(*) OVER w = 1 THEN value ELSE regr_intercept(value, t) OVER w END AS intercept,
  var_pop(value) OVER w AS variance, first(value ORDER BY idx) OVER w AS seed,
  coalesce(lag(value) OVER (PARTITION BY series_id, seg_id ORDER BY idx), value) AS walked
  FROM seg WINDOW w AS (PARTITION BY series_id, seg_id))"""
_PRED = {"mean": "mean", "linear": "intercept + slope * t", "rw": "walked"}


def _coded(kind: str, source: str = "fit", out: str = "coded", tag: str = "") -> str:
    k = PREDICTORS[kind]
    back = f"seed + sum(q{tag} * q_step{tag}) OVER (PARTITION BY series_id, seg_id ORDER BY idx)" if kind == "rw" else f"pred{tag} + q{tag} * q_step{tag}"
    return f"""r{tag} AS (SELECT *, {_PRED[kind]} AS pred{tag}, value - ({_PRED[kind]}) AS residual{tag} FROM {source}),
s{tag} AS (SELECT *, greatest(0.5 * stddev_pop(residual{tag}) OVER (PARTITION BY series_id, seg_id), 1e-6) AS q_step{tag} FROM r{tag}),
z{tag} AS (SELECT *, CAST(round_even(CAST(residual{tag} / q_step{tag} AS DOUBLE), 0) AS BIGINT) AS q{tag} FROM s{tag}),
{out} AS (SELECT *, {k} AS predictor_type{tag}, {back} AS decoded{tag} FROM z{tag})"""


_SEGMENTS = "segments AS (SELECT series_id, seg_id, start_idx, start_idx + n - 1 AS end_idx, n AS len, predictor_type, mean, slope, intercept, q_step, seed FROM coded WHERE t = 0)"


def _tags(variant: str) -> str:
    swing = "abs(slope) < 0.01 AND q_step >= 0.2 AND q_step < 0.4" if variant == "cli" else "q_step >= 0.05 AND q_step <= 0.3"
    return f"""tagged AS (SELECT *, abs(slope) * len + q_step * len AS energy,
  CASE predictor_type WHEN 0 THEN 'mean' WHEN 1 THEN 'linear' ELSE 'rw' END AS pred,
  CASE WHEN abs(slope) < 0.002 AND q_step < 0.05 THEN 'flat' WHEN predictor_type = 1 AND abs(slope) >= 0.01 THEN 'trend'
    WHEN predictor_type IN (1, 2) AND {swing} THEN 'oscillation' ELSE 'noisy' END AS patt,
  CASE WHEN abs(slope) * len + q_step * len < 1 THEN 0 WHEN abs(slope) * len + q_step * len < 5 THEN 1 ELSE 2 END AS sal FROM segments),
islands AS (SELECT *, sum(turned) OVER (PARTITION BY series_id ORDER BY seg_id) - 1 AS motif_id FROM
  (SELECT *, CASE WHEN patt = lag(patt) OVER (PARTITION BY series_id ORDER BY seg_id) THEN 0 ELSE 1 END AS turned FROM tagged))"""


def _profile() -> str:
    parts = ", ".join(f"round(sum(CASE WHEN patt = '{k}' THEN len ELSE 0 END) / sum(len), 6) AS frac_{k}, count(DISTINCT motif_id) FILTER (patt = '{k}') AS n_motifs_{k}" for k in ("flat", "trend", "oscillation", "noisy"))
    return f"""profile AS (SELECT series_id AS file, CAST(sum(len) AS BIGINT) AS n_points, 1.0::DOUBLE AS dt, 'step' AS unit, count(*) AS n_segments, {parts},
  CAST(min(sal) AS DOUBLE) AS sal_min, CAST(max(sal) AS DOUBLE) AS sal_max, round(avg(sal), 3) AS sal_avg,
  round(min(energy), 6) AS energy_min, round(max(energy), 6) AS energy_max, round(avg(energy), 6) AS energy_avg FROM islands GROUP BY series_id)"""


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _scaled(points: str) -> str:
    """Values of suppliers' quantities (1 to 50) at a tenth and a hundredth, which reach all patterns."""
    return points.replace("CAST(l_quantity AS DOUBLE)", "CAST(l_quantity AS DOUBLE) / CASE l_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 20.0 ELSE 40.0 END")


_SCALED = _scaled(_POINTS["supplier"])
_USER = (_POINTS["user"], _seg(USER.segment_length), _FIT)
_CHAIN = (_SCALED, _seg(SUPPLIER.segment_length), _FIT, _coded("linear"), _SEGMENTS)


def _scaled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("l_suppkey") % 3 == 0, 1.0).when(F.col("l_suppkey") % 3 == 1, 20.0).otherwise(40.0)
    return tables.series(tables.table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_quantity").cast("double") / by, ["l_shipdate", "l_orderkey", "l_linenumber"])


def _user_coded(spark: SparkSession, sf_dir: str, predictor: str) -> DataFrame:
    p = USER.but(predictor=predictor)
    return coding.coded(segment.segmented(segment.checked(tables.user_series(spark, sf_dir)), p), p)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.segments(coding.coded(segment.segmented(segment.checked(_scaled_series(spark, sf_dir)), SUPPLIER), SUPPLIER))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.profiles(semantics.tags(_segments(spark, sf_dir)), dt=UNIT["dt"], unit=UNIT["unit"])


# ---- series and segments -------------------------------------------------


@_register("series_points", _sql(_POINTS["user"], select="SELECT series_id, idx, value FROM pts"))
def series_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_series(spark, sf_dir)


@_register("seg_fixed", _sql(_POINTS["supplier"], _seg(32), select="SELECT series_id, seg_id, min(start_idx) AS start_idx, max(idx) AS end_idx, count(*) AS len FROM seg GROUP BY series_id, seg_id"))
def seg_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segment.fixed(tables.supplier_series(spark, sf_dir), 32)
    return seg.groupBy("series_id", "seg_id").agg(F.min("start_idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("len"))


def _adaptive_sql(model: str, least: int, most: int, threshold: float, points: str) -> str:
    sse = {"mean": "syy2 - sy2 * sy2 / m", "linear": "CASE WHEN m > 1 THEN syy2 - sy2 * sy2 / m - pow(sty2 - (m - 1) / 2.0 * sy2, 2) / (m * (m * m - 1) / 12.0) ELSE 0.0 END", "rw": "sdd2"}[model]
    closed_first = str(least == 1 and (threshold < 0 or most == 1)).lower()
    return f"""WITH RECURSIVE {points},
fold(series_id, idx, start_idx, n, closed, x0, prev, sy, syy, sty, sdd) AS (
  SELECT series_id, idx, idx, 1::BIGINT, {closed_first}, value, value, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM pts WHERE idx = 0
  UNION ALL
  SELECT series_id, idx2, CASE WHEN take THEN start_idx ELSE idx2 END, CASE WHEN take THEN m ELSE 1 END,
    CASE WHEN take THEN m >= {least} AND (err > {threshold} OR m >= {most}) ELSE {closed_first} END,
    CASE WHEN take THEN x0 ELSE value END, value, CASE WHEN take THEN sy2 ELSE 0.0 END, CASE WHEN take THEN syy2 ELSE 0.0 END,
    CASE WHEN take THEN sty2 ELSE 0.0 END, CASE WHEN take THEN sdd2 ELSE 0.0 END
  FROM (SELECT *, NOT closed AND (m <= {least} OR err <= {threshold}) AS take FROM
    (SELECT *, greatest({sse}, 0.0) / m AS err FROM
      (SELECT f.*, p.idx AS idx2, p.value, f.n + 1 AS m, f.sy + (p.value - f.x0) AS sy2, f.syy + pow(p.value - f.x0, 2) AS syy2,
        f.sty + f.n * (p.value - f.x0) AS sty2, f.sdd + pow(p.value - f.prev, 2) AS sdd2
       FROM fold f JOIN pts p ON p.series_id = f.series_id AND p.idx = f.idx + 1)))
), bounds AS (SELECT series_id, start_idx, max(idx) AS end_idx FROM fold GROUP BY series_id, start_idx)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY start_idx) - 1 AS seg_id, start_idx, end_idx, end_idx - start_idx + 1 AS len FROM bounds"""


def _adaptive(model: str, least: int, most: int, threshold: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seg = segment.adaptive(segment.checked(tables.user_series(spark, sf_dir)), model, least, most, threshold)
        return seg.groupBy("series_id", "seg_id").agg(F.min("start_idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("len"))

    return run


for _model, _limit in (("linear", 700.0), ("mean", 900.0), ("rw", 1500.0)):
    _register(f"seg_adaptive_{_model}", _adaptive_sql(_model, 8, 32, _limit, _POINTS["user"]))(_adaptive(_model, 8, 32, _limit))


@_register("seg_stats", _sql(*_USER, select="SELECT series_id, seg_id, n, round(mean, 6) AS mean, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(variance, 2) AS variance, seed FROM fit WHERE t = 0"))
def seg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = coding.fitted(segment.fixed(tables.user_series(spark, sf_dir), USER.segment_length))
    return fit.where("t = 0").select("series_id", "seg_id", "n", *_r("mean", "slope", "intercept"), F.round("variance", 2).alias("variance"), "seed")


# ---- predictors, residuals, decoding ---------------------------------------


def _predictor(kind: str) -> None:
    parts = (*_USER, _coded(kind))

    @_register(f"pred_{kind}", _sql(*parts, select="SELECT series_id, idx, round(pred, 6) AS pred, round(residual, 6) AS residual FROM coded"))
    def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _user_coded(spark, sf_dir, kind).select("series_id", "idx", *_r("pred", "residual"))

    @_register(f"decode_{kind}", _sql(*parts, select="SELECT series_id, idx, round(decoded, 6) AS decoded FROM coded"))
    def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
        return coding.reconstructed(_user_coded(spark, sf_dir, kind)).select("series_id", "idx", *_r("decoded"))


for _kind in PREDICTORS:
    _predictor(_kind)


@_register("quantized_residuals", _sql(*_USER, _coded("linear"), select="SELECT series_id, seg_id, idx, round(q_step, 6) AS q_step, q FROM coded"))
def quantized_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_coded(spark, sf_dir, "linear").select("series_id", "seg_id", "idx", *_r("q_step"), "q")


_AUTO = (_POINTS["supplier"], _seg(32), _FIT, _coded("mean", "fit", "c0", "0"), _coded("linear", "c0", "c1", "1"), _coded("rw", "c1", "c2", "2"))
_AUTO_SQL = _sql(*_AUTO, "m AS (SELECT series_id, seg_id, avg(pow(value - decoded0, 2)) AS m0, avg(pow(value - decoded1, 2)) AS m1, avg(pow(value - decoded2, 2)) AS m2 FROM c2 GROUP BY series_id, seg_id)", select="SELECT series_id, seg_id, CASE WHEN m1 < m0 AND m1 <= m2 THEN 1 WHEN m2 < m0 AND m2 < m1 THEN 2 ELSE 0 END AS predictor_type, round(m0, 6) AS mse0, round(m1, 6) AS mse1, round(m2, 6) AS mse2 FROM m")


@_register("auto_predictor", _AUTO_SQL)
def auto_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SUPPLIER.but(predictor="auto")
    df = coding.coded(segment.segmented(segment.checked(tables.supplier_series(spark, sf_dir)), p), p)
    return df.where("t = 0").select("series_id", "seg_id", "predictor_type", *_r("mse0", "mse1", "mse2"))


@_register("rmse_by_series", _sql(*_USER, _coded("rw"), select="SELECT series_id, count(*) AS n_points, round(sqrt(avg(pow(value - decoded, 2))), 6) AS rmse, round(max(abs(value - decoded)), 6) AS max_abs_error FROM coded GROUP BY series_id"))
def rmse_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.errors(coding.reconstructed(_user_coded(spark, sf_dir, "rw"))).select("series_id", "n_points", *_r("rmse", "max_abs_error"))


@_register("zigzag_residuals", _sql(*_USER, _coded("linear"), select="SELECT series_id, idx, q, CASE WHEN q < 0 THEN -2 * q - 1 ELSE 2 * q END AS z, q AS back FROM coded"))
def zigzag_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_coded(spark, sf_dir, "linear").select("series_id", "idx", "q", zigzag(F.col("q")).alias("z")).withColumn("back", unzigzag(F.col("z")))


@_register("varint_lengths", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_partkey * 97 AS BIGINT) AS v, CAST(greatest(1, ceil(length(trim(LEADING '0' FROM bin(CAST(l_orderkey * l_partkey * 97 AS BIGINT)))) / 7.0)) AS INTEGER) AS n_bytes FROM lineitem")
def varint_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_orderkey") * F.col("l_partkey") * 97).cast("bigint")
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), varint_length(v).cast("int").alias("n_bytes"))


_SIZE_SQL = _sql(
    *_CHAIN, "bytes AS (SELECT series_id, count(*) AS n_points, max(seg_id) + 1 AS n_segments, sum(CASE WHEN abs(q) < 64 OR q = -64 THEN 1 WHEN abs(q) < 8192 OR q = -8192 THEN 2 WHEN abs(q) < 1048576 OR q = -1048576 THEN 3 ELSE 4 END) AS b FROM coded GROUP BY series_id)",
    select="SELECT series_id, n_points, n_segments, CAST(28 + length('{\"sampling\":{\"dt\":1.0,\"t0\":\"0\"},\"unit\":\"step\"}') + 64 * n_segments + 16 + 12 * n_segments + b AS BIGINT) AS encoded_bytes, round(n_points * 8.0 / (28 + length('{\"sampling\":{\"dt\":1.0,\"t0\":\"0\"},\"unit\":\"step\"}') + 76 * n_segments + 16 + b), 6) AS ratio FROM bytes",
)


@_register("encoded_size_ratio", _SIZE_SQL)
def encoded_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = coding.coded(segment.segmented(segment.checked(_scaled_series(spark, sf_dir)), SUPPLIER), SUPPLIER)
    ids = df.where("idx = 0").select("series_id").withColumns({k: F.lit(v) for k, v in UNIT.items()})
    return sizes.encoded_size(df, ids).select("series_id", "n_points", "n_segments", F.col("encoded_bytes").cast("bigint").alias("encoded_bytes"), *_r("ratio"))


# ---- semantics -------------------------------------------------------------


def _tag_query(variant: str) -> None:
    @_register(f"segment_tags_{variant}", _sql(*_CHAIN, _tags(variant), select='SELECT series_id, seg_id, start_idx AS "start", end_idx AS "end", len, pred, patt, sal, round(energy, 6) AS energy, round(mean, 9) AS mean, round(slope, 6) AS slope, round(q_step, 6) AS q FROM tagged'))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = semantics.tags(_segments(spark, sf_dir), variant)
        return t.select("series_id", "seg_id", F.col("start_idx").alias("start"), F.col("end_idx").alias("end"), "len", "pred", "patt", "sal", *_r("energy", "slope"), F.round("mean", 9).alias("mean"), F.round("q_step", 6).alias("q"))


for _variant in ("cli", "core"):
    _tag_query(_variant)


@_register("motifs", _sql(*_CHAIN, _tags("cli"), select="SELECT series_id, CAST(motif_id AS BIGINT) AS motif_id, min(seg_id) AS seg_start, max(seg_id) AS seg_end, count(*) AS n_segs, patt AS pattern, CAST(sum(len) AS BIGINT) AS total_len, round(sum(energy), 6) AS total_energy FROM islands GROUP BY series_id, motif_id, patt"))
def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.motifs(semantics.tags(_segments(spark, sf_dir))).select("series_id", "motif_id", "seg_start", "seg_end", "n_segs", "pattern", "total_len", *_r("total_energy"))


@_register("motifs_core", _sql(*_CHAIN, _tags("core"), select="SELECT series_id, CAST(motif_id AS BIGINT) AS motif_id, min(seg_id) AS seg_start, max(seg_id) AS seg_end, count(*) AS n_segs, patt AS pattern, CAST(sum(len) AS BIGINT) AS total_len, round(sum(energy), 6) AS total_energy FROM islands GROUP BY series_id, motif_id, patt"))
def motifs_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.motifs(semantics.tags(_segments(spark, sf_dir), "core")).select("series_id", "motif_id", "seg_start", "seg_end", "n_segs", "pattern", "total_len", *_r("total_energy"))


_BREAKDOWN = "b AS (SELECT series_id, patt AS pattern, CAST(sum(len) AS BIGINT) AS points, count(*) AS n_segs, count(DISTINCT motif_id) AS n_motifs, min(seg_id) AS first_seg FROM islands GROUP BY series_id, patt)"


@_register("pattern_points", _sql(*_CHAIN, _tags("cli"), _BREAKDOWN, select="SELECT series_id, pattern, points FROM b"))
def pattern_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.tags(_segments(spark, sf_dir)).groupBy("series_id", F.col("patt").alias("pattern")).agg(F.sum("len").alias("points"))


@_register("profile_breakdown", _sql(*_CHAIN, _tags("cli"), _BREAKDOWN, select="SELECT series_id, pattern, points, round(points / sum(points) OVER (PARTITION BY series_id), 6) AS fraction, n_segs, n_motifs, CAST(row_number() OVER (PARTITION BY series_id ORDER BY points DESC, first_seg) AS INTEGER) AS rank FROM b"))
def profile_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.pattern_points(semantics.tags(_segments(spark, sf_dir))).select("series_id", "pattern", "points", *_r("fraction"), "n_segs", "n_motifs", "rank")


@_register("segment_summary", _sql(*_CHAIN, select="SELECT series_id, count(*) AS n_segments, min(len) AS len_min, max(len) AS len_max, round(avg(len), 6) AS len_avg, round(min(slope), 6) AS slope_min, round(max(slope), 6) AS slope_max, round(min(q_step), 6) AS q_min, round(max(q_step), 6) AS q_max FROM segments GROUP BY series_id"))
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.summary(_segments(spark, sf_dir)).select("series_id", "n_segments", "len_min", "len_max", *_r("len_avg", "slope_min", "slope_max", "q_min", "q_max"))


@_register("profiles", _sql(*_CHAIN, _tags("cli"), _profile(), select="SELECT * FROM profile"))
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir)


_EVENTS = """SELECT file, unnest(CASE WHEN len(e) = 0 THEN ['none'] ELSE e END) AS event_type FROM (SELECT file, list_filter([
  CASE WHEN frac_oscillation > 0.6 AND n_motifs_oscillation >= 1 THEN 'oscillation_dominated' END,
  CASE WHEN frac_trend > 0.6 AND n_motifs_trend = 1 THEN 'single_trend_regime' WHEN frac_trend > 0.3 AND frac_trend <= 0.6 AND n_motifs_trend >= 1 THEN 'mixed_trend_regime' END,
  CASE WHEN frac_trend > 0.2 AND frac_oscillation > 0.2 THEN 'trend_oscillation_mix' END,
  CASE WHEN frac_flat > 0.5 AND frac_trend > 0.1 AND frac_trend < 0.4 AND n_motifs_trend = 1 AND frac_oscillation < 0.1 AND frac_noisy < 0.1 THEN 'flat_with_trend_bump' END,
  CASE WHEN frac_noisy > 0.3 THEN 'noisy_segments_present' END, CASE WHEN energy_avg > 15.0 THEN 'high_energy' END], lambda x: x IS NOT NULL) AS e FROM profile)"""


@_register("semantic_events", _sql(*_CHAIN, _tags("cli"), _profile(), select=_EVENTS))
def semantic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.events(_profiles(spark, sf_dir))


_CLUSTERS = """SELECT *, CASE
  WHEN frac_trend >= 0.9 AND frac_flat <= 0.05 AND frac_oscillation <= 0.05 AND frac_noisy <= 0.2 AND energy_avg > 50 AND n_segments <= 3 THEN 'alarm_burst_regime'
  WHEN frac_trend >= 0.7 AND frac_oscillation + frac_noisy >= 0.1 AND energy_avg > 20 AND n_segments >= 4 THEN 'ramp_then_burst'
  WHEN frac_flat > 0.7 AND frac_oscillation + frac_noisy > 0.05 AND frac_oscillation + frac_noisy < 0.4 AND frac_trend < 0.2 AND n_motifs_oscillation + n_motifs_noisy = 1 AND n_segments <= 4 THEN 'flat_with_spike'
  WHEN frac_oscillation >= 0.6 THEN 'oscillation_dominated' WHEN frac_trend >= 0.6 THEN 'trend_dominated'
  WHEN frac_flat >= 0.7 AND frac_trend < 0.2 AND frac_oscillation < 0.2 THEN 'mostly_flat' WHEN frac_noisy >= 0.5 THEN 'noisy_dominated'
  WHEN frac_trend >= 0.2 AND frac_trend <= 0.7 AND frac_oscillation >= 0.2 AND frac_oscillation < 0.6 AND frac_flat < 0.3 AND n_motifs_oscillation >= 1 THEN 'multi_bump'
  WHEN frac_flat > 0.5 AND frac_trend > 0.1 AND frac_trend < 0.4 AND frac_oscillation < 0.1 AND frac_noisy < 0.1 THEN 'flat_with_trend_bump'
  WHEN frac_trend > 0.2 AND frac_oscillation > 0.2 THEN 'trend_oscillation_mix' WHEN energy_avg > 15 THEN 'high_energy_mixed' ELSE 'mixed_other' END AS "cluster" FROM profile"""


@_register("clusters", _sql(*_CHAIN, _tags("cli"), _profile(), select=_CLUSTERS))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.clusters(_profiles(spark, sf_dir))


# ---- alarms ----------------------------------------------------------------

_WEIGHTS = "w AS (SELECT type, n, 1.0 + 0.5 * (row_number() OVER (ORDER BY n, type) - 1) AS weight FROM (SELECT coalesce(nullif(event_type, ''), '_') AS type, count(*) AS n FROM events GROUP BY 1))"


@_register("alarm_type_weights", _sql(_WEIGHTS, select="SELECT type, n, CAST(weight AS DOUBLE) AS weight FROM w"))
def alarm_type_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.type_weights(tables.event_alarms(spark, sf_dir)).withColumn("weight", F.col("weight").cast("double"))


_BINS = """e AS (SELECT min(ts) AS first, max(ts) AS last FROM events),
grid AS (SELECT unnest(range(CAST(floor(date_diff('microsecond', first, last) / 1e6 / 3600) AS BIGINT) + 1)) AS bin FROM e),
sums AS (SELECT CAST(floor(date_diff('microsecond', first, ts) / 1e6 / 3600) AS BIGINT) AS bin, sum(coalesce(weight, 1.0) * value) AS v FROM events, e LEFT JOIN w ON w.type = coalesce(nullif(event_type, ''), '_') GROUP BY 1),
binned AS (SELECT grid.bin, coalesce(v, 0.0) AS value FROM grid LEFT JOIN sums USING (bin))""".replace("FROM events, e LEFT JOIN", "FROM events CROSS JOIN e LEFT JOIN")


@_register("alarm_intensity", _sql(_WEIGHTS, _BINS, select="SELECT bin, round(CAST(value AS DOUBLE), 6) AS value FROM binned"))
def alarm_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.intensity(tables.event_alarms(spark, sf_dir), 3600.0).select("bin", *_r("value"))


@_register("alarm_intensity_fractional", _sql(_WEIGHTS, _BINS.replace("/ 3600", "/ 5400.25"), select="SELECT bin, round(CAST(value AS DOUBLE), 6) AS value FROM binned"))
def alarm_intensity_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a width that is no whole number of seconds."""
    return alarms.intensity(tables.event_alarms(spark, sf_dir), 5400.25).select("bin", *_r("value"))


@_register("alarm_profile", _sql(_WEIGHTS, _BINS, "pts AS (SELECT 'alarms' AS series_id, bin AS idx, CAST(value AS DOUBLE) AS value FROM binned)", _seg(32), _FIT, _coded("linear"), _SEGMENTS, _tags("cli"), _profile(), select="SELECT * FROM profile"))
def alarm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = alarms.intensity(tables.event_alarms(spark, sf_dir), 3600.0)
    points = bins.select(F.lit("alarms").alias("series_id"), F.col("bin").alias("idx"), "value")
    seg = coding.segments(coding.coded(segment.segmented(points, SUPPLIER), SUPPLIER))
    return semantics.profiles(semantics.tags(seg), dt=UNIT["dt"], unit=UNIT["unit"])


# ---- binary form and text --------------------------------------------------


def _payloads(points: DataFrame, p: CodecParams) -> DataFrame:
    return blobs.encode(points, tables.meta(points, UNIT["dt"], UNIT["t0"], UNIT["unit"]), p)


@_register("blob_roundtrip", _sql(*_USER, _coded("linear"), select="SELECT series_id, idx, round(decoded, 6) AS value FROM coded"))
def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = _payloads(tables.user_series(spark, sf_dir), USER.but(residual_coding="varint"))
    return blobs.decode(payloads).select("series_id", "idx", *_r("value"))


@_register("blob_roundtrip_rw_raw", _sql(*_USER, _coded("rw"), select="SELECT series_id, idx, round(decoded, 6) AS value FROM coded"))
def blob_roundtrip_rw_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.decode(_payloads(tables.user_series(spark, sf_dir), USER.but(predictor="rw"))).select("series_id", "idx", *_r("value"))


@_register("blob_metadata", _SIZE_SQL.replace("SELECT series_id, n_points, n_segments,", "SELECT series_id, n_points, n_segments, 1 AS coding_type, 'step' AS unit,").replace(" AS encoded_bytes", " AS n_bytes").split(", round(n_points")[0] + " FROM bytes")
def blob_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = _payloads(_scaled_series(spark, sf_dir), SUPPLIER.but(residual_coding="varint"))
    return blobs.metadata(payloads).select("series_id", "n_points", "n_segments", "coding_type", "unit", "n_bytes")


@_register("blob_segments", _sql(*_CHAIN, select="SELECT series_id, seg_id, start_idx, end_idx, len, round(mean, 9) AS mean, round(slope, 6) AS slope, round(q_step, 6) AS q FROM segments"))
def blob_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = blobs.segments(_payloads(_scaled_series(spark, sf_dir), SUPPLIER))
    return seg.select("series_id", "seg_id", "start_idx", "end_idx", "len", F.round("mean", 9).alias("mean"), *_r("slope"), F.round("q_step", 6).alias("q"))


@_register("text_numbers", "SELECT c_custkey, c_acctbal AS plain, CAST(NULL AS DOUBLE) AS named, round(c_acctbal * 1000, 6) AS scaled FROM customer")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as texts, parsed as a line's first field: plain, as a name that is no number, and with an exponent."""
    t = F.col("c_acctbal").cast("double").cast("string")
    first = lambda line: text.number(F.split(line, ",")[0])
    rows = tables.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", first(F.concat(F.lit("  "), t, F.lit(" ,x"))).alias("plain"), first(F.concat(F.lit("value"), t)).alias("named"), F.round(first(F.concat(t, F.lit("e3"))), 6).alias("scaled"))


@_register("alarm_extent", "SELECT epoch_us(min(ts)) AS first_us, CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 1e6 / 3600) AS BIGINT) + 1 AS n_bins FROM events")
def alarm_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alarms.extent(tables.event_alarms(spark, sf_dir), 3600.0).select(F.col("first").alias("first_us"), "n_bins")


@_register("type_profiles", _sql("pts AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events)", _seg(32), _FIT, _coded("linear"), _SEGMENTS, _tags("cli"), _profile(), select="SELECT * FROM profile"))
def type_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long series: one per event type."""
    seg = coding.segments(coding.coded(segment.segmented(segment.checked(tables.type_series(spark, sf_dir)), SUPPLIER), SUPPLIER))
    return semantics.profiles(semantics.tags(seg), dt=UNIT["dt"], unit=UNIT["unit"])


# ---- text and binary files, written first and scanned back -----------------


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; on a local master, where none is named, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="seriate-files-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = "file://" + base
    # Shared by contract, so its store is named: a plain path would be each executor's own.
    return f"{blobs.qualified(spark, base)}/files-{uuid.uuid4().hex}"


@_register("scan_series_text", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_acctbal::DOUBLE AS value FROM customer")
def scan_series_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as a text file with a comment, a header, blank lines and further fields, read as a series (one file is one series)."""
    rows = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("at"), F.concat(F.col("c_acctbal").cast("double").cast("string"), F.lit(",more")).alias("line"))
    odd = spark.createDataFrame([(-3, "# value"), (-2, "value"), (-1, "")], "at bigint, line string")
    path = _folder(spark)
    odd.unionByName(rows).orderBy("at").coalesce(1).select("line").write.text(path)
    return text.series_from_text(spark, path)[0].select("idx", "value")


@_register("scan_alarms_csv", "SELECT epoch_us(ts) AS us, event_type AS type, round(value, 6) AS severity FROM events")
def scan_alarms_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as CSV with a time zone and a row without a time, read as an alarm log."""
    path, e = _folder(spark), tables.event_alarms(spark, sf_dir)
    rows = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "type", F.col("severity").cast("string").alias("severity"))
    rows.unionByName(spark.createDataFrame([(None, "x", "1")], rows.schema)).write.csv(path, header=True)
    return text.alarms_from_csv(spark, path).select(alarms.micros(F.col("ts")).alias("us"), "type", F.round("severity", 6).alias("severity"))


@_register("scan_profiles_events", _sql(*_CHAIN, _tags("cli"), _profile(), select=_EVENTS))
def scan_profiles_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as a CSV file, read back for their events."""
    path = _folder(spark)
    profiles(spark, sf_dir).write.csv(path, header=True)
    return semantics.events(text.profiles_from_csv(spark, path))


@_register("scan_profiles_clusters", _sql(*_CHAIN, _tags("cli"), _profile(), select=_CLUSTERS))
def scan_profiles_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    schema = profiles(spark, sf_dir).schema
    profiles(spark, sf_dir).write.csv(path, header=True)
    got = semantics.clusters(text.profiles_from_csv(spark, path))
    return got.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), "cluster")


@_register("scan_tags_csv", _sql(*_CHAIN, _tags("cli"), select='SELECT CAST(seg_id AS INTEGER) AS seg_id, CAST(start_idx AS INTEGER) AS "start", CAST(end_idx AS INTEGER) AS "end", CAST(len AS INTEGER) AS len, pred, patt, CAST(sal AS INTEGER) AS sal, round(energy, 6) AS energy FROM tagged'))
def scan_tags_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    t = semantics.tags(_segments(spark, sf_dir))
    t.select("seg_id", F.col("start_idx").alias("start"), F.col("end_idx").alias("end"), "len", "pred", "patt", "sal", "energy").write.csv(path, header=True)
    return text.tags_from_csv(spark, path).select("seg_id", "start", "end", "len", "pred", "patt", "sal", *_r("energy"))


@_register("scan_values_csv", "SELECT c_acctbal::DOUBLE AS value FROM customer")
def scan_values_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    tables.table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("value")).write.csv(path, header=True)
    return text.values_from_csv(spark, path)


@_register("scan_encoded_files", _sql(*_USER, _coded("linear"), select="SELECT series_id, idx, round(decoded, 6) AS value FROM coded"))
def scan_encoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written as a file each, found in their folder, read and decoded."""
    path = _folder(spark)
    blobs.write(_payloads(tables.user_series(spark, sf_dir), USER.but(residual_coding="varint")), path)
    found = blobs.read(spark, path)
    return blobs.decode(found).select(F.regexp_replace("series_id", r"\.[^.]*$", "").alias("series_id"), "idx", *_r("value"))


@_register("decode_gaps", "SELECT i.idx, CASE WHEN i.idx = 2 THEN 10.0 WHEN i.idx BETWEEN 1 AND 3 THEN 5.0 ELSE 0.0 END::DOUBLE AS value FROM range(6) AS i(idx)")
def decode_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload whose segments leave gaps and overlap: gaps are 0, the later segment counts."""
    return blobs.decode(spark.createDataFrame([("s", bytearray(blobs.overlapping()))], "series_id string, payload binary")).select("idx", "value")


# ---- generators ------------------------------------------------------------


def _generator(kind: str, sql: str | None) -> None:
    @_register(f"gen_{kind}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return generate.series(spark, kind).select("series_id", "idx", *_r("value"))


_generator("trend", "SELECT 'trend' AS series_id, range AS idx, round(0.05::DOUBLE * range, 6) AS value FROM range(300)")
_generator("flat_spike", "SELECT 'flat_spike' AS series_id, range AS idx, CASE WHEN range >= 135 AND range < 165 THEN 3.0 ELSE 1.5 END::DOUBLE AS value FROM range(300)")
#: What generate.uniform draws for row {row}.
_DRAW = "(('0x' || substr(md5('{seed}:' || {row}), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE)"


def _noise_sql(size: float, seed: int = 42) -> str:
    return f"({_DRAW.format(seed=seed, row='range')} * 2 - 1) * {size}::DOUBLE"


_generator("sine_noise", f"SELECT 'sine_noise' AS series_id, range AS idx, round(sin(2 * pi() * range / 60.0) + 0.01::DOUBLE * range + {_noise_sql(0.1)}, 6) AS value FROM range(300)")
_generator("ramp_then_burst", f"SELECT 'ramp_then_burst' AS series_id, range AS idx, round(0.03::DOUBLE * range + CASE WHEN range < 150 THEN {_noise_sql(0.1)} ELSE 6 * sin(2 * pi() * (range - 150) / 10.0) + {_noise_sql(0.2)} END, 6) AS value FROM range(300)")
_generator("multi_bump", f"SELECT 'multi_bump' AS series_id, range AS idx, round(CASE WHEN range BETWEEN 53 AND 66 OR range BETWEEN 143 AND 156 OR range BETWEEN 233 AND 246 THEN 3.0 ELSE 1.0 END::DOUBLE + {_noise_sql(0.1)}, 6) AS value FROM range(300)")


def _pick_sql(values: str, n: int, seed: int) -> str:
    return f"([{values}])[CAST(floor({_DRAW.format(seed=seed, row='range')} * {n}) AS BIGINT) + 1]"


_ALARM_LOG = f"""SELECT TIMESTAMP '2025-01-01 00:00:00' + to_seconds(s) AS ts, type, severity::DOUBLE AS severity FROM (
  SELECT range * 30 AS s, {_pick_sql("'A'", 1, 52)} AS type, {_pick_sql('1', 1, 62)} AS severity FROM range(40) WHERE {_DRAW.format(seed=42, row='range')} < 0.2
  UNION ALL SELECT 1200 + range * 20, {_pick_sql("'A', 'B'", 2, 53)}, {_pick_sql('1, 2, 3', 3, 63)} FROM range(60) WHERE {_DRAW.format(seed=43, row='range')} < 0.5
  UNION ALL SELECT 2400 + range // 5 * 120 + range % 5 * 5, 'C', {_pick_sql('2, 3', 2, 72)} FROM range(50)
)"""


@_register("gen_alarms", _ALARM_LOG)
def gen_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.alarms(spark)
