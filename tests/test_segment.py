import math
import random
from collections import defaultdict

import pytest

from seriate.operators import coding, segment
from seriate.params import CodecParams
from seriate.streaming.segments import step


def points(spark, series):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "series_id string, idx bigint, value double")


def spread(xs, model):
    """Mean squared error of a model over a window, from its definition."""
    n, mean = len(xs), math.fsum(xs) / len(xs)
    if model == "mean":
        return math.fsum((x - mean) ** 2 for x in xs) / n
    if model == "rw":
        return math.fsum((b - a) ** 2 for a, b in zip(xs, xs[1:])) / n
    mid = (n - 1) / 2
    den = math.fsum((t - mid) ** 2 for t in range(n))
    slope = math.fsum((t - mid) * (x - mean) for t, x in enumerate(xs)) / den if den else 0.0
    return math.fsum((x - mean - slope * (t - mid)) ** 2 for t, x in enumerate(xs)) / n


def greedy(xs, model, least, most, limit):
    """Windows grown one point at a time, each judged anew."""
    out, at = [], 0
    while at < len(xs):
        end = min(at + least, len(xs))
        if spread(xs[at:end], model) <= limit:
            while end < len(xs) and end - at < most and spread(xs[at : end + 1], model) <= limit:
                end += 1
        out.append((at, end - 1))
        at = end
    return out


def noisy(seed, n, offset=0.0):
    r = random.Random(seed)
    out, x = [], offset
    for i in range(n):
        x += r.gauss(0, 0.3) + (2 if r.random() < 0.03 else 0)
        out.append(x + math.sin(i / 5))
    return out


@pytest.mark.parametrize("model", ["mean", "linear", "rw"])
@pytest.mark.parametrize("least,most", [(1, 1), (1, 7), (5, 5), (8, 40)])
def test_fold_equals_greedy(spark, model, least, most):
    data = {f"s{k}": noisy(k, 37 * k + 1, 100.0 * k) for k in range(6)}
    rows = segment.adaptive(points(spark, data), model, least, most, 0.4).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r.series_id].setdefault(r.seg_id, []).append(r)
    for k, xs in data.items():
        want = greedy(xs, model, least, most, 0.4)
        segs = [sorted(got[k][i], key=lambda r: r.idx) for i in sorted(got[k])]
        assert [(s[0].idx, s[-1].idx) for s in segs] == want
        assert all(r.start_idx == s[0].idx and r.t == r.idx - r.start_idx and r.value == xs[r.idx] for s in segs for r in s)


@pytest.mark.parametrize("model", ["mean", "linear", "rw"])
def test_streaming_step_equals_greedy(model):
    xs, state, ended = noisy(3, 400), None, []
    for i, x in enumerate(xs):
        state, e = step(state, i, x, model, 8, 40, 0.4)
        ended += [e] if e else []
    ended.append((state[0], state[0] + state[1] - 1))
    assert [(e[0], e[1]) for e in ended] == greedy(xs, model, 8, 40, 0.4)


@pytest.mark.parametrize("predictor", ["mean", "linear", "rw", "auto"])
@pytest.mark.parametrize("mode", ["fixed", "adaptive"])
def test_segments_tile_and_errors_are_bounded(spark, predictor, mode):
    data = {"a": noisy(1, 131), "one": [4.0], "two": [1.0, 5.0], "flat": [3.0] * 50, "big": [1e15] * 50}
    p = CodecParams(segment_mode=mode, segment_length=16, min_segment_length=8, max_segment_length=20, mse_threshold=0.3, predictor=predictor)
    df = coding.reconstructed(coding.coded(segment.segmented(segment.checked(points(spark, data)), p), p)).cache()
    for k, xs in data.items():
        rows = df.where(f"series_id = '{k}'").orderBy("idx").collect()
        assert [r.idx for r in rows] == list(range(len(xs)))
        if predictor in ("mean", "linear"):
            assert all(abs(r.value - r.decoded) <= r.q_step / 2 + 1e-9 * max(1, abs(r.value)) for r in rows)
        assert all(r.q_step >= 1e-6 for r in rows)
    segs = coding.segments(df).collect()
    assert sum(s.len for s in segs) == sum(map(len, data.values()))
    assert all(s.slope == 0.0 and s.mean == 4.0 for s in segs if s.series_id == "one")
    if mode == "adaptive":
        last = {s.series_id: max(x.end_idx for x in segs if x.series_id == s.series_id) for s in segs}
        assert all(s.len <= 20 and (s.len >= 8 or s.end_idx == last[s.series_id]) for s in segs)


def test_random_walk_is_open_loop_on_encode_and_closed_on_decode(spark):
    xs = [0.0, 1.0, 3.0, 2.0, 7.0]
    p = CodecParams(segment_length=5, predictor="rw")
    rows = coding.reconstructed(coding.coded(segment.segmented(points(spark, {"s": xs}), p), p)).orderBy("idx").collect()
    res = [0.0, 1.0, 2.0, -1.0, 5.0]
    assert [r.residual for r in rows] == res
    q = max(0.5 * math.sqrt(sum((x - 1.4) ** 2 for x in res) / 5), 1e-6)
    ints = [round(x / q) for x in res]
    assert [r.q for r in rows] == ints
    acc, want = xs[0], []
    for k in ints:
        acc += k * q
        want.append(acc)
    assert [r.decoded for r in rows] == pytest.approx(want)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_not_finite_fail(spark, bad):
    with pytest.raises(Exception, match="non-finite value in series s"):
        segment.checked(points(spark, {"s": [1.0, bad]})).collect()


@pytest.mark.parametrize("change", [{"segment_mode": "x"}, {"predictor": "x"}, {"residual_coding": "x"}, {"segment_length": 0}, {"segment_mode": "adaptive", "min_segment_length": 0}, {"segment_mode": "adaptive", "min_segment_length": 9, "max_segment_length": 8}])
def test_parameters_are_checked_first(change):
    with pytest.raises(ValueError):
        CodecParams(**change)


def test_one_shuffle_by_series_is_enough(spark):
    p = CodecParams(segment_mode="adaptive", predictor="auto")
    df = coding.segments(coding.coded(segment.segmented(points(spark, {"a": [1.0] * 200}), p), p))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_level_segment_of_whole_values_has_no_slope_and_ties_with_its_mean(spark):
    xs = [11, 27, 46, 29, 41, 42, 21, 9, 4, 11, 5, 35, 49, 26, 19, 45, 35, 16, 37, 47, 16, 3, 37, 50, 7, 43, 29, 20, 22, 7, 43, 20]
    assert sum((2 * t - 31) * x for t, x in enumerate(xs)) == 0
    p = CodecParams(segment_length=32, predictor="auto")
    rows = coding.coded(segment.segmented(points(spark, {"s": xs}), p), p).collect()
    assert {(r.slope, r.predictor_type) for r in rows} == {(0.0, 0)} and rows[0].mse0 == rows[0].mse1
