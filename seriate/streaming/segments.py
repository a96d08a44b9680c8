"""Adaptive segmentation of unbounded series: segments are emitted as they close.

The state of a series is the constant-size state of the batch fold, so it is
kept in the stream's state store, and a series may span any number of batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series_id string, start_idx bigint, end_idx bigint, len bigint, mean double"
STATE = "start bigint, n bigint, closed boolean, x0 double, prev double, sy double, syy double, sty double, sdd double"


def error(model: str, n: int, prev: float, sy: float, syy: float, sty: float, sdd: float) -> float:
    """Mean squared error of the model over a segment, from its running sums."""
    sse = sdd
    if model != "rw":
        sse = syy - sy * sy / n
        if model == "linear":
            sse = sse - (sty - (n - 1) / 2 * sy) ** 2 / (n * (n * n - 1) / 12) if n > 1 else 0.0
    return max(sse, 0.0) / n


def step(state: tuple | None, idx: int, x: float, model: str, least: int, most: int, threshold: float) -> tuple[tuple, tuple | None]:
    """The state after one more point, and the segment (start, end, n, mean) that ended before it, if one did."""
    if state:
        start, n, closed, x0, prev, sy, syy, sty, sdd = state
        y, m = x - x0, n + 1
        grown = (sy + y, syy + y * y, sty + n * y, sdd + (x - prev) ** 2)
        over = m >= least and error(model, m, prev, *grown) > threshold
        if not closed and (m <= least or not over):
            return (start, m, over or m >= max(least, most), x0, x, *grown), None
    ended = (state[0], state[0] + state[1] - 1, state[1], state[3] + state[5] / state[1]) if state else None
    return (idx, 1, least == 1 and (threshold < 0 or most == 1), x, x, 0.0, 0.0, 0.0, 0.0), ended


def adaptive(points: DataFrame, model: str = "linear", least: int = 32, most: int = 128, threshold: float = 0.5, idle: str | None = None) -> DataFrame:
    """Closed segments of a stream of (series_id, idx, value).

    Points of a series must arrive in order, in any number per batch.  With
    ``idle`` (as "10 minutes") the open segment of a series is emitted once it
    got no point for that long.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], at[0], at[0] + at[1] - 1, at[1], at[3] + at[5] / at[1])], columns=["series_id", "start_idx", "end_idx", "len", "mean"])
            return
        out = []
        rows = pd.concat(list(batches)).sort_values("idx", kind="stable")
        for idx, x in zip(rows["idx"].tolist(), rows["value"].tolist(), strict=True):
            at, ended = step(at, idx, x, model, least, most, threshold)
            if ended:
                out.append((key[0], *ended))
        if at:
            state.update(at)
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["series_id", "start_idx", "end_idx", "len", "mean"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return points.select("series_id", "idx", "value").groupBy("series_id").applyInPandasWithState(run, OUT, STATE, "append", timeout)
