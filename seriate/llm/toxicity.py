"""Toxicity scores from a linear character n-gram model with naive Bayes scaling.

Binary features (hashed 3- to 5-grams of lower-cased code points) are scaled
by their naive Bayes log-count ratio; a regularised logistic regression is
fitted on the scaled features.

Defined results: a null or empty text has no features and scores the model's
intercept; texts of any length are read whole, in pieces; equal texts score
alike; repeated rows are scored each; several labels of one id count as toxic
if any is, and the first in order of several texts of one id teaches; ids may be of any type; without both classes among the learnable labels every score is the
smoothed share of toxic rows; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import textkit
from .common import cut, drop, mapped, split_remainder


@dataclass(frozen=True)
class Params:
    #: Labelled rows to learn from at most, those with the smallest hashed ids.
    sample: int = 6_000
    #: Features kept: those whose log-count ratios differ most clearly from 0.
    features: int = 1 << 12
    bits: int = 18
    orders: tuple[int, ...] = (3, 4, 5)
    least_df: int = 3
    l2: float = 1.0
    steps: int = 150


@dataclass(frozen=True)
class Model:
    bits: int
    orders: tuple[int, ...]
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def present(texts: list[str], bits: int, orders: tuple[int, ...], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (row, bucket) pairs of wanted buckets, for runs of rows; a long text's pieces are united."""
    for i, j in textkit.text_groups(texts):
        if j == i + 1 and len(texts[i]) > textkit.GROUP:
            step, lap = textkit.GROUP, max(orders) - 1
            seen = np.empty(0, np.int64)
            for at in range(0, len(texts[i]), step):
                c, a, b = textkit.code_points([texts[i][at : at + step + lap]])
                got = [x[ok & wanted[x]] for x, ok in textkit.ngram_buckets(c, a, b, orders, bits)]
                seen = np.unique(np.concatenate([seen, *got]))
            yield np.full(len(seen), i), seen
            continue
        c, a, b = textkit.code_points(texts[i:j])
        keys = []
        for x, ok in textkit.ngram_buckets(c, a, b, orders, bits):
            at = np.flatnonzero(ok & wanted[x])
            keys.append((np.searchsorted(b, at) << bits) | x[at])
        pairs = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        yield (pairs >> bits) + i, pairs & ((1 << bits) - 1)


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from a bounded sample of the labelled rows whose split remainder is not 0."""
    lab = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("k").isNotNull() & (split_remainder(F.col("k")) != 0))
        .groupBy("k").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(p.sample)
    )
    # The label side has at most p.sample rows of 12 bytes.
    sample = cut(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(lab), "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")), "toxic-sample", 1)
    size, every = 1 << p.bits, np.ones(1 << p.bits, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((2, size), np.int64)
        for b in batches:
            y = (b.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            for rows, buckets in present(_strings(b.column("t")), p.bits, p.orders, every):
                for k in (0, 1):
                    hits[k] += np.bincount(buckets[y[rows] == k], minlength=size)
        at = np.flatnonzero(hits.sum(0))
        yield pa.RecordBatch.from_pydict({"b": at, "neg": hits[0][at], "pos": hits[1][at]})

    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        drop(sample)
        share = (pos + 0.5) / (pos + neg + 1)
        return Model(p.bits, p.orders, np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    has, lacks = F.col("pos") + 0.5, F.col("neg") + 0.5
    ratio = F.log(has / lacks) - F.log(F.lit((pos + 1.0) / (neg + 1.0)))
    best = (
        mapped(sample.select("t", "y").repartition(8), count, "b long, neg long, pos long")
        .groupBy("b").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .where(F.col("neg") + F.col("pos") >= p.least_df)
        .select("b", ratio.alias("r"), (F.abs(ratio) / F.sqrt(1 / has + 1 / lacks)).alias("z"))
        .orderBy(F.desc("z"), "b").limit(p.features).collect()
    )
    best.sort(key=lambda r: r["b"])
    buckets, r = np.array([x["b"] for x in best], np.int64), np.array([x["r"] for x in best])
    wanted = np.zeros(size, bool)
    wanted[buckets] = True

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _strings(b.column("t"))
            found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
            for rows, got in present(texts, p.bits, p.orders, wanted):
                cuts = np.flatnonzero(np.diff(rows)) + 1
                for at, part in zip(np.append(0, cuts), np.split(got, cuts), strict=True):
                    if len(part):
                        found[rows[at]] = part.astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "y": b.column("y"), "f": pa.array([x.tobytes() for x in found], pa.binary())})

    # p.sample rows of at most 4 bytes a feature.
    got = sorted(mapped(sample, features, StructType([sample.schema["k"], sample.schema["y"], StructField("f", BinaryType())])).collect(), key=lambda x: x["k"])
    drop(sample)
    lists = [np.searchsorted(buckets, np.frombuffer(x["f"], np.uint32)) for x in got]
    w, b = _logistic(lists, np.array([float(x["y"] > 0) for x in got]), r, p)
    return Model(p.bits, p.orders, buckets, w * r, b)


def _logistic(lists: list[np.ndarray], y: np.ndarray, r: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Regularised logistic regression on features scaled by ``r``, by L-BFGS."""
    n, k, sign = len(lists), len(r), np.where(y > 0, 1.0, -1.0)
    counts, cols = np.array([len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)])
    bounds = np.concatenate([[0], np.cumsum(counts)])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        sums = np.concatenate([[0.0], np.cumsum((r * x[:k])[cols])])
        m = sign * (sums[bounds[1:]] - sums[bounds[:-1]] + x[k])
        g = -sign / (1 + np.exp(np.clip(m, -500, 500)))
        grad = np.append(r * np.bincount(cols, np.repeat(g, counts), k) + p.l2 * x[:k], g.sum())
        return float(np.logaddexp(0, -m).sum() + 0.5 * p.l2 * x[:k] @ x[:k]), grad

    x = np.append(np.zeros(k), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(p.steps):
        d, marks = g.copy(), []
        for s, t in reversed(past):
            marks.append((s @ d) / (s @ t))
            d -= marks[-1] * t
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, t), m in zip(past, reversed(marks), strict=True):
            d += s * (m - (t @ d) / (s @ t))
        step, slope = 1.0, float(g @ d)
        while (new := loss(x - step * d))[0] > f - 1e-4 * step * slope and step > 1e-8:
            step /= 2
        s, t = -step * d, new[1] - g
        x, done = x + s, f - new[0] <= 1e-7 * max(1.0, f)
        f, g = new
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t)]
        if done:
            break
    return x[:k], float(x[k])


def scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    """A function from a text column to its scores."""
    size = 1 << model.bits
    wanted, weights = np.zeros(size, bool), np.zeros(size)
    wanted[model.buckets], weights[model.buckets] = True, model.weights

    def run(column: pa.Array) -> np.ndarray:
        texts = _strings(column)
        z = np.full(len(texts), model.intercept)
        for rows, got in present(texts, model.bits, model.orders, wanted):
            z += np.bincount(rows, weights[got], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return run


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``score`` of every row."""
    of = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1)))], names=["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, score double").select(F.col("k").alias(key), "score")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows scored under ``threshold``, as they are."""
    of, at = scorer(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(of(b.column(at)) < threshold))

    return mapped(docs, run, docs.schema)


def op1(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    scored = score(docs, fit(docs, labels, p))
    return scored.select("doc_id", (split_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
