"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits.  For each bit a regularised
least-squares classifier on hashed character 1- to 3-gram profiles predicts
whether a text's language has +1 there.  Decoding sums, over the bits, a
squared hinge loss weighted by that bit's reliability on the sample, and takes
the codeword of least loss; a small lead over the second flags ambiguity.

Defined results: a null text or one without a letter is ``und`` with score 0;
texts of any length are read whole; ties go to the language first in code
point order; repeated rows are judged each; rows without ``lang`` teach
nothing; without any learnable row everything is ``und``; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import textkit
from .common import mapped, split_remainder

UND = "und"


@dataclass(frozen=True)
class Params:
    #: Rows to learn from for each language, on average; documented bound of the sample.
    per_lang: int = 400
    #: Rows to learn from in all, on average; with many languages each gets its part, but ``least`` rows where it has them.
    most: int = 6_000
    least: int = 20
    bits: int = 12
    orders: tuple[int, ...] = (1, 2, 3)
    ridge: float = 0.02
    #: Lead of the best share over the second under which a text is ambiguous.
    ambiguous: float = 0.2


@dataclass(frozen=True)
class Model:
    bits: int
    orders: tuple[int, ...]
    langs: list[str]
    codes: np.ndarray  # languages x code bits, +1 or -1
    weights: np.ndarray  # buckets x code bits
    bias: np.ndarray
    trust: np.ndarray  # per code bit
    ambiguous: float


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All distinct splits for up to 5 languages; for more, the best separated of some random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        k = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(k)), *(np.where(k >> i & 1, -1.0, 1.0) for i in range(n - 1))]
        return np.stack(rows)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(100):
        c = np.where(rng.random((n, max(15, int(np.ceil(10 * np.log2(n)))))) < 0.5, -1.0, 1.0)
        c = c[:, np.abs(c.sum(0)) < n]
        apart = (c.shape[1] - c @ c.T) / 2
        np.fill_diagonal(apart, np.inf)
        if apart.min() > most:
            best, most = c, apart.min()
    return best


def profiles(texts: list[str], bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Unit-length rows of damped n-gram counts, whole texts, in pieces."""
    size = 1 << bits
    out = np.zeros((len(texts), size), np.float32)
    for i, j in textkit.text_groups(texts):
        step = textkit.GROUP
        for at in range(0, max(map(len, texts[i:j])) or 1, step):
            c, a, b = textkit.code_points([t[at : at + step + max(orders) - 1] for t in texts[i:j]])
            for x, ok in textkit.ngram_buckets(c, a, b, orders, bits):
                for row in range(i, j):
                    lo, hi = a[row - i], min(b[row - i], len(x), a[row - i] + step)  # beyond it the next piece counts
                    if hi > lo:
                        got = x[lo:hi][ok[lo:hi]]
                        out[row] += np.bincount(got, minlength=size) if len(got) * 8 > size else _sparse(got, size)
    out = np.log1p(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _sparse(got: np.ndarray, size: int) -> np.ndarray:
    row = np.zeros(size, np.float32)
    np.add.at(row, got, 1)
    return row


def fit(docs: DataFrame, p: Params = Params(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Learn from a bounded sample of rows with a language whose split remainder is not 0."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & (split_remainder(F.col("k")) != 0))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return None
    each = min(p.per_lang, max(p.least, p.most // len(counts)))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sorted(counts.items())], "l string, rate double")
    draw = F.xxhash64(F.lit(11), "k").bitwiseAND(0xFFFFF) / F.lit(float(1 << 20))
    # rates has a row per language.
    sample = rows.join(F.broadcast(rates), "l").where(draw < F.col("rate")).select("k", "t", "l")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = profiles(b.column("t").to_pylist(), p.bits, p.orders)
            yield pa.RecordBatch.from_pydict({"k": b.column("k"), "l": b.column("l"), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})

    got = mapped(sample, features, StructType([sample.schema["k"], sample.schema["l"], StructField("x", BinaryType())])).collect()
    got.sort(key=lambda r: (str(r["k"]), r["l"], r["x"]))
    langs = sorted({r["l"] for r in got})
    if not langs:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in got])
    codes = codewords(len(langs))
    y = codes[[langs.index(r["l"]) for r in got]]
    mean, centre = y.mean(0), x.mean(0)
    z = (x - centre).astype(np.float64)
    gram = z @ z.T
    gram[np.diag_indices_from(gram)] += p.ridge * np.trace(gram) / len(z) + 1e-9
    alpha = np.linalg.solve(gram, y - mean)
    w = z.T @ alpha
    bias = mean - centre @ w
    # Left-one-out predictions of the kernel form say how far each bit can be trusted.
    inv = np.linalg.inv(gram)
    left_out = y - alpha / np.maximum(np.diag(inv), 1e-12)[:, None]
    right = (np.sign(left_out) == y).mean(0)
    return Model(p.bits, p.orders, langs, codes, w.astype(np.float32), bias, np.clip(2 * right - 1, 0.05, 1), p.ambiguous)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share among all, and whether the lead is too small."""
    loss = np.stack([(model.trust * np.maximum(0, 1 - margins * c) ** 2).sum(1) for c in model.codes], 1) / model.trust.sum()
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(share, 1)
    lead = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(len(share))
    return best, share[np.arange(len(best)), best], lead < model.ambiguous


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``ambiguous`` of every row."""
    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            pred, score, vague = np.array([UND] * len(texts), object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            judged = np.array([bool(model and letter.search(t)) for t in texts], bool)
            for i in range(0, len(texts), 128):
                at = i + np.flatnonzero(judged[i : i + 128])
                if len(at):
                    x = profiles([texts[k] for k in at], model.bits, model.orders)
                    best, score[at], vague[at] = decode(model, x @ model.weights + model.bias)
                    pred[at] = [model.langs[k] for k in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(vague)], names=["k", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[key].dataType.simpleString()
    out = mapped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run, f"k {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("k").alias(key), "lang_pred", "score", "ambiguous")


def op7(docs: DataFrame, p: Params = Params()) -> DataFrame:
    out = predict(docs, fit(docs, p))
    return out.select("doc_id", (split_remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
