"""Removal of long passages that repeat across documents, with phrase automata.

A window is ``window`` consecutive words.  A word goes if a window over it has
a word sequence that also starts in a document with a smaller id.

1. Every document's phrases (``phrase`` words, fewer than a window) are
   winnowed: each window owns its phrase of least hash, so equal windows own
   equal phrases, and only owned phrases, a tenth of all, are shuffled.
   Documents with the same words are one text, held by its smallest id.
2. Phrases that occur in two texts or more are confirmed as recurring.  The
   first text that holds it gives a phrase's pattern, its first ``anchor`` words with
   two symbols a word.  Patterns are dealt to shards by their holders, so that
   the phrases of a passage stay together.
3. An Aho-Corasick automaton is compiled for each shard, and each text is streamed
   through those of the shards that own a phrase of it: in others none of
   its windows can be located.  Texts meet ``together`` shards at once; there are so many
   shards that this is about ``part`` bytes of texts, and more are cut into parts.
   An automaton's hit locates a phrase if all of its words are there.
4. Windows whose owned phrase was located are confirmed: their 128-bit hashes
   are aggregated to the smallest id, before the shuffle as far as possible,
   so that a passage which very many documents share stays one row a task.
5. Windows with a smaller id elsewhere are dealt back to their documents, and
   their words are taken out.

The work of step 3 is texts times the shards that each meets, which its passages
bound, however many shards there are.

Defined results: null texts have no words; texts under a window, empty texts
and null ids lose nothing, and a null id takes nothing from others; texts are
read whole; ids may be of any type that has an order; rows that repeat an id and its text get the same result, and the
texts of one id never take words from each other; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructField, StructType

from . import textkit
from .common import cut, drop, mapped, with_bounded_broadcast


@dataclass(frozen=True)
class Params:
    window: int = 50
    phrase: int = 32
    anchor: int = 4
    #: Phrases of a shard at most, and shards that a text meets at once: up to some 60 MB of automaton each.
    shard: int = 1 << 17
    together: int = 3
    #: Bytes of texts, with recurring phrases, for which automata are compiled.
    part: int = 8 << 20


#: Texts whose windows are gathered at once.
BATCH_ROWS = 1024


def least_of(phrases: np.ndarray, p: Params) -> np.ndarray:
    """For each window its phrase of least hash, by minima over spans that double."""
    per, span = p.window - p.phrase + 1, 1
    if len(phrases) < per:
        return np.empty(0, np.uint64)
    low = phrases
    while 2 * span <= per:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return np.minimum(low[: len(low) - (per - span)], low[per - span :])


def located(phrases: np.ndarray, here: np.ndarray, p: Params) -> np.ndarray:
    """Positions of the windows whose owned phrase was found: their least phrase is the least of those found."""
    if not here.any():
        return np.empty(0, np.int64)
    none = np.uint64(np.iinfo(np.uint64).max)
    least = least_of(np.where(here, phrases, none), p)
    return np.flatnonzero((least == least_of(phrases, p)) & (least != none))


def hashed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes, word starts, word ends, word hashes) of each row."""
    for i, j in textkit.groups(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = textkit.word_spans(part, offsets[i : j + 1] - offsets[i])
        h = textkit.hash_spans(part, starts, ends)
        for row in range(i, j):
            a, b, base = bounds[row - i], bounds[row - i + 1], offsets[row] - offsets[i]
            yield row, part[base : offsets[row + 1] - offsets[i]].tobytes(), starts[a:b] - base, ends[a:b] - base, h[a:b]


def symbols(hashes: np.ndarray) -> str:
    """Two characters a word, of 6 bits of its hash each, the second from another range.

    An automaton's node searches its children one by one, so the alphabet is small.
    """
    c = (hashes >> np.uint64(52)).astype(np.uint16)
    return np.stack([c >> 6, (c & 63) | 64], 1).astype(np.uint8).tobytes().decode("ascii")


Machine = tuple[np.ndarray, ahocorasick.Automaton]


def compiled(phrases: np.ndarray, patterns: list[str]) -> Machine:
    """An automaton of a shard's patterns, and the phrases that begin with them; of equal patterns, a run of phrases."""
    order = sorted(range(len(patterns)), key=patterns.__getitem__)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for at, k in enumerate(order):
        if not at or patterns[k] != patterns[order[at - 1]]:
            machine.add_word(patterns[k], at)
    machine.make_automaton()
    first = np.array([not at or patterns[k] != patterns[order[at - 1]] for at, k in enumerate(order)], bool)
    runs = np.cumsum(first)
    # The phrases in order of (pattern, phrase), each with its pattern's number, so that both are found by one search.
    key = textkit.mix(phrases[order] ^ textkit.mix(np.flatnonzero(first).astype(np.uint64)[runs - 1])) if len(order) else np.empty(0, np.uint64)
    return np.sort(key), machine


def locate(machines: list[Machine], text: str, phrases: np.ndarray, anchor: int) -> np.ndarray:
    """For each phrase of a text whether an automaton found its pattern and it is one of the recurring phrases."""
    here = np.zeros(len(phrases), bool)
    for keys, machine in machines:
        hits = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2) if len(keys) else np.empty((0, 2), np.int64)
        if not len(hits):
            continue
        at, pattern = (hits[:, 0] + 1) // 2 - anchor, hits[:, 1]
        inside = at < len(phrases)
        at, pattern = at[inside], pattern[inside]
        key = textkit.mix(phrases[at] ^ textkit.mix(pattern.astype(np.uint64)))
        found = np.searchsorted(keys, key)
        here[at[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == key)]] = True
    return here


def _schema(kind: DataType, **rest: DataType) -> StructType:
    return StructType([StructField("k", kind), *(StructField(name, t) for name, t in rest.items())])


def _base(docs: DataFrame, p: Params) -> DataFrame:
    schema = _schema(docs.schema["k"].dataType, n=LongType(), bytes=LongType(), sha=BinaryType(), own=ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, sha, own = [], [], [], []
            for _, raw, _, _, h in hashed(*textkit.utf8(b.column(1))):
                n.append(len(h))
                size.append(len(raw))
                sha.append(hashlib.sha256(b" ".join(raw.split())).digest())
                phrases = textkit.windows(h, p.phrase, 32)
                own.append(np.unique(least_of(phrases, p)).view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate([*own, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=schema.names)

    return mapped(docs, run, schema)


def _patterns(holders: DataFrame, p: Params) -> DataFrame:
    """(g, pattern, shard) of the phrases ``gs`` that texts hold: their first words as symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, pattern, shard, wanted = [np.empty(0, np.uint64)], [], [np.empty(0, np.int32)], b.column(1)
            for row, _, _, _, h in hashed(*textkit.utf8(b.column(0))):
                phrases, at = np.unique(textkit.windows(h, p.phrase, 32), return_index=True)
                mine = np.isin(phrases, wanted[row].values.to_numpy().view(np.uint64))
                t = symbols(h)
                g.append(phrases[mine])
                shard.append(np.full(len(g[-1]), b.column(2)[row].as_py(), np.int32))
                pattern += [t[2 * i : 2 * (i + p.anchor)] for i in at[mine].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g).view(np.int64)), pa.array(pattern, pa.string()), pa.array(np.concatenate(shard))], names=["g", "pattern", "shard"])

    return mapped(holders.select("t", "gs", "shard"), run, "g bigint, pattern string, shard int").dropDuplicates(["g"])


def _windows(texts: DataFrame, patterns: DataFrame, p: Params) -> DataFrame:
    """(k, h1, h2, at) of the windows of ``texts`` (k, t, shards, turn, part) whose owned phrase the automata of ``patterns`` (g, pattern, shard, turn, part) located."""
    schema = _schema(texts.schema["k"].dataType, h1=LongType(), h2=LongType(), at=IntegerType())

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        g, shard, pattern = other.column("g").to_numpy().view(np.uint64), other.column("shard").to_numpy(), other.column("pattern")
        machines = {x: compiled(g[shard == x], pattern.filter(pa.array(shard == x)).to_pylist()) for x in (np.unique(shard).tolist() if len(own) else ())}
        out = []
        for b in own.select(["k", "t", "shards"]).to_batches(max_chunksize=BATCH_ROWS):
            rows, cols = [np.empty(0, np.int64)], [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]]
            for row, _, _, _, h in hashed(*textkit.utf8(b.column(1))):
                phrases = textkit.windows(h, p.phrase, 32)
                at = located(phrases, locate([machines[x] for x in b.column(2)[row].as_py()], symbols(h), phrases, p.anchor), p)
                if len(at):
                    rows.append(np.full(len(at), row))
                    for c, x in zip(cols, (textkit.windows(h, p.window, 50)[at].view(np.int64), textkit.windows(h, p.window, 51)[at].view(np.int64), at.astype(np.int32)), strict=True):
                        c.append(x)
            out.append(pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c)) for c in cols)], names=schema.names))
        pa.default_memory_pool().release_unused()
        kinds = pa.schema([own.schema.field("k"), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int32())])
        return pa.Table.from_batches(out, out[0].schema if out else kinds)

    # Few bytes, much work: not to be joined into few tasks.
    n, here = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["turn", "part"]
    sides = [df.repartition(n, *here).groupBy(*here) for df in (texts, patterns)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _cleaned(texts: DataFrame, p: Params) -> DataFrame:
    """(k, sha, n_removed, kept, kept text) of texts with the windows to take out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, removed, kept = [], [], []
            gone = b.column(2)
            for row, raw, starts, _, _ in hashed(*textkit.utf8(b.column(1))):
                words = raw.split()
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                edge = np.zeros(len(words) + 1, np.int32)
                at = np.array(gone[row].as_py(), np.int64)
                at = at[at + p.window <= len(words)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + p.window, -1)
                out = np.cumsum(edge)[:-1] > 0
                removed.append(int(out.sum()))
                kept.append(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["k", "sha", "n_removed", "kept"])

    schema = _schema(texts.schema["k"].dataType, sha=BinaryType(), n_removed=LongType(), kept=StringType())
    return mapped(texts.select("k", "t", "gone"), run, schema)


def _analysed(docs: DataFrame, p: Params, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, canon, cleaned): every row's words, each text's holder, and what is left of the texts that lose words."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = cut(_base(rows, p), "sub-base")
    some = base.where(f"n >= {p.window} and k is not null")
    canon = cut(some.groupBy("sha").agg(F.min("k").alias("first"), F.min_by("own", "k").alias("own"), F.min("bytes").alias("bytes")), "sub-texts")
    owned = canon.select(F.col("first").alias("k"), F.explode("own").alias("g"))
    recurring = cut(owned.groupBy("g").agg(F.count("*").alias("c"), F.min("k").alias("holder")).where("c > 1").select("g", "holder"), "sub-phrases")
    phrases = recurring.count()
    # The texts that have recurring phrases, and whose.
    size = canon.groupBy(F.col("first").alias("k")).agg(F.sum("bytes").alias("bytes"))
    met = cut(owned.join(with_bounded_broadcast(recurring, phrases), "g").select("k", "holder").distinct().join(size, "k"), "sub-met")
    much = met.select("k", "bytes").distinct().agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-phrases // p.shard), p.together * (much // p.part))
    shard = F.pmod(F.xxhash64("holder"), F.lit(shards)).cast("int").alias("shard")
    turn = F.floor(F.col("shard") / p.together).cast("int").alias("turn")
    dealt = recurring.select("g", "holder", shard)
    gs = cut(dealt.groupBy(F.col("holder").alias("k"), "shard").agg(F.collect_set("g").alias("gs")), "sub-holders")
    held = rows.join(with_bounded_broadcast(gs.select("k"), gs.count()), "k", "left_semi").join(gs, "k")
    patterns = cut(_patterns(held, p), "sub-patterns")
    # The shards through which each text is streamed, and the parts that the texts of each turn make.
    visits = cut(met.select("k", "bytes", shard).groupBy("k", "bytes", turn).agg(F.collect_set("shard").alias("shards")), "sub-visits")
    parts = cut(visits.groupBy("turn").agg(F.ceil(F.sum("bytes") / (4 * p.part)).cast("int").alias("parts")), "sub-parts")
    each = with_bounded_broadcast(parts, shards)
    where = visits.join(each, "turn").select("k", "shards", "turn", F.pmod(F.xxhash64("k", "turn"), F.col("parts")).cast("int").alias("part"))
    texts = rows.join(with_bounded_broadcast(where, 4 * visits.count()), "k")
    machines = patterns.withColumn("turn", turn).join(each, "turn").select("g", "pattern", "shard", "turn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = cut(_windows(texts, machines, p), "sub-windows")
    drop(recurring, gs, patterns, met, visits, parts)
    least = found.groupBy("h1", "h2").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    least = cut(least, "sub-confirmed")
    gone = found.join(with_bounded_broadcast(least, 3 * least.count()), ["h1", "h2"]).where("lo < k").groupBy("k").agg(F.collect_set("at").alias("gone"))
    gone = cut(gone, "sub-gone")
    ids = gone.select("k")
    losing = rows.join(with_bounded_broadcast(ids, ids.count()), "k", "left_semi").join(gone, "k")
    return base, canon, _cleaned(losing, p)


def dedup(docs: DataFrame, p: Params = Params(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed and kept_sha256."""
    base, canon, cleaned = _analysed(docs, p, text, key)
    small = cut(cleaned.select("k", "sha", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")).distinct(), "sub-cleaned")
    rows = base.select("k", "n", "sha").join(canon.select("sha", "first"), "sha", "left").join(small, ["k", "sha"], "left")
    copy = F.coalesce(F.col("k") > F.col("first"), F.lit(False))
    return rows.select(
        F.col("k").alias(key), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, p: Params = Params(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the kept words of the rows that lose some; all other rows stay as they are."""
    base, canon, cleaned = _analysed(docs, p, text, key)
    copies = base.join(canon, "sha").where("k > first").select("k", F.lit("").alias("kept"))
    return cleaned.where("n_removed > 0").select("k", "kept").unionByName(copies).distinct().withColumnRenamed("k", key)


#: The same in DuckDB's SQL.
SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM worded, unnest(range(1, len(w) - 48)) AS t(p)
), lost AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS m FROM win) WHERE m < doc_id) AS x, unnest(range(p, p + 50)) AS u(q)
), gone AS (
  SELECT doc_id, list(q) AS qs FROM lost GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, CASE WHEN qs IS NULL THEN w ELSE coalesce((SELECT list(w[i] ORDER BY i) FROM unnest(range(1, len(w) + 1)) AS t(i) WHERE NOT list_contains(qs, i)), []) END AS k FROM worded LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
