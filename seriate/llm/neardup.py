"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with
fewer words the whole sequence is one).  Instead of one minhash tuple per
table, two small collections of tuples are computed; the key of table (i, j)
pairs tuple i of the first with tuple j of the second.  ``left * right``
tables thus cost ``(left + right) * rows`` minhashes.  Documents that share a
table are candidates, confirmed on full sets.

With 2 hashes a tuple and 16 x 16 tables, a pair of similarity 0.75 shares no
table with probability 4e-6, and the tests of :mod:`graph` lose no candidate.

Defined results: null texts, empty texts and texts without words have an
empty set and are linked with nothing; texts are hashed whole; equal sets are
one node, whatever number of documents has them; rows that repeat an id are
judged each by its text; ids may be of any type that has an order; a null id gets no component and is kept; empty tables give empty
results; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph, textkit
from .common import cut, drop, mapped, sweep, with_bounded_broadcast


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 75
    left: int = 16
    right: int = 16
    rows: int = 2


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's sorted distinct shingle hashes."""
    for i, j in textkit.groups(offsets):
        part = data[offsets[i] : offsets[j]]
        starts, ends, bounds = textkit.word_spans(part, offsets[i : j + 1] - offsets[i])
        hashes = textkit.hash_spans(part, starts, ends, fold=True)
        for row in range(i, j):
            h = hashes[bounds[row - i] : bounds[row - i + 1]]
            if not len(h):
                yield row, h
            elif len(h) < words:
                yield row, textkit.windows(h, len(h), 100 + len(h))
            else:
                yield row, np.unique(textkit.windows(h, words, 100))


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima under the multiply-add hash functions (a, b), in pieces of bounded size."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, (hashes[at : at + 512, None] * a + b).min(0), out=low)
    return low


def signatures(docs: DataFrame, p: Params, text: str, key: str) -> DataFrame:
    """(k, own, n, d1, d2, sig): the text's hash, set size, set digest and the hashed tuples of both collections, per row."""
    rng = np.random.default_rng(8)
    count = (p.left + p.right) * p.rows
    a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, np.uint64)
    place = textkit.mix(np.arange(1, p.left + p.right + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.utf8(batch.column(2))
            rows = len(offsets) - 1
            n, d, sig = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64), np.zeros((rows, p.left + p.right), np.uint64)
            for row, h in shingles(data, offsets, p.words):
                n[row] = len(h)
                if len(h):
                    d[0, row], d[1, row] = h.sum(), textkit.mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum()
                    low = minhash(h, a, b).reshape(-1, p.rows)
                    t = place.copy()
                    for k in range(p.rows):
                        t = textkit.mix(t ^ low[:, k])
                    sig[row] = t
            flat = pa.array(sig.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (p.left + p.right)), flat)], names=["k", "own", "n", "d1", "d2", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"), F.col(text).alias("t")), run, f"k {kind}, own bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>")


def tables(nodes: DataFrame, p: Params) -> DataFrame:
    """(bucket, node, size): the table keys of nodes that share a tuple with another node in both collections.

    A table key pairs two tuples, so a node can only share a table through
    tuples that it shares; others are left out before the pairing.
    """
    tuples = nodes.select("node", "n", F.posexplode("sig").alias("i", "tuple"))
    shared = tuples.groupBy("tuple").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("tuple")
    shared = cut(shared, "shared-tuples")
    mine = tuples.join(shared, "tuple").groupBy("node", "n").agg(F.collect_list(F.when(F.col("i") < p.left, F.col("tuple"))).alias("l"), F.collect_list(F.when(F.col("i") >= p.left, F.col("tuple"))).alias("r"))
    both = F.flatten(F.transform("l", lambda x: F.transform("r", lambda y: F.xxhash64(x, y))))
    return mine.select("node", F.col("n").alias("size"), F.explode(both).alias("bucket"))


def fits(percent: int) -> callable:
    return lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent


def sets_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame, most: int, p: Params, text: str, key: str) -> DataFrame:
    """(node, s): the shingle sets of the nodes in ``ids``, of which there are ``most`` at most, from a document that has each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.utf8(batch.column(1))
            found = [h for _, h in shingles(data, offsets, p.words)]
            bounds = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            flat = pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), flat)], names=["node", "s"])

    # A node is the set of its first document's text; rows that repeat that document give it again.
    where = cut(nodes.select("node", "first").join(with_bounded_broadcast(ids, most), "node", "left_semi").select("node", "first.*"), "places")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"), F.col(text).alias("t"))
    texts = rows.join(with_bounded_broadcast(where, 2 * where.count()), ["k", "own"]).select("node", "t")
    return mapped(texts, sets, "node bigint, s array<bigint>").dropDuplicates(["node"])


def verifier(docs: DataFrame, nodes: DataFrame, p: Params, text: str, key: str) -> graph.Verify:
    def verify(pairs: DataFrame) -> DataFrame:
        held = cut(pairs, "pairs")
        ids = held.select(F.col("a").alias("node")).unionByName(held.select(F.col("b").alias("node"))).distinct()
        s = cut(sets_of(docs, nodes, ids, 2 * held.count(), p, text, key), "pair-sets")
        x, y = s.select(F.col("node").alias("a"), F.col("s").alias("sa")), s.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        out = held.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("any"))
        out = cut(out.where(F.col("both") * 100 >= F.col("any") * p.percent).select("a", "b"), "pair-links")
        drop(held, s)
        return out

    return verify


def spokes(rest: DataFrame) -> DataFrame:
    """Distinct (a, b): each bucket's smallest node with each other member; a row a member at most, of one shuffle."""
    hub = F.min("node").over(W.partitionBy("bucket"))
    return rest.select(hub.alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


#: Shingles of a block of :func:`settler`, on average.
BLOCK = 1 << 18


def settler(docs: DataFrame, nodes: DataFrame, p: Params, text: str, key: str) -> graph.Verify:
    """Settle crowds of alike but not linked documents without a row per pair.

    Documents that share an open bucket, directly or through others, form a
    crowd.  A crowd is cut into blocks of bounded size, and each two blocks
    meet in a task, which finds the links between different components by an
    inverted index over the blocks and returns those that join components.
    """

    def block(table: pa.Table) -> pa.Table:
        node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        arrays = [x.values.to_numpy(zero_copy_only=False) for x in table.column("s")]
        sizes = np.array([len(x) for x in arrays])
        owner, flat = np.repeat(np.arange(len(node)), sizes), np.concatenate(arrays)
        order = np.argsort(flat, kind="stable")
        new = np.append(True, flat[order][1:] != flat[order][:-1])
        gid = np.empty(len(flat), np.int64)
        gid[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        df, posts, starts = np.diff(np.append(first, len(flat))), owner[order], np.concatenate([[0], np.cumsum(sizes)])
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        label, n = np.unique(root, return_counts=True)
        crowd, links = label[n.argmax()], []
        for x in np.flatnonzero(root != crowd):
            mine = gid[starts[x] : starts[x + 1]]
            mine = mine[df[mine] > 1]
            if len(mine) * 100 < sizes[x] * p.percent:  # too much of it is nowhere else
                continue
            reach = df[mine]
            at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
            both = np.bincount(posts[at], minlength=len(node))
            alike = both * 100 >= (sizes[x] + sizes - both) * p.percent
            if own.min() != own.max():
                alike &= own != own[x]  # those of one block meet elsewhere
            for y in np.flatnonzero(alike & (root != root[x])):
                a, b = find(int(root[x])), find(int(root[y]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    links.append((min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))))
        return pa.table({"a": pa.array([k[0] for k in links], pa.int64()), "b": pa.array([k[1] for k in links], pa.int64())})

    def settle(rest: DataFrame) -> DataFrame:
        edges = cut(spokes(rest), "crowd-edges", 1)
        crowds = graph.components(edges).select("node", F.col("root").alias("crowd"))
        mine = cut(rest.select("node", "size", "root").distinct().join(crowds, "node"), "crowds", 1)
        blocks = mine.groupBy("crowd").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
        rows = mine.join(blocks, "crowd").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.join(sets_of(docs, nodes, mine.select("node"), mine.count(), p, text, key), "node")
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("crowd", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "node", "root", "own", "s")
        return rows.groupBy("crowd", "lo", "hi").applyInArrow(block, "a bigint, b bigint")

    return settle


def _judged(docs: DataFrame, p: Params, text: str, key: str) -> DataFrame:
    """(k, own, n, stay): of each row its text's hash, set size and the first document (k, own) of its component; null without a set."""
    sig = cut(signatures(docs, p, text, key), "signatures")
    # A set is a node, held by the first document that has it; the aggregate is partial before its shuffle, so copies cost nothing.
    some = sig.where("n > 0 and k is not null").groupBy("d1", "d2").agg(F.min(F.struct("k", "own")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = cut(some.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    sweep(docs.sparkSession)
    buckets = tables(nodes, p)
    _, comp = graph.linked(buckets, verifier(docs, nodes, p, text, key), fits(p.percent), settler(docs, nodes, p, text, key))
    rooted = nodes.select("node", "d1", "d2", "first").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where("root <> node").groupBy("root").agg(F.min("first").alias("other"))
    least = cut(least, "least")
    # Most nodes are alone; the others' first document is the least of the root's and its members'.
    roots = rooted.where("root = node").join(least, "root", "left").select("d1", "d2", "root", F.least("first", "other").alias("stay"))
    roots = cut(roots, "roots")
    members = rooted.where("root <> node").select("d1", "d2", "root").join(roots.select("root", "stay"), "root").select("d1", "d2", "stay")
    stays = roots.select("d1", "d2", "stay").unionByName(members)
    rows = sig.select("k", "own", "n", "d1", "d2")
    out = rows.where("n > 0 and k is not null").join(stays, ["d1", "d2"], "left").select("k", "own", "n", "stay")
    return out.unionByName(rows.where("n = 0 or k is null").select("k", "own", "n", F.lit(None).cast(out.schema["stay"].dataType).alias("stay")))


def classes(docs: DataFrame, p: Params = Params(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id and kept."""
    out = _judged(docs, p, text, key).select("k", "n", F.coalesce("stay.k", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first document (by id, then by its text's hash) of each component; of rows that repeat it, one. Null ids and empty sets all stay."""
    here = F.struct("k", "own")
    found = _judged(docs, p, text, key).where("stay is not null").groupBy("k", "own").agg(F.max(here == F.col("stay")).alias("kept"), F.count("*").alias("rows"))
    found = cut(found.where("not kept or rows > 1"), "decided")
    gone, again = found.where("not kept").select("k", "own"), found.where("kept").select("k", "own")
    mine = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    rows = mine.join(with_bounded_broadcast(gone, 2 * gone.count()), ["k", "own"], "left_anti")
    if again.isEmpty():
        return rows.select("doc.*")
    once = rows.join(again, ["k", "own"], "left_semi").dropDuplicates(["k", "own"])
    return rows.join(again, ["k", "own"], "left_anti").unionByName(once).select("doc.*")


#: The same in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded
), shingle AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS g FROM sets
), link AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sets p ON p.doc_id = a.doc_id JOIN sets q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, len(p.s), len(q.s) HAVING 100 * count(*) >= 75 * (len(p.s) + len(q.s) - count(*))
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN least ON x = doc_id
"""
