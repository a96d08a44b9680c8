"""Linking inside buckets and connected components, in DataFrame operations only.

Buckets are rows (bucket, node): nodes that share a bucket may be linked.  A
caller's ``verify`` keeps the true links among given pairs.  All pairs of a
bucket are never emitted up front:

1. every node is tested against its bucket's smallest node, and against some
   more members if wanted (stars);
2. components of the links found are contracted, and buckets that now lie in
   one component are done;
3. what is left is settled by the caller's ``settle``, which must link any two
   nodes of a bucket that belong together and lie in different components.  One
   bucket stands for all with the same members.

So every two nodes of a bucket end up in one component, or were tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

Verify = Callable[[DataFrame], DataFrame]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the distinct edges (a, b); root is the smallest node reachable.

    Local contractions: each node merges into the neighbour (or itself) of
    least rank.  The first round ranks by id, which settles the stars that
    :func:`linked` makes at once; later ones draw hashed ranks anew, so the
    number of rounds is logarithmic for any graph.
    """
    live, rounds = edges.select("a", "b"), []
    while True:
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("u")))
        rank = (lambda c, seed=len(rounds): F.struct(F.xxhash64(F.lit(seed), c).alias("r"), F.col(c).alias("id"))) if rounds else (lambda c: F.struct(F.col(c).alias("id")))
        moved = cut(both.groupBy("v").agg(F.min(rank("u")).alias("m")).select("v", F.least("m", rank("v"))["id"].alias("to")), "moved", 1)
        rounds.append(moved)
        # v ~ u becomes to(v) ~ to(u); v ~ to(v) was an edge itself, or v stays.
        step = live.join(moved.select(F.col("v").alias("a"), F.col("to").alias("ta")), "a").join(moved.select(F.col("v").alias("b"), F.col("to").alias("tb")), "b")
        step = step.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b")
        if step.isEmpty():
            break
        live = cut(step.distinct(), "edges", 1)
    if len(rounds) == 1:
        return rounds[0].select(F.col("v").alias("node"), F.col("to").alias("root"))
    # Nodes' labels after all rounds, composed from the last round back.
    label = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        label = earlier.join(label.select(F.col("v").alias("to"), F.col("to").alias("end")), "to", "left").select("v", F.coalesce("end", "to").alias("to"))
    # Tables of their own let the join split a label that very many nodes have.
    label = cut(label, "labels", 1)
    least = cut(label.groupBy("to").agg(F.min("v").alias("root")), "roots", 1)
    drop(*rounds)
    return label.join(least, "to").select(F.col("v").alias("node"), "root")


def pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(buckets: DataFrame, verify: Verify, fits: Callable[[Column, Column], Column], settle: Verify, centres: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links, components) of nodes given as (bucket, node, size) rows.

    ``fits(size, size)`` is a cheap necessary condition on what two nodes have
    as ``size``, a number or a struct; it is part of the joins' conditions.
    ``verify`` gets distinct pairs (a, b) with a < b and returns those linked;
    ``settle`` gets rows (bucket, node, size, root) and returns links.  With
    more ``centres``, nodes are also tested against members of least hashed
    rank, another in each bucket: of a crowd in which many are linked, but not all with the
    smallest, little is then left open.  Links are those found by the tests:
    enough to connect each component.
    """
    sums = [F.sum(F.xxhash64(F.lit(k), "node") % 1_000_000_007).alias(f"sum{k}") for k in (1, 2)]
    least = [F.min(F.struct(*([F.xxhash64(F.lit(-k), "bucket", "node").alias("rank")] if k else []), "node", "size")).alias(f"c{k}") for k in range(centres)]
    found = buckets.groupBy("bucket").agg(*least, F.max("node").alias("top"), F.count("*").alias("members"), *sums).where(F.col("c0.node") < F.col("top"))
    # Two members need one test.
    pick = F.array(*(F.struct(F.col(f"c{k}.node").alias("node"), F.col(f"c{k}.size").alias("size")) for k in range(centres)))
    found = found.withColumn("centres", F.when(F.col("members") == 2, F.slice(pick, 1, 1)).otherwise(F.array_distinct(pick)))
    # Buckets with the same members are told by count and two sums; the first stands for them.
    kept = found.groupBy("members", "sum1", "sum2").agg(F.min(F.struct("bucket", "centres")).alias("b")).select("members", "b.bucket", "b.centres")
    members = cut(buckets.join(kept, "bucket").select("bucket", "node", "size", "members", "centres"), "members")
    tests = F.filter("centres", lambda c: (c["node"] != F.col("node")) & fits(F.col("size"), c["size"]))
    star = members.select("node", F.explode(tests).alias("c")).select(*pairs(F.col("node"), F.col("c.node"))).distinct()
    links = cut(verify(star), "links")
    comp = components(links)
    # What the stars leave open: buckets of three or more that lie in several components.
    at = members.where("members > 2").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    untested = ~F.exists("centres", lambda c: c["node"] == F.col("node"))
    rest = cut(at.join(open_, "bucket").where(untested).select("bucket", "node", "size", "root"), "rest")
    if not rest.isEmpty():
        links = cut(links.unionByName(settle(rest)), "links")
        comp = components(links)
    drop(members, rest)
    return links, comp
