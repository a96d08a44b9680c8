"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; ``target / words of the source`` is
the mean number of copies of its documents.  The whole part is taken for sure,
the fractional parts are rounded together: two documents with fractional
copies transfer words between each other, in a random direction with
unbiased odds, until one is integral.  A transfer keeps the words of both, so
a source's total only moves in its very last rounding, which goes to the
nearer side: a source misses its target by half a document at most.  Documents are dealt
to small groups by the hash of their id; what stays fractional in each group
meets in the groups of the next level, a reduction tree.  All random numbers
derive from the document and the level, so reruns agree on any cluster.

Defined results: a null or empty text has size 0 and takes 0 words; a null
source is a source of its own, after all others; rows that repeat id, source
and text are a unit, of which as many rows as its share makes whole get a copy more and one
more takes part in the rounding, so no unit moves more than one row; ids may be of any type; without any word all
targets are 0; empty tables give empty results; other columns are carried or
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, gathered

WEIGHTS = (5.0, 2.0, 1.0)
#: Units of a group of the tree, on average.
GROUP = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(units: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, units, target) per source, from (source, size, rows).

    A common level times the weight, at most ``most`` times the source's size:
    the level at which these sum to ``share`` of all sizes.  One row per
    source goes through the windows.
    """
    s = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("rank", F.row_number().over(order)).withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("rank", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "units", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _uniform(h: int) -> float:
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((h ^ h >> 31) >> 11) / 9007199254740992.0


def pivot(words: np.ndarray, share: np.ndarray, seeds: np.ndarray, last: bool) -> np.ndarray:
    """Shares after pairing in order; at most one stays fractional, none if ``last``."""
    out, carry = share.copy(), -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if carry < 0:
            carry = i
            continue
        a, b, j = words[carry], words[i], carry
        up, down = min(a * (1 - out[j]), b * out[i]), min(a * out[j], b * (1 - out[i]))
        rise = _uniform(int(seeds[j]) * 0x9E3779B97F4A7C15 + int(seeds[i]) & 0xFFFFFFFFFFFFFFFF) * (up + down) < down
        move = up if rise else -down
        ends = (move == a * (1 - out[j]) or move == -a * out[j]), (move == b * out[i] or move == -b * (1 - out[i]))
        out[j], out[i] = (float(rise) if ends[0] else out[j] + move / a), (float(not rise) if ends[1] else out[i] - move / b)
        carry = next((k for k in (i, j) if 1e-12 < out[k] < 1 - 1e-12), -1)
        for k in (i, j):
            if k != carry:
                out[k] = round(out[k])
    if last and carry >= 0:
        out[carry] = float(out[carry] >= 0.5)
    return out


def decide(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash, rows, source_size, target, whole, extra) of every unit: its rows' copies, and how many of them get one more."""
    with_rate = units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    rows = with_rate.withColumn("whole", whole.cast("bigint")).withColumn("share", F.greatest(rate - whole, F.lit(0.0)) * F.col("rows"))
    rows = rows.withColumn("extra", F.floor(F.col("share") + 1e-9).cast("bigint")).withColumn("share", F.greatest(F.col("share") - F.col("extra"), F.lit(0.0)))
    rows = rows.withColumn("seed", F.xxhash64(F.lit(5), "doc_id", "source", "size", "hash"))
    rows = rows.withColumn("groups", F.ceil(F.col("units") / GROUP).cast("bigint")).withColumn("bucket", F.pmod("seed", "groups"))
    rows = cut(rows.select("doc_id", "source", "size", "hash", "rows", "source_size", "target", "whole", "extra", "share", "seed", "groups", "bucket"), "mix-units", 2)
    moving = (F.col("share") > 1e-9) & (F.col("share") < 1 - 1e-9) & (F.col("size") > 0)
    done = [rows.where(~moving)]
    live, level = rows.where(moving), 0
    most = rows.agg(F.max("groups")).first()[0] or 1
    schema = rows.schema

    def reduce(level: int) -> callable:
        def run(table: pa.Table) -> pa.Table:
            size, seed = (table.column(c).to_numpy() for c in ("size", "seed"))
            order = np.lexsort((seed, -size))
            words = size[order].astype(float)
            last = table.column("groups")[0].as_py() <= 1
            got = pivot(words, table.column("share").to_numpy()[order], (seed[order] + level).view(np.uint64), last)
            back = np.empty_like(got)
            back[order] = got
            return table.set_column(table.schema.get_field_index("share"), "share", pa.array(back))

        return run

    while True:
        after = live.groupBy("source", "bucket").applyInArrow(reduce(level), schema)
        if most <= 1:
            done.append(after)
            break
        after = cut(after, "mix-level", 2)
        done.append(after.where(~moving))
        most, level = -(-most // GROUP), level + 1
        live = after.where(moving).withColumn("groups", F.ceil(F.col("groups") / GROUP).cast("bigint")).withColumn("bucket", F.floor(F.col("bucket") / GROUP).cast("bigint"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "hash", "rows", "source_size", "target", "whole", (F.col("extra") + F.round("share").cast("bigint")).alias("extra"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_hash(F.col(text)).alias("hash"))
    units = cut(sized.groupBy("doc_id", "source", "size", "hash").agg(F.count("*").alias("rows")), "units", 2)
    return decide(units, targets(units))


def copies(row: Column) -> Column:
    """Of the unit's ``row``th row, from 1."""
    return F.col("whole") + F.when(row <= F.col("extra"), 1).otherwise(0)


def op5(docs: DataFrame) -> DataFrame:
    got = plan(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return gathered(got).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (copies(F.col("row")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies.

    Rows of a unit are alike, so any order may number them; a unit that repeats very often is one
    task's sort, which needs no more memory for it.
    """
    unit = ["doc_id", "source", "size", "hash"]
    got = plan(docs, key, source, text).where("whole + extra > 0").select(*(F.col(c).alias(f"u_{c}") for c in unit), "rows", "whole", "extra")
    mine = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_hash(F.col(text)).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("u_doc_id")) & F.col("source").eqNullSafe(F.col("u_source")) & (F.col("size") == F.col("u_size")) & (F.col("hash") == F.col("u_hash"))
    rows = mine.join(got, same)
    one = rows.where("rows = 1").withColumn("row", F.lit(1))
    more = rows.where("rows > 1").withColumn("row", F.row_number().over(W.partitionBy(*unit).orderBy("hash")))
    out = one.unionByName(more).withColumn("copies", copies(F.col("row"))).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc.*")
