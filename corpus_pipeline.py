"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a table; :func:`run` writes each as Parquet in the shared scratch
folder and reads it again for the next.

Defined results: a null or empty text scores as the toxicity model's intercept, is no
near copy, holds no benchmark item and has no words, so it passes every stage and is
in the mix once for each whole copy of its source's rate; a null id is never merged
with another; repeated rows are one document to the near-copy search and units of their
own to the mix; other columns are carried by all stages, but for those that are named as a
result of the last (size, text_crc32, law, shard, slot, grown_shard); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriate.llm import decontam, mixing, neardup, sharding, toxicity
from seriate.llm.common import cut, drop, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, rejects go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources come near their target weights."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot: the corpus, ready to be written shard by shard."""
    return sharding.dealt(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The toxicity model, the near-copy search and the mixing's draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        docs = before = out
    return docs
