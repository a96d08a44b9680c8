"""Shard assignment by jump consistent hashing, in Spark expressions only.

A row's key walks the jump sequence: from bucket ``b`` it draws a 31-bit
number from the md5 of key and ``b`` and jumps to
``floor((b + 1) * 2**31 / (draw + 1))`` until that reaches the shard count.
The sequence depends on the key alone, so one more shard takes rows only into
itself, and there is no ring table.

Defined results: the key is the id as text (null: empty text, so null ids
share a shard); a null text has size 16 and checksum 0; ``slot`` runs gapless
from 0 in each shard in the order of (block, id, size, checksum), where
repeated rows take adjacent slots in any order; empty tables give empty
results; other columns are ignored, or carried (but for those that have a name
of the result) by :func:`dealt`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blocks into which slots are numbered apart from each other; raise it with the rows of a shard.
BLOCKS = 256


def key_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def draw(key: Column, step: Column) -> Column:
    """31 bits of md5(key:step)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), step.cast("string")).cast("binary")), 1, 8)
    return F.shiftrightunsigned(F.conv(digits, 16, 10).cast("bigint"), 1)


def jumps(key: Column, most: int) -> Column:
    """The buckets under ``most`` that the key's jump sequence visits, in order, as an array."""

    def step(path: Column, b: Column) -> Column:
        # The walk stands at b or has already jumped beyond it.
        return F.when(F.element_at(path, -1) == b, F.concat(path, F.array(F.floor((b + 1) * (F.lit(2.0**31) / (draw(key, b) + 1).cast("double"))).cast("bigint")))).otherwise(path)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(most - 1).cast("bigint")), F.array(F.lit(0).cast("bigint")), step)


def shard_of(path: Column, shards: int) -> Column:
    return F.array_max(F.filter(path, lambda j: j < shards)).cast("int")


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign(docs: DataFrame, shards: int = 40, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its size, shard, slot and the shard it has with one shard more."""
    return dealt(docs.select(key, text), shards, blocks, key, text).select(*RESULT)


def dealt(docs: DataFrame, shards: int = 40, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of :func:`assign` with the text and all other columns; the one shuffle of the texts is by shard and block."""
    rest = F.struct(F.lit(None).alias(RESULT[0]), *(F.col(c) for c in docs.columns if c != key and c not in RESULT)).alias("rest")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    k = key_text(F.col(key))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("bigint") + 16).alias("size"), F.crc32(raw).alias("text_crc32"), jumps(k, shards + 1).alias("path"), F.pmod(draw(k, F.lit("block")), F.lit(blocks)).cast("int").alias("block"), rest)
    rows = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("path"), shards).alias("shard"), shard_of(F.col("path"), shards + 1).alias("grown_shard"), "block", "rest")
    # At most shards * blocks counts, so their running sum may be taken on one task.
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = W.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("within", F.row_number().over(order) - 1)
    out = numbered.join(F.broadcast(offsets), ["shard", "block"])
    out = out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("bigint").alias("slot"), "grown_shard", "rest")
    return out.select(*RESULT, F.col("rest").dropFields(RESULT[0]).alias("rest")).select(*RESULT, "rest.*") if len(docs.columns) > 1 else out.select(*RESULT)


#: The same in DuckDB's SQL; {docs} is the table.
SQL = """
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS raw FROM {docs}
), crc_table(i, step, v) AS (
  SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc_table WHERE step < 8
), crc_list AS (
  SELECT list(v ORDER BY i) AS t FROM crc_table WHERE step = 8
), sized AS (
  SELECT rid, doc_id, k, octet_length(raw) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(raw)), lambda p: ('0x' || substr(hex(raw), CAST(2 * p + 1 AS BIGINT), 2))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS text_crc32
  FROM base, crc_list
), walk(rid, k, b, j) AS (
  SELECT rid, k, -1::BIGINT, 0::BIGINT FROM base
  UNION ALL
  SELECT rid, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((('0x' || substr(md5(k || ':' || j), 1, 8))::UBIGINT >> 1) + 1 AS DOUBLE))) AS BIGINT) FROM walk WHERE j < 41
), placed AS (
  SELECT rid, CAST(max(j) FILTER (j < 40) AS INTEGER) AS shard, CAST(max(j) FILTER (j < 41) AS INTEGER) AS grown_shard FROM walk GROUP BY rid
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (('0x' || substr(md5(k || ':block'), 1, 8))::UBIGINT >> 1) % 256, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM sized JOIN placed USING (rid)
"""
