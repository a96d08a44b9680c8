"""Shared helpers: the scratch area, table loading and bounded joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one 8-byte key that may be broadcast (4 MB, some 20 MB when hashed); larger sides shuffle.
BROADCAST_KEYS = 500_000


#: Bytes of the Arrow batches that Python workers get.  A batch is copied some times on its way (column
#: vectors, Arrow buffers, numpy arrays), so this bounds a worker's memory; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded bytes; a worker gives back what it has freed once a task ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where unset, on a local master only (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="seriate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str, waves: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Unlike ``DataFrame.checkpoint`` this computes the plan once, keeps columns
    prunable, and survives the loss of any executor.  ``waves`` writes at most
    that many files for each of the cluster's cores (see :func:`gathered`),
    for tables much smaller than what they are made from.
    """
    spark = df.sparkSession
    if waves:
        df = gathered(df, waves)
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seriate_path = path  # for drop()
    return out


def gathered(df: DataFrame, waves: int = 2) -> DataFrame:
    """``df`` in at most ``waves`` partitions for each of the cluster's cores, or a 16th of the shuffle's.

    Few rows need few files; partitions are joined without a shuffle.
    """
    spark = df.sparkSession
    return df.coalesce(max(4, waves * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner free the shuffle files of finished plans, which it does once the driver has collected its garbage."""
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` once nothing lazy reads them."""
    for t in tables:
        path = getattr(t, "_seriate_path", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            fs = where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf())
            fs.delete(where, True)
    if tables:
        sweep(tables[0].sparkSession)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_bounded_broadcast(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def split_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
