"""Shared-folder materialisation, bounded Arrow slices, size-checked semi/anti joins and distributed running totals."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most rows of small fixed-width keys that may be broadcast; a larger side is shuffled instead.
BROADCAST_KEYS = 1_000_000
#: Rows of an Arrow batch that become Python objects at once, and bytes that a batch may hold on its way to Python.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Lanes whose totals one task adds up; the totals of such blocks are added up by one more.
LANE_BLOCK = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    return materialize_at(df, fresh_path(df.sparkSession, label))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, path: str) -> DataFrame:
    """materialize_at, and the driver's garbage collected: only then does Spark delete the shuffle files that made the table."""
    out = materialize_at(df, path)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads: what was made from it has been written in full."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES (or one row); the session keeps that one value for all operators.

    A worker outlives its tasks, so after each it gives the memory that is free again back to the system.
    """

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
    if trim:
        trim(0)


def sliced(batches: Iterator, rows: int = BATCH_ROWS) -> Iterator:
    """Arrow batches of at most rows rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def is_small(df: DataFrame, limit: int = BROADCAST_KEYS) -> bool:
    """Whether df, a table of a few fixed-width columns, is counted to have at most limit rows."""
    return df.limit(limit + 1).count() <= limit


def with_ids(df: DataFrame, ids: DataFrame, keys: str | list[str], how: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Join on keys; ids are broadcast only when counted to be at most limit, else both sides shuffle."""
    return df.join(F.broadcast(ids) if is_small(ids, limit) else ids.hint("merge"), keys, how)


def starts(totals: DataFrame, lane: str, total: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, lane, before: the sum of total over the smaller lanes of the group; totals has a row per group and lane.

    Two levels of windows, so that a task holds LANE_BLOCK lanes, or one row per LANE_BLOCK lanes.
    """
    block = F.floor(F.col(lane) / LANE_BLOCK)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy(*groups, block.alias("block")).agg(F.sum(total).alias("whole"))
    blocks = blocks.select(*groups, "block", F.coalesce(F.sum("whole").over(before(*groups).orderBy("block")), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum(total).over(before(*groups, "block").orderBy(lane)), F.lit(0))
    held = totals.withColumn("block", block).withColumn("inner", inner).join(blocks, [*groups, "block"])
    return held.select(*groups, lane, (F.col("base") + F.col("inner")).cast("long").alias("before"))


def ranked(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df, written, with rank: its place from 0 in the given order (ties in an order of their own).

    Ranges of the order are dealt to tasks, numbered there, and offset by the counts of the ranges before.
    """
    dealt = df.repartitionByRange(*order).withColumn("lane", F.spark_partition_id().cast("long"))
    dealt = materialize(dealt, label)
    within = dealt.withColumn("at", F.row_number().over(Window.partitionBy("lane").orderBy(*order)) - 1)
    before = starts(dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("n")), "lane", "n")
    return within.join(before, "lane").withColumn("rank", F.col("before") + F.col("at")).drop("lane", "at", "before")
