"""What several operators share: work folder, saved tables, batches of bounded size, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once.
SLICE_BYTES = 2 << 20
#: Folders of the tables that `saved` wrote and `drop` has not deleted.
WRITTEN: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local master gets a temporary one, and a cluster an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(told)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    return told


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the work folder and read again: its lineage ends there."""
    path = f"{work_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes saved tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        WRITTEN.remove(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def release() -> None:
    """Gives freed memory back to the system, so that a worker between two batches or tasks holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of column `name` in each hold `most` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, sizes, ends
        release()


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column: counts[i] of the values in row i."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..counts[i]-1 for every i, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b).

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes: every round
    replaces links by links to a smaller node, so the work stays in proportion to the links. A
    node's minimum is aggregated before it is joined, and written first, so that the join of a
    hub's links can be split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = e.checkpoint(), None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = e.checkpoint()
        low = e.groupBy("a").agg(F.min("b").alias("m")).checkpoint()
        more = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = more.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        before = now


def ranked(df: DataFrame, keys: list[str], hashed: str, ties: list[str], name: str = "rank", bits: int = 10) -> DataFrame:
    """df with each row's 0-based rank among the rows of its keys, by `hashed` (a 64-bit hash) and `ties`.

    A group is dealt over 2**bits buckets of the hash's first bits, so that no task gets a whole
    hot group; a bucket's first rank is the sum of the counts of the buckets before it. The counts are
    written first: a join on their window's partitions would gather whole groups again.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.shiftrightunsigned(hashed, 64 - bits))
    count = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    count = saved(count.select(*keys, "_bucket", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(hashed, *ties)
    out = df.join(count, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_bucket", "_first")


def subset_sum(sizes: np.ndarray, counts: np.ndarray, target: int) -> np.ndarray | None:
    """How many of each size (at most counts) sum nearest to target, or None if nothing is to be taken.

    Bounded knapsack: counts are split into powers of two, and every sum keeps the first item that
    reached it, from which the choice is read back. Sums up to target plus the largest size are kept.
    """
    taken = np.zeros(len(sizes), np.int64)
    if target <= 0 or len(sizes) == 0:
        return taken
    most = target + int(min(sizes.max(), target))
    reached, by, items = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32), []
    reached[0] = True
    for i, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        k = 1
        while count > 0 and not reached[target]:
            k = min(k, count)
            step = k * size
            if step <= most:
                new = reached[:-step] & ~reached[step:]
                by[step:][new] = len(items)
                reached[step:] |= new
                items.append((i, k, step))
            count -= k
            k *= 2
        if reached[target]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - target))])
    while at:
        i, k, step = items[by[at]]
        taken[i] += k
        at -= step
    return taken
