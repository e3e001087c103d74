"""Shared pieces of the training-data operators: lineage cuts, graph components, text sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast hint is only given to a side that was counted and holds at most this many rows.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a private one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparktally-"))
    return sc.getCheckpointDir()


class Scratch:
    """The tables that one piece of work has written; closing it deletes them, but for those kept."""

    def __init__(self) -> None:
        self.written: dict[str, DataFrame] = {}

    def keep(self, *tables: DataFrame) -> None:
        """Tables that what is returned still reads."""
        for df in tables:
            self.written.pop(df._scratch_path, None)

    def close(self) -> None:
        for df in list(self.written.values()):
            discard(df)
        self.written.clear()


#: Whose tables are being written: set by ``scratch`` for the code it encloses, in its own thread.
_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Owns the tables that are materialised inside, nested ones excepted, and deletes them at the end."""
    mine = Scratch()
    before = _OWNER.set(mine)
    try:
        yield mine
    finally:
        _OWNER.reset(before)
        mine.close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    owner = _OWNER.get()
    if owner:
        owner.written[path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; the caller has written all that came from them."""
    for df in tables:
        spark, path = df.sparkSession, df._scratch_path
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        owner = _OWNER.get()
        if owner:
            owner.written.pop(path, None)


def release_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs once the driver has collected what refers to them; asked for after large ones."""
    spark._jvm.System.gc()


def release_memory() -> None:
    """Called by a task that is done with large tables: its Python worker lives on beside other stages and should be small then."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most BROADCAST_ROWS rows, else as it is (sort-merge join)."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` (longs); root is the component's least node.

    Alternates the two star operations of Kiveris et al. (2014) until the edge set stands
    still. Every round is a grouped minimum (combined before the shuffle) and a join; nothing
    is gathered on the driver but a row count and a checksum.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )

    def stamp(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = stamp(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = stamp(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
