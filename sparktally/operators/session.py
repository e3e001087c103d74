"""Where lineage is cut: the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if it was counted and holds at most this many rows.
SMALL_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one, else a private folder (single-machine sessions)."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparktally-"))
    return named or sc.getCheckpointDir()


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most SMALL_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df
