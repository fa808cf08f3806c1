"""Session helpers: reading tables, cutting lineage in the shared folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; checked by a count before the hint is given.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leaves a configured folder alone; only where none is set a temporary one is made, in local mode. A cluster without one raises."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="varloom-checkpoint-"))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for a table that is written to be read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/varloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so a lost executor loses nothing and lineage stays short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the side has at most `limit` rows; otherwise df as it is, joined by shuffle.

    `rows` is the count if the caller knows it already.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def scratch_dir() -> str:
    """A task's private scratch folder, removed by the task itself; no other task ever reads it."""
    return tempfile.mkdtemp(prefix="varloom-task-", dir=os.environ.get("TMPDIR"))
