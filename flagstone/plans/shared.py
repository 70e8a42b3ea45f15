"""Measured small tables, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side of up to this many narrow rows (a key and a few numbers) is a few megabytes.
SMALL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Where it is unset, a folder of this machine is made,
    which only a local master may use; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flagstone-"))
    return folder or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so that lost executors never replay a long loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame) -> DataFrame:
    """Compute an aggregate once and store it below the shared folder; nothing stays in memory.

    The optimizer then knows its true size and broadcasts it only below
    `spark.sql.autoBroadcastJoinThreshold`; above that the join shuffles and adaptive
    execution splits skewed keys.
    """
    path = scratch_path(df.sparkSession, "measured")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hint_if_small(df: DataFrame, rows: int, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a table of `rows` counted rows when that is small, else leave it to Catalyst."""
    return F.broadcast(df) if rows <= limit else df


def bounded_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list:
    """Rows of a table that must be small (a vocabulary, a card); more than `limit` is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows")
    return rows
