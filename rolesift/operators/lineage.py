"""Cutting a plan where several later steps read the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one task takes of rows that are dealt out.
TASK_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the cluster's checkpoint folder.

    The folder is the session's spark.checkpoint.dir, shared storage that
    outlives an executor.
    """
    spark = df.sparkSession
    at = shared(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as files in the cluster's checkpoint folder.

    For loops that join what they have cut. A checkpoint keeps the size that Spark estimated for its plan, the
    product of the sizes joined, so the digits of that number multiply in every round until they fill the
    driver's memory. Files have the size that they have.
    """
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The same rows, dealt evenly over one task for each ``task_rows`` of them.

    Rows of a few bytes lie by the million in one part of a file, which is one task. A draw
    deals them, not a key, as keys may repeat. The plan is cut: a filter on a computed column
    would be pushed below the exchange, where one task works it out for all.
    """
    tasks = -(-rows.count() // task_rows)
    return cut(rows.repartition(tasks, F.rand(0))) if tasks > 1 else rows


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset, a local session, which is one process, gets a temporary
    folder; on a cluster, where executors would not see it, the job fails.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="rolesift-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def scratch(spark: SparkSession) -> str:
    """A fresh path in the same shared folder."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"
