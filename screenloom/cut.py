"""Ends a lineage in the shared checkpoint folder, so that a loop's plan stays short and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="screenloom-")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: in columns, and nothing before it is worked out twice."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What makes a partition of a chain over trees, by size in files and by rows: nodes are some fifty times as large in a sort as in a file.
DEALT_BYTES, DEALT_ROWS = 2_000_000, 100_000


def dealt(df: DataFrame, *keys: str, each: int = DEALT_BYTES, rows: int = DEALT_ROWS) -> DataFrame:
    """``df`` in partitions by ``keys``, as many as its size in files or its rows ask for, so that what a task sorts stays in memory.

    Left to itself Spark puts so much compressed data into one partition that every sort after it spills. Size alone tells too
    little, as equal values take no space in a file; rows are counted from what files say of themselves.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each), -(-df.count() // rows)), *keys)
