"""Cutting lineage with data that outlives an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, qualified with its file system's scheme (so that
    writers outside Spark, such as pyarrow, open the same shared folder); a temporary one only in
    local mode."""
    import posixpath

    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        # Spark qualifies the folder and adds a folder of its own below it.
        return posixpath.dirname(sc.getCheckpointDir())
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="martloom-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage, so later branches all read the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: lineage is cut, columns
    are pruned and filters pushed down when it is read again."""
    import posixpath
    import uuid

    path = posixpath.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
