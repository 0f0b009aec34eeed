"""Small helpers of this subpackage: stored intermediate tables and shared file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from martloom.operators.storage import shared_dir

#: ASCII white space; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """``(pyarrow file system, path)`` of a URI or a plain local path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def sized_join(big: DataFrame, small: DataFrame, key: str, max_rows: int = 1 << 20, salts: int = 64) -> DataFrame:
    """``big`` left-joined to ``small`` on ``key`` (``small`` has one row a key). ``small`` is counted
    first: up to ``max_rows`` rows it is broadcast; above, each row of ``big`` gets one of ``salts``
    salts and ``small`` is repeated once a salt, so a key that holds a third of ``big`` is spread over
    ``salts`` tasks."""
    from pyspark.sql import functions as F

    if small.count() <= max_rows:
        return big.join(F.broadcast(small), key, "left")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return big.withColumn("_salt", salt).join(spread, [key, "_salt"], "left").drop("_salt")
