"""Tables written to the folder that the driver and all executors share.

Spark drops shuffle files when an executor is lost and then recomputes whole
lineages; a written table is read again instead.  The folder is the session's
``spark.checkpoint.dir``; only where that is unset and the session is a single
local process (as in tests) a folder of our own is made and set.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of fixed-width columns is broadcast only if its size on disk is at most this.
BROADCAST_BYTES = 8 * 1024 * 1024
#: The same for a table with strings or arrays, which pack much tighter on disk than in memory.
BROADCAST_NESTED_BYTES = 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            base = tempfile.mkdtemp(prefix="skylattice-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/skylattice/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Zstandard takes less disk than the default and holds no buffers outside
    the heap after a page is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    spark = df.sparkSession
    mark = shared_dir(spark).split(":", 1)[-1] + "/skylattice/"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if mark in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet next to ``path`` and then put it in its place, so that readers never see half a table."""
    spark = df.sparkSession
    fs, place = _file_system(spark, path)
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs.delete(place, True)
    if not fs.rename(_file_system(spark, new)[1], place):
        raise OSError(f"{path} could not be replaced")


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at ``path``, which is built and put there first if it is missing (or ``again``)."""
    if again or not exists(spark, path):
        replace_table(build(), path)
    return spark.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a written table, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast if the measured size allows it, else leave the choice to Spark."""
    if limit is None:
        nested = any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in df.schema)
        limit = BROADCAST_NESTED_BYTES if nested else BROADCAST_BYTES
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no table refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
