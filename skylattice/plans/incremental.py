"""Restartable runs: what has no result yet is done, in bounded batches, and appended."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.organize import pending
from skylattice.storage import new_path


def run_batch(source: DataFrame, state_path: str, key: str, work: Callable[[DataFrame], DataFrame], limit: int | None = None) -> int:
    """Do the first ``limit`` rows by key that the state table lacks, append them, and return how many there were."""
    spark = source.sparkSession
    try:
        done = spark.read.parquet(state_path).select(key)
    except Exception as error:  # the first run has no state
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = source.select(key).limit(0)
    batch = work(pending(source, done, key, F.col(key), limit))
    before = done.count()
    batch.write.mode("append").parquet(state_path)
    return spark.read.parquet(state_path).count() - before


def run_in_batches(source: DataFrame, key: str, batches: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after ``batches`` bounded runs over all of the source."""
    path = new_path(source.sparkSession, "state")
    size = max(1, math.ceil(source.count() / batches))
    while run_batch(source, path, key, work, size):
        pass
    return source.sparkSession.read.parquet(path)
