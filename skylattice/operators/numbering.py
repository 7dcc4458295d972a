"""Dense global numbers, positions and medians without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.storage import materialize


def number_rows(df: DataFrame, order: list[Column | str], name: str = "rn", start: int = 1) -> DataFrame:
    """``df`` with a gapless number in ``order``.

    Rows are dealt by range, counted by partition, and numbered inside their
    partition; only the counts (one a partition) meet in one place.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    dealt = materialize(dealt, "numbered")  # the partition number must stay what it was
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    out = dealt.withColumn("__rn", inside).join(F.broadcast(counts), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__rn") + (start - 1)).cast("long")).drop("__part", "__rn", "__before")


def even_sample(df: DataFrame, order: list[Column | str], k: int, name: str = "pos") -> DataFrame:
    """``k`` evenly spaced rows by position from 0: floor(i * step) with step = (n-1)/(k-1) as a double, the last being n-1."""
    n = df.count()
    if not n or k < 1:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    step = (n - 1) / (k - 1) if k > 1 else 0.0
    at = sorted({int(i * step) for i in range(k - 1)} | {n - 1} if k > 1 else {0})
    return number_rows(df, order, name, 0).filter(F.col(name).isin(at))  # k values


def every_nth_pair(df: DataFrame, order: list[Column | str], value: str, m: int) -> DataFrame:
    """Neighbouring pairs sampled at step max(1, n // (m + 1)): pos, a, b for the first ``m`` of them."""
    n = df.count()
    step = max(1, n // (m + 1))
    rows = number_rows(df.select(value, *[c for c in order if isinstance(c, str) and c != value]), order, "pos", 0)
    at = [i for i in range(0, n - 1, step)][:m]
    first = rows.filter(F.col("pos").isin(at)).select("pos", F.col(value).alias("a"))
    second = rows.filter(F.col("pos").isin([i + 1 for i in at])).select((F.col("pos") - 1).alias("pos"), F.col(value).alias("b"))
    return first.join(second, "pos")


def exact_median(df: DataFrame, value: str) -> float | None:
    """The median of a column's non-null values (the mean of the two middle ones)."""
    rows = df.select(value).filter(F.col(value).isNotNull())
    n = rows.count()
    if not n:
        return None
    middle = number_rows(rows, [value], "pos", 0).filter(F.col("pos").isin([(n - 1) // 2, n // 2]))
    return middle.agg(F.avg(value)).first()[0]


def random_sample(df: DataFrame, k: int, keys: list[str], seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, the same in every run: those with the smallest seeded hashes of ``keys``."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(k)


def middle_row(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The row at position n // 2 (from 0) in ``order``; none of an empty table."""
    return number_rows(df, order, "pos", 0).filter(F.col("pos") == df.count() // 2).drop("pos")


def first_rows(df: DataFrame, order: list[Column | str], k: int = 10) -> DataFrame:
    """The first ``k`` rows in ``order``, as a partial top-k a task."""
    return df.orderBy(*order).limit(k)
