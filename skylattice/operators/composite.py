"""Compositing of layers on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_valid(layers: DataFrame, pixel: list[str], rank: str, value: str, valid: str) -> DataFrame:
    """pixel columns, layer, value: each pixel takes the first layer by rank that is valid there; ties to the smaller value."""
    hit = layers.filter(F.col(valid))
    best = hit.groupBy(*pixel).agg(F.min(F.struct(F.col(rank).alias("layer"), F.col(value).alias("value"))).alias("b"))
    return best.select(*pixel, "b.*")


def overlay(base: DataFrame, top: DataFrame, pixel: list[str], value: str = "value") -> DataFrame:
    """The top's value where it has one, else the base's."""
    over = top.select(*pixel, F.col(value).alias("__top"))
    out = base.join(over, pixel, "left")
    return out.withColumn(value, F.coalesce("__top", value)).drop("__top")


def coverage(layers: DataFrame, pixel: list[str], rank: str, valid: str, own: int = 0) -> DataFrame:
    """One row: pixels, covered by the own layer, covered by any, and both as fractions."""
    per = layers.groupBy(*pixel).agg(F.max((F.col(valid) & (F.col(rank) <= own)).cast("int")).alias("own"), F.max(F.col(valid).cast("int")).alias("any"))
    out = per.agg(F.count(F.lit(1)).alias("pixels"), F.sum("own").alias("own"), F.sum("any").alias("any"))
    return out.select("pixels", "own", "any", (F.col("own") / F.col("pixels")).alias("before"), (F.col("any") / F.col("pixels")).alias("after"))
