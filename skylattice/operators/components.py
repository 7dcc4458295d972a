"""Connected components by alternating large-star and small-star rounds.

Each round is two map-side combined minimum aggregations and two joins; the
edge table is written to the shared folder after each round, so lineage stays
flat and a lost executor costs one round.  Rounds grow with the logarithm of
the longest path, not with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skylattice.storage import drop, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table.

    ``component`` is the smallest node reachable.  Rows with a null end are
    ignored, self-loops keep their node, repeated edges count once, an empty
    table gives an empty result; other columns are not read.
    """
    valid = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e, stamp = _written(valid.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    for _ in range(max_rounds):
        nxt, new = _written(_small_star(_large_star(e)))
        drop(e)
        e = nxt
        if new == stamp:
            break
        stamp = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = e.filter("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.unionByName(e.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    loops = sym.filter("u = v")
    return (
        sym.filter("v > u")
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(loops)
    )


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written to the shared folder, and their count and hash, which are taken on the way."""
    seen = Observation()
    e = e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    e = materialize(e, "cc")
    found = seen.get
    return e, (found.get("n", 0), found.get("h"))
