"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row hashes to a ring slot and
belongs to the next point clockwise.  A shard has a capacity in rows, and rows
beyond it continue clockwise to the next point whose shard has room.  With
capacities that add up to the number of rows (``epsilon=0``), counts are at
most one apart; with more room fewer rows move.

Only counts by ring arc reach the driver (shards x vnodes numbers, whatever
the input).  A row finds its place from its rank within its arc, and ranks
come from (arc, salt) cells, so an arc that holds a third of all rows is
ranked by ``salts`` tasks side by side.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.storage import materialize

SLOT_BITS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise; every shard's points depend on its number alone."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            k = 0
            while True:  # probe on until the slot is free
                digest = hashlib.sha256(f"{shard}/{v}/{k}".encode()).digest()
                slot = int.from_bytes(digest[:8], "big") >> (64 - SLOT_BITS)
                if slot not in taken:
                    break
                k += 1
            taken[slot] = shard
    return sorted(taken.items())


def place(points: list[tuple[int, int]], counts: dict[int, int], shards: int, epsilon: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from, to, shard, first slot): ranks from..to-1 of an arc go to a shard.

    All arcs offer their rows to their own shard first, in ring order; what
    does not fit goes on clockwise, again in ring order, step by step.
    """
    total = sum(counts.values())
    if epsilon:
        room = [math.ceil((1 + epsilon) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    waiting = [(arc, 0, counts[arc]) for arc in range(len(points)) if counts.get(arc)]
    pieces, step = [], 0
    while waiting:
        left = []
        for arc, lo, hi in waiting:
            shard = points[(arc + step) % len(points)][1]
            n = min(hi - lo, room[shard] - filled[shard])
            if n:
                pieces.append((arc, lo, lo + n, shard, filled[shard]))
                filled[shard] += n
            if lo + n < hi:
                left.append((arc, lo + n, hi))
        waiting, step = left, step + 1
    return pieces


def shard_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    vnodes: int = 32,
    salts: int = 128,
    epsilon: float = 0.0,
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 8; null text has none and counts
    as empty.  The ring point comes from the text, so equal texts start from
    one point and part only where a shard is full.  Slots run from 0 without
    gaps in every shard.  Ties of equal rows are broken by id, then size; rows
    that repeat both are interchangeable.  A null id sorts first.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    slots = [p[0] for p in points]
    arcs = [(s, bisect_left(slots, s) % len(points)) for s in range(1 << SLOT_BITS)]
    arc_of = spark.createDataFrame(arcs, "ring_slot int, arc int")  # 65,536 rows, whatever the input
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("rid"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("point"),
    )
    rows = rows.withColumn("ring_slot", F.shiftrightunsigned("point", 64 - SLOT_BITS).cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rid", "point"), F.lit(salts)).cast("int"))
    rows = materialize(rows.join(F.broadcast(arc_of), "ring_slot").drop("ring_slot"), "ring-rows")

    cells = rows.groupBy("arc", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(cells, "ring-cells")  # arcs x salts rows at most
    counts = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("arc", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    pieces = place(points, counts, shards, epsilon)
    piece = spark.createDataFrame(pieces, "p_arc int, lo long, hi long, shard int, first long")
    order = Window.partitionBy("arc", "salt").orderBy("point", "rid", "size")
    ranked = rows.withColumn("rn", F.row_number().over(order))
    ranked = ranked.join(F.broadcast(base), ["arc", "salt"]).withColumn("rank", F.col("base") + F.col("rn") - 1)
    here = (F.col("arc") == F.col("p_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(piece), here).select(
        F.col("rid").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
    )
