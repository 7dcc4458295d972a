"""Mixing sources to target weights by index.

The words of every source form one stream, cut into blocks of fixed length.
Each output shard draws how many blocks it takes from every source
(multinomial over what is still due, so the totals hold exactly), the slots of
a source are numbered through all shards, and slot ``j`` takes block
``perm(j mod blocks)`` of a pseudorandom permutation that belongs to the
source and the epoch.  Slots and blocks then meet in a join on
(source, block).

What reaches the driver is a row per source and the drawn matrix
(sources x output shards).  Stream positions come from (source, bucket) cells,
so a source with a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.text import bound_batches, trim
from skylattice.storage import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
_U = np.uint64


def targets(sizes: dict, weights=(1, 2, 3), limit: float = 3.0) -> dict:
    """Target words by source: by weight, stopped at ``limit`` times the size, the excess reshared by weight.

    Sources are ordered by code point, null last, and take the weights in
    turn; all sizes together are shared out as far as the limits allow.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out: dict = {s: 0.0 for s in names}
    free, left = [s for s in names if sizes[s] > 0], float(sum(sizes.values()))
    while free and left > 0:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > limit * sizes[s]]
        if not full:
            for s in free:
                out[s] = weight[s] * unit
            break
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def draw(totals: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks by (source, output shard): each shard draws from a multinomial over what is still due."""
    rng = np.random.default_rng(seed)
    due = np.array(totals, np.int64)
    out = np.zeros((len(totals), shards), np.int64)
    for k in range(shards):
        n = int(due.sum()) // (shards - k)
        while n:
            take = np.minimum(rng.multinomial(n, due / due.sum()), due)
            out[:, k] += take
            due -= take
            n -= int(take.sum())
    return out


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Places of ``index`` under pseudorandom permutations of 0..n-1: a Feistel network with cycle walking."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (_U(1) << bits) - _U(1)
    x, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        b, m, s = bits[todo], mask[todo], seed[todo].astype(np.uint64)
        lo, hi = x[todo] & m, x[todo] >> b
        for r in range(4):
            f = (lo + s + _U((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> _U(29))) * _U(0x94D049BB133111EB)
            lo, hi = hi ^ ((f ^ (f >> _U(32))) & m), lo
        x[todo] = (hi << b) | lo
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


class Mix:
    """The plan and the tables of one mix of ``docs``.

    Null text has no words; null sources are one source, ordered last.  Rows
    may repeat ids, sources and texts: each row has its own place in its
    source's stream, in the order of hash bucket, id, size and text hash, and
    ``key_col`` (a column that is different in every row) if one is named.
    An empty table gives empty results.  Extra columns of ``docs`` are not
    read here.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        weights=(1, 2, 3),
        limit: int = 3,
        block_words: int = 64,
        output_shards: int = 64,
        buckets: int = 512,
        seed: int = 42,
        key_col: str | None = None,
    ):
        spark = docs.sparkSession
        self.id_col, self.block_words, self.seed = id_col, block_words, seed
        rows = docs.select(
            F.col(id_col).alias("rid"),
            F.col(source_col).cast("string").alias("src"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("digest"),
            (F.lit(0) if key_col is None else F.col(key_col)).cast("long").alias("key"),
        )
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("rid", "size", "digest"), F.lit(buckets)).cast("int"))
        rows = materialize(rows, "mix-rows")
        cells = materialize(rows.groupBy("src", "bucket").agg(F.sum("size").alias("n")), "mix-cells")
        sizes = {r.src: int(r.n) for r in cells.groupBy("src").agg(F.sum("n").alias("n")).collect()}
        self.sources = sorted(sizes, key=lambda s: (s is None, s or ""))
        self.sizes, self.target = sizes, targets(sizes, weights, limit)
        blocks = {s: -(-sizes[s] // block_words) for s in self.sources}
        takes = {s: min(limit * blocks[s], round(self.target[s] * blocks[s] / max(1, sizes[s]))) for s in self.sources}
        counts = draw([takes[s] for s in self.sources], output_shards, seed)
        plan = []
        for i, s in enumerate(self.sources):
            first = 0
            for k in range(output_shards):
                if counts[i, k]:
                    plan.append((i, k, first, int(counts[i, k]), blocks[s]))
                first += int(counts[i, k])
        index = {s: i for i, s in enumerate(self.sources)}
        names = spark.createDataFrame(
            [(s, index[s], sizes[s], float(self.target[s])) for s in self.sources] or [],
            "name string, sid int, source_size long, target double",
        )
        before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = cells.select(F.col("src").alias("c_src"), F.col("bucket").alias("c_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("src", "bucket").orderBy("rid", "size", "digest", "key").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        same = F.col("src").eqNullSafe(F.col("c_src")) & (F.col("bucket") == F.col("c_bucket"))
        # one row a source and bucket, or a source: they are broadcast only if there are few sources
        rows = rows.join(broadcast_if_small(materialize(base, "mix-bases")), same)
        rows = rows.join(broadcast_if_small(materialize(names, "mix-sources")), F.col("src").eqNullSafe(F.col("name")))
        #: key, rid, size, source_size, target, sid and the word position in the source's stream
        self.rows = materialize(
            rows.select("key", "rid", "size", "source_size", "target", "sid", (F.col("base") + F.col("before")).alias("start")), "mix-positions"
        )
        self.slots = self._slots(spark, plan)

    def _slots(self, spark, plan) -> DataFrame:
        """One row per slot: sid, output shard, slot number and block."""
        seed = self.seed
        step = 65536
        cells = spark.createDataFrame(plan, "sid int, out_shard int, first long, n long, blocks long")
        cells = cells.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))).alias("part"))
        spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = cells.repartition(spread, "sid", "out_shard", "part")  # a few rows that become many: keep them apart
        slots = cells.select(
            "sid",
            "out_shard",
            "blocks",
            F.explode(F.expr(f"sequence(first + part * {step}, first + least(n, (part + 1) * {step}) - 1)")).alias("slot"),
        )

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sid, n, slot = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2, 3))
                epoch = slot // np.maximum(n, 1)
                key = (sid * 1000003 + seed).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
                block = permute(slot - epoch * n, n, key)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(block)], ["sid", "out_shard", "slot", "block"])

        return slots.mapInArrow(place, "sid int, out_shard int, slot long, block long")

    def pieces(self) -> DataFrame:
        """key, size, sid, start and the part of each block in it: block, from, to (word numbers of the text), uses."""
        b = self.block_words
        uses = self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
        cut = self.rows.filter("size > 0").select(
            "key",
            "size",
            "sid",
            "start",
            F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")).alias("block"),
        )
        # both sides are made of a few rows that become many, which size estimates do not see: never broadcast
        cut = cut.join(uses.hint("merge"), ["sid", "block"])
        return cut.select(
            "key",
            "size",
            "sid",
            "start",
            "block",
            F.expr(f"greatest(0L, block * {b} - start)").alias("from"),
            F.expr(f"least(size, (block + 1) * {b} - start)").alias("to"),
            "uses",
        )

    def taken(self) -> DataFrame:
        """One row per row of the input: id, size, source_size, target, taken."""
        got = self.pieces().groupBy("sid", "start", "size").agg(F.sum((F.col("to") - F.col("from")) * F.col("uses")).alias("taken"))
        return (
            self.rows.join(got.hint("merge"), ["sid", "start", "size"], "left")
            .select(F.col("rid").alias(self.id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )


def _texts(text: str | None, size: int, blocks: list[dict]) -> list[str]:
    """The text's rows in the mix: row k has the words of the blocks used at least k times."""
    out, words = [], None
    for k in range(1, max(b["uses"] for b in blocks) + 1):
        spans = [(b["from"], b["to"]) for b in blocks if b["uses"] >= k]
        if sum(y - x for x, y in spans) == size:
            out.append(text or "")
        else:
            words = _WORDS.findall(text or "") if words is None else words
            out.append(" ".join(w for x, y in spans for w in words[x:y]))
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document whose blocks are used up to ``r`` times gives ``r`` rows; row
    ``k`` holds the words of the blocks used at least ``k`` times, which is
    the unchanged text where that is all of them.  Documents of which the mix
    takes nothing (so all without words, and with null text) give no row.
    ``n_chars``, if there, follows the text.  Rows are told apart by a number
    of their own, so those that share an id, or have none, each give what the
    mix takes of them.
    """
    bound_batches(docs)
    numbered = materialize(docs.withColumn("__mix_key", F.monotonically_increasing_id()), "mix-input")
    mix = Mix(numbered, id_col, text_col, source_col, key_col="__mix_key", **options)
    used = mix.pieces().groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("from", "to", "uses"))).alias("blocks"))
    used = used.select(F.col("key").alias("__mix_key"), F.col("size").alias("__mix_size"), F.col("blocks").alias("__mix_blocks"))
    columns = docs.columns
    rows = numbered.join(used.hint("merge"), "__mix_key").select(*columns, "__mix_size", "__mix_blocks")
    text_at, chars_at, names = columns.index(text_col), columns.index("n_chars") if "n_chars" in columns else -1, list(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # about a million characters at once
                rows, out, size = [], [], 0
                while at < batch.num_rows and size < 1_000_000:
                    got = _texts(batch.column(text_at)[at].as_py(), batch.column(len(names))[at].as_py(), batch.column(len(names) + 1)[at].as_py())
                    rows += [at] * len(got)
                    out += got
                    size += sum(map(len, got))
                    at += 1
                some = batch.take(pa.array(rows, pa.int32()))
                held = [some.column(i) for i in range(len(names))]
                held[text_at] = pa.array(out, held[text_at].type)
                if chars_at >= 0:
                    held[chars_at] = pa.array([len(t) for t in out], pa.int64()).cast(held[chars_at].type)
                yield pa.RecordBatch.from_arrays(held, names)
            trim()

    return rows.mapInArrow(cut, docs.schema)
