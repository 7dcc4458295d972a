"""Windows of fixed width that also start in a document with a smaller id.

Every window is routed by its minimizer: the least hash among the k-grams in
it.  Equal windows have equal minimizers, and neighbouring windows mostly
share one, so a *run* of windows (about half the span of k-grams) travels as
one row.  Three exact steps follow:

1. minimizers that occur under one id only are dropped: none of their windows
   can repeat elsewhere;
2. where all runs of a minimizer have one content, the least id decides for
   all their windows at once;
3. the other, *open* contents are few: each distinct one is fetched once, a
   resolver finds which of their windows are equal, and the least id of each
   window goes back to the runs.

All counts are aggregations with map-side combining; no group of copies meets
in one task, and nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.text import BLOCK, blocks, bound_batches, buffers, mix, powers, rolling, word_bounds, word_hashes
from skylattice.storage import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, materialize, release

_POS = np.uint64((1 << 24) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CONTENT_BASE = 0xD1342543DE82EF95
#: Rows of at most this many units are cut at once; longer texts in overlapping pieces.
PIECE = 1 << 22


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as units."""
    return _BYTE[data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as units."""
    starts, ends, at = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), at


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def cut_runs(values: np.ndarray, bounds: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text number, start in the text, windows, minimizer, content hash."""
    n = len(values)
    counts = np.diff(bounds) - width + 1
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    grams = rolling(values, k)
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(key, width - k + 1)  # one for each window start of the block
    # window starts that stay inside their text
    total = counts[rows]
    first = np.repeat(bounds[rows], total)
    inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    at = first + inner
    spot = (least[at] & _POS).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (inner[1:] == 0)
    new = np.flatnonzero(new)
    windows = np.diff(np.append(new, len(at)))
    start = at[new]
    up, down = powers(n, _CONTENT_BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    length = windows + width - 1
    content = mix((sums[start + length] - sums[start]) * down[start] + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    text = np.repeat(rows, total)[new]
    return text, inner[new], windows, grams[spot[new]], content


class Windows:
    """Which windows of ``docs`` also start under a smaller id.

    ``units`` cuts texts into units; ``resolve`` gets the open contents and
    returns the least id of each of their windows.  Null text counts as
    empty.  A null id counts as larger than any other.  Rows that repeat an
    id never remove each other's windows; rows that repeat id and text get
    the same answer.  Other columns are not read.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, units: Callable, resolve: Callable, width: int, k: int):
        self.units, self.resolve, self.width, self.k = units, resolve, width, k
        bound_batches(docs)
        if width - k + 1 > 62:
            raise ValueError("a run's windows must fit a 63-bit mask")
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.rows = docs.select(
            F.xxhash64(id_col, text).alias("rk"),
            F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
            F.col(id_col).alias("own"),
            text.alias("text"),
        )

    def runs(self) -> DataFrame:
        """m, c, id, rk, start, n for every run of every text."""
        units, width, k = self.units, self.width, self.k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rk, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                data, off = buffers(batch.column(2))
                for i, j in blocks(off):
                    values, bounds = units(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    for lo in range(0, max(1, len(values)), PIECE):  # more than one piece only for one long text
                        part = values[lo : lo + PIECE + width - 1]
                        inside = bounds if j - i > 1 or len(values) <= PIECE else np.array([0, len(part)])
                        text, start, n, m, c = cut_runs(part, inside, width, k)
                        if len(text):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(x) for x in (m.view(np.int64), c.view(np.int64), ids[i + text], rk[i + text], (start + lo).astype(np.int32), n.astype(np.int32))],
                                ["m", "c", "id", "rk", "start", "n"],
                            )

        return self.rows.select("rk", "id", "text").mapInArrow(cut, "m long, c long, id long, rk long, start int, n int")

    def shared_runs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(whole, contents, open): spans decided at once; distinct open contents; and the runs that have them.

        A text is known by its hash and its id together.
        """
        runs = materialize(self.runs(), "runs")
        shared = runs.groupBy("m").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("id").alias("least"), F.max("id").alias("most"))
        shared = materialize(shared.filter("least < most").select("m", "least", (F.col("c0") != F.col("c1")).alias("open")), "shared")
        runs = materialize(runs.join(broadcast_if_small(shared), "m"), "shared-runs")
        whole = runs.filter("not open and least < id").select("rk", "id", F.array(F.struct("start", F.expr("shiftleft(1L, n) - 1").alias("mask"))).alias("spans"))
        some = runs.filter("open")
        contents = some.groupBy("m", "c").agg(F.min(F.struct("id", "rk", "start", "n")).alias("r")).select("m", "c", "r.*")
        return whole, contents, some.select("m", "c", "id", "rk", "start")

    def repeated(self) -> DataFrame:
        """rk, id, spans: the windows to remove of each text, as (start, mask of windows from there)."""
        whole, contents, some = self.shared_runs()
        wanted = contents.groupBy("rk", F.col("id").alias("of")).agg(F.collect_list(F.struct("m", "c", "id", "start", "n")).alias("want"))
        wanted = materialize(wanted.withColumnRenamed("of", "id"), "open-contents")
        release(wanted.sparkSession)  # what was shuffled so far is written: its files go before more come
        texts = self.rows.select("rk", "id", "text").join(broadcast_if_small(wanted), ["rk", "id"]).select("rk", "text", "want")
        # m, c and ids: (j, n, least) for the windows j..j+n-1 of the content
        least = materialize(self.resolve(texts, self.width), "open-windows")
        release(least.sparkSession)
        hit = some.join(broadcast_if_small(least), ["m", "c"])
        bits = lambda x: F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), x["n"]) - 1, x["j"])
        mask = F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: F.when(x["least"] < F.col("id"), acc.bitwiseOR(bits(x))).otherwise(acc))
        part = hit.select("rk", "id", "start", mask.alias("mask")).filter("mask <> 0").select("rk", "id", F.array(F.struct("start", "mask")).alias("spans"))
        # a set: rows that repeat id and text say the same
        return whole.unionByName(part).groupBy("rk", "id").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def finish(self, kernel: Callable, schema: str) -> DataFrame:
        """``kernel`` over batches (id, text, spans), spans being null where nothing goes.

        Texts that keep everything are not shuffled while the keys of the
        others are few enough to broadcast; beyond that one join shuffles all.
        """
        spans = materialize(self.repeated(), "spans")
        release(spans.sparkSession)
        rows = self.rows.select("rk", "id", "own", "text")
        keys = spans.select("rk", "id")
        if estimated_bytes(keys) > BROADCAST_BYTES:
            return rows.join(spans, ["rk", "id"], "left").select("own", "text", "spans").mapInArrow(kernel, schema)
        hit = F.broadcast(keys)
        none = F.lit(None).cast(spans.schema["spans"].dataType)
        clean = rows.join(hit, ["rk", "id"], "left_anti").select("own", "text", none.alias("spans"))
        dirty = rows.join(hit, ["rk", "id"], "left_semi").join(spans, ["rk", "id"]).select("own", "text", "spans")
        return clean.unionByName(dirty).mapInArrow(kernel, schema)


def removed_units(spans: pa.Array, units: np.ndarray, width: int) -> np.ndarray:
    """Which units of a block go; ``units`` are the texts' bounds among the units."""
    if isinstance(spans, pa.ChunkedArray):
        spans = spans.combine_chunks()
    total = int(units[-1])
    if not len(spans) or spans.null_count == len(spans):
        return np.zeros(total, bool)
    flat = spans.flatten()
    lengths = np.diff(np.asarray(spans.offsets)) * np.asarray(spans.is_valid())
    text = np.repeat(np.arange(len(spans)), lengths)
    start = units[text] + np.asarray(flat.field("start")).astype(np.int64)
    mask = np.asarray(flat.field("mask")).astype(np.uint64)
    size = total + width + 64
    solid = (mask & (mask + np.uint64(1))) == 0  # the lowest bits only: one interval
    n = np.bitwise_count(mask[solid]).astype(np.int64)
    edge = np.bincount(start[solid], minlength=size) - np.bincount(start[solid] + n - 1 + width, minlength=size)
    start, mask = start[~solid], mask[~solid]
    # of other masks every run of set bits is an interval
    up, down = (mask & ~(mask << np.uint64(1)), mask & ~(mask >> np.uint64(1)))
    for lo in range(0, len(mask), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        first, last = _set_bits(start[part], up[part]), _set_bits(start[part], down[part])
        edge += np.bincount(first, minlength=size) - np.bincount(last + width, minlength=size)
    return np.cumsum(edge[:total]) > 0


def _set_bits(start: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The places of all set bits, ``start`` being that of the lowest."""
    bits = np.unpackbits(mask.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(bits)
    return start[row] + bit
