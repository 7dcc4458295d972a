"""Substring deduplication over word windows.

Runs of windows are routed by minimizer (see :mod:`skylattice.llm.windows`);
the windows of open contents are hashed by Rabin-Karp and counted in Spark,
and repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.text import blocks, buffers, rolling, word_bounds, word_hashes
from skylattice.llm.windows import Windows, removed_units, word_units

#: Words of a routing k-gram.
GRAM = 10
_SECOND = 0xA0761D6478BD642F


def count_windows(texts: DataFrame, width: int) -> DataFrame:
    """m, c and the least id of each window of the open contents, by a 128-bit Rabin-Karp hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for r in range(batch.num_rows):
                text = data[off[r] : off[r + 1]]
                starts, ends, _ = word_bounds(text, np.array([0, len(text)]))
                words = word_hashes(text, starts, ends)
                h, g = rolling(words, width), rolling(words, width, _SECOND)
                want = batch.column(2).slice(r, 1).flatten()
                m, c, ids, start, n = (np.asarray(want.field(i)).astype(np.int64) for i in range(5))
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(start, n) + j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.repeat(m, n), np.repeat(c, n), np.repeat(ids, n), j.astype(np.int32), h[at].view(np.int64), g[at].view(np.int64))],
                    ["m", "c", "id", "j", "h", "g"],
                )

    rows = texts.mapInArrow(hashes, "m long, c long, id long, j int, h long, g long")
    # counted and found again in one exchange, so texts are hashed once: every column is used on both sides
    rows = rows.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "g")
    least = rows.groupBy("h", "g").agg(F.min(F.struct("id", "m", "c", "j")).alias("first"))
    hit = rows.join(least.select("h", "g", F.col("first.id").alias("least")), ["h", "g"]).groupBy("m", "c")
    return hit.agg(F.collect_list(F.struct("j", F.lit(1).alias("n"), "least")).alias("ids"))  # a run's windows


def _kernel(width: int):
    def block(batch: pa.RecordBatch, data: np.ndarray, off: np.ndarray, i: int, j: int) -> pa.RecordBatch:
        part, bounds = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, at = word_bounds(part, bounds)
        gone = removed_units(batch.column(2).slice(i, j - i), at, width)
        # bytes of kept words, each followed by one space unless it is its text's last
        edge = np.zeros(len(part) + 2, np.int8)
        stay = ~gone
        np.add.at(edge, starts[stay], 1)
        np.add.at(edge, ends[stay], -1)
        keep = np.cumsum(edge[: len(part)], dtype=np.int8) > 0
        out = part.copy()
        text = np.repeat(np.arange(j - i), np.diff(at))[stay]
        tail = np.ones(len(text), bool)
        tail[:-1] = text[1:] != text[:-1]
        gap = ends[stay][~tail]
        out[gap] = 0x20
        keep[gap] = True
        before = np.concatenate([[0], np.cumsum(keep)])[bounds]
        packed = memoryview(out[keep])
        kept = [packed[before[r] : before[r + 1]] for r in range(j - i)]
        sums = np.concatenate([[0], np.cumsum(gone)])[at]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(i, j - i),
                pa.array(np.diff(at)),
                pa.array(np.diff(sums)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array(list(map(bytes, kept)), pa.binary()).cast(pa.string()),
            ],
            ["own", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off):
                yield block(batch, data, off, i, j)

    return finish


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, kept.

    A word goes if a window of ``width`` words that covers it also starts in a
    row with a smaller id, judged on the input.  Kept words are joined by one
    space.  For nulls, repeated rows and ties see :class:`Windows`; texts
    shorter than the window keep everything; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = Windows(docs, id_col, text_col, word_units, count_windows, width, min(GRAM, width))
    out = found.finish(_kernel(width), f"own {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumnRenamed("own", id_col)
