"""Suffix-array deduplication by column-wise construction.

The collection is never sorted as a whole.  Runs of 50-byte windows are routed
by minimizer (see :mod:`skylattice.llm.windows`) in packed blobs, a few bytes a
run.  Where many of a task's runs have one minimizer, only the least and the
greatest id of each content go to its bucket, and the runs wait in salted
groups for what is decided there; what remains are distinct *open contents*: short strings, some of whose
windows may be equal.  Those of a bin are sorted by column-wise
multi-document construction: each round inserts one symbol per string into
the collection's Burrows-Wheeler transform, at the place that the rank of its
symbol gives, and updates the common-prefix array around it.  After the last
round, suffixes whose common prefix reaches the window width are equal
windows.  A round passes once through the arrays of its bin; bins hold a
bounded number of strings, so their arrays need no files.  A minimizer with
more contents than a bin may hold is resolved by counting window hashes
instead, which has no bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.text import blocks, buffers, rolling, trim
from skylattice.llm.windows import PIECE, Windows, byte_units, cut_runs, removed_units
from skylattice.storage import broadcast_if_small, materialize, release

#: Bytes of a routing k-gram.
GRAM = 24
#: Text bytes whose runs share a bucket, open contents of a bin, and contents of one minimizer that a bin takes.
BUCKET_BYTES, BIN, HOT = 3_000_000, 8192, 20_000
_SECOND = 0xA0761D6478BD642F
#: Text bytes cut at once, and runs held before they are packed.
_BLOCK, _HELD = 1 << 18, 150_000
#: Runs of one minimizer that a bucket takes; where a task's share is larger, runs are combined before they are sent, and dealt to salted groups themselves.
HOT_RUNS, _SALTS = 200_000, 1024
#: Text bytes between the starts of two runs, on average.
_RUN_BYTES = 14


def bwt_lcp(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: owner, length, and common prefix with the one before (at most 255).

    Rounds go from the last column to the first.  The list starts with the
    empty suffixes; a string's next suffix cX goes behind all suffixes that
    start with a smaller symbol and behind the suffixes cY for the Ys in front
    of X, which the transform counts.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings])
    rounds = int(lengths.max(initial=0))
    if rounds > 255:
        raise ValueError("strings of at most 255 symbols")
    columns = np.zeros((n, rounds + 1), np.uint8)  # aligned right; 0: the string has ended
    flat = np.concatenate(strings) if n else np.empty(0, np.uint8)
    symbols, dense = np.unique(flat, return_inverse=True)
    if len(symbols) > 255:
        raise ValueError("at most 255 different symbols")
    columns[np.arange(rounds + 1) >= (rounds + 1 - lengths)[:, None]] = dense + 1
    bwt = columns[:, rounds].copy()
    lcp = np.zeros(n, np.uint8)
    owner, size = np.arange(n, dtype=np.int32), np.zeros(n, np.uint8)
    place = np.arange(n)  # of each string's latest suffix
    for t in range(1, rounds + 1):
        live = np.flatnonzero(lengths >= t)
        live = live[np.argsort(place[live], kind="stable")]
        at = place[live]
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        ended = int(np.searchsorted(bwt[order], 1))
        k = rank[at]
        to = n + k - ended
        # common prefixes: one more than the least of the old ones between equal symbols
        padded = np.append(lcp, np.uint8(255))
        before = order[np.maximum(k - 1, 0)]
        same = (k > 0) & (bwt[before] == bwt[at])
        own = np.zeros(len(live), np.int64)
        own[same] = 1 + _range_min(padded, before[same] + 1, at[same] + 1)
        after = order[np.minimum(k + 1, len(bwt) - 1)]
        follows = (k + 1 < len(bwt)) & (bwt[after] == bwt[at])
        nxt = np.zeros(len(live), np.int64)
        nxt[follows] = 1 + _range_min(padded, at[follows] + 1, after[follows] + 1)
        total = len(bwt) + len(live)
        old = np.ones(total, bool)
        old[to] = False
        new = [np.empty(total, x.dtype) for x in (bwt, lcp, owner, size)]
        for x, y in zip(new, (bwt, lcp, owner, size), strict=True):
            x[old] = y
        beside = to + 1
        inside = beside < total
        # the entry behind an inserted one; if that is inserted too, both say the same
        new[1][beside[inside]] = np.where(follows, np.minimum(nxt, 255), 0)[inside]
        new[0][to], new[1][to], new[2][to], new[3][to] = columns[live, rounds - t], np.minimum(own, 255), live, t
        bwt, lcp, owner, size = new
        # suffixes already placed move by the number inserted before them; only the latest are followed
        place[live] = to
    return owner, size, lcp


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], the ranges being in order of ``lo`` and not empty."""
    if not len(lo):
        return np.empty(0, np.int64)
    return np.minimum.reduceat(values, np.stack([lo, hi], axis=1).ravel())[::2].astype(np.int64)


def equal_windows(strings: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) for all windows of ``width``; equal windows share a class."""
    owner, size, lcp = bwt_lcp(strings)
    group = np.cumsum(lcp < width)
    long = size >= width
    lengths = np.array([len(s) for s in strings])
    return owner[long], lengths[owner[long]] - size[long], group[long]


def _least_intervals(strings: list[np.ndarray], ids: np.ndarray, width: int) -> list[list[dict]]:
    """For each string the least id of its windows, as intervals of equal ones."""
    who, start, group = equal_windows(strings, width)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else order
    least = np.empty(len(who), np.int64)
    if len(order):
        low = np.minimum.reduceat(ids[who[order]], first)
        least[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    order = np.lexsort((start, who))
    who, start, least = who[order], start[order], least[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(least) != 0)]) if len(who) else order
    out: list[list[dict]] = [[] for _ in strings]
    for w, j, m, x in zip(who[cut].tolist(), start[cut].tolist(), np.diff(np.append(cut, len(who))).tolist(), least[cut].tolist(), strict=True):
        out[w].append({"j": j, "n": m, "least": x})
    return out


def resolve_bytes(texts: DataFrame, width: int) -> DataFrame:
    """m, c and the least ids of the windows of the open contents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for r in range(batch.num_rows):
                want = batch.column(2).slice(r, 1).flatten()
                start = np.asarray(want.field("start")).astype(np.int64) + off[r]
                end = start + np.asarray(want.field("n")) + width - 1
                cuts = [data[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([want.field("m"), want.field("c"), want.field("id"), pa.array(cuts, pa.binary())], ["m", "c", "id", "s"])

    rows = materialize(texts.mapInArrow(cut, "m long, c long, id long, s binary"), "open-strings")
    release(rows.sparkSession)
    hot = materialize(rows.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HOT).select("m"), "hot-minimizers")
    bins = max(1, math.ceil(rows.count() / BIN))
    cold = rows.join(broadcast_if_small(hot), "m", "left_anti").withColumn("bin", F.pmod(F.xxhash64("m"), F.lit(bins)))
    ids = "array<struct<j:int,n:int,least:long>>"

    def sort(table: pa.Table) -> pa.Table:
        trim()
        data, off = buffers(table.column("s"))
        strings = [data[off[i] : off[i + 1]] for i in range(len(off) - 1)]
        found = _least_intervals(strings, table.column("id").to_numpy(), width)
        kind = pa.list_(pa.struct([("j", pa.int32()), ("n", pa.int32()), ("least", pa.int64())]))
        return pa.table({"m": table.column("m"), "c": table.column("c"), "ids": pa.array(found, kind)})

    out = cold.groupBy("bin").applyInArrow(sort, f"m long, c long, ids {ids}")
    return out.unionByName(_counted(rows.join(broadcast_if_small(hot), "m", "left_semi"), width))


def _counted(rows: DataFrame, width: int) -> DataFrame:
    """The same by counting 128-bit window hashes in Spark."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(3))
            for r in range(batch.num_rows):
                units, _ = byte_units(data[off[r] : off[r + 1]], off)
                h, g = rolling(units, width), rolling(units, width, _SECOND)
                one = [pa.array(np.full(len(h), batch.column(i)[r].as_py(), np.int64)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*one, pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["m", "c", "id", "j", "h", "g"])

    w = rows.select("m", "c", "id", "s").mapInArrow(hashes, "m long, c long, id long, j int, h long, g long")
    least = w.groupBy("h", "g").agg(F.min("id").alias("least"))
    return w.join(least, ["h", "g"]).groupBy("m", "c").agg(F.collect_list(F.struct("j", F.lit(1).alias("n"), "least")).alias("ids"))


_FIELDS = (("m", np.uint64), ("c", np.uint64), ("row", np.uint32), ("start", np.uint32), ("n", np.uint8))


def pack(columns: dict[str, np.ndarray], rk: np.ndarray, ids: np.ndarray) -> bytes:
    """Runs and the texts they are of, column by column; the small ones compressed."""
    used, columns["row"] = np.unique(columns["row"], return_inverse=True)
    parts = [columns[k].astype(t) for k, t in _FIELDS]
    # the bucket and 48 bits of the minimizer, and the whole content hash, identify a run
    low = (parts[0] & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
    # differences and byte planes compress best
    small = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (np.diff(parts[2], prepend=np.uint32(0)), parts[3], parts[4]))
    small += rk[used].astype(np.int64).tobytes() + ids[used].astype(np.int64).tobytes()
    head = np.array([len(parts[0]), len(used)], np.int64).tobytes()
    return head + low.tobytes() + parts[1].tobytes() + zstandard.ZstdCompressor(1).compress(small)


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    n, k = np.frombuffer(blob, np.int64, 2)
    m = np.zeros((n, 8), np.uint8)
    m[:, :6] = np.frombuffer(blob, np.uint8, n * 6, 16).reshape(-1, 6)
    small = zstandard.ZstdDecompressor().decompress(blob[16 + 14 * n :], int(9 * n + 16 * k))
    plane = lambda at, w, t: np.ascontiguousarray(np.frombuffer(small, np.uint8, n * w, at).reshape(w, n).T).view(t).ravel()
    out = {"m": m.view(np.uint64).ravel(), "c": np.frombuffer(blob[16 + 6 * n : 16 + 14 * n], np.uint64)}
    out |= {"row": np.cumsum(plane(0, 4, np.uint32), dtype=np.uint32).astype(np.int64), "start": plane(4 * n, 4, np.uint32), "n": plane(8 * n, 1, np.uint8)}
    both = np.frombuffer(small, np.int64, 2 * k, 9 * n)
    return out, both[:k], both[k:]


class ByteWindows(Windows):
    """Windows of bytes, whose many runs travel packed."""

    def shared_runs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        width, k = self.width, self.k
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # a bucket is named by the first bits of a minimizer, as many as keep it small
        bits = min(31, max(4, math.ceil(math.log2(max(1, total) / BUCKET_BYTES))))
        # a minimizer that no full batch finds frequent has about HOT_RUNS at most, whatever the input
        hot_runs = max(1, HOT_RUNS * _HELD * _RUN_BYTES // max(1, total))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rk, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                data, off = buffers(batch.column(2))
                held, size = [], 0
                for i, j in blocks(off, _BLOCK):
                    values, bounds = byte_units(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    for lo in range(0, max(1, len(values)), PIECE):
                        part = values[lo : lo + PIECE + width - 1]
                        inside = bounds if j - i > 1 or len(values) <= PIECE else np.array([0, len(part)])
                        text, start, n, m, c = cut_runs(part, inside, width, k)
                        held.append((i + text, start + lo, n.astype(np.uint8), m, c))
                        size += len(text)
                    if size > _HELD or (j == batch.num_rows and size):
                        yield _blobs(held, rk, ids, bits, hot_runs)
                        held, size = [], 0
                trim()

        blobs = self.rows.select("rk", "id", "text").mapInArrow(cut, "bucket long, blob binary")

        def decide(table: pa.Table) -> pa.Table:
            trim()
            bucket = int(table.column("bucket")[0].as_py())
            parts = [unpack(b) for b in table.column("blob").to_pylist()]
            name = np.uint64((bucket & ((1 << bits) - 1)) << (64 - bits))
            return _decide(name, parts) if bucket < 1 << bits else _held(name, parts)

        found = blobs.groupBy("bucket").applyInArrow(decide, "kind byte, m long, c long, id long, rk long, start int, n int, starts array<int>, counts array<int>")
        found = materialize(found, "byte-runs")
        release(found.sparkSession)
        spans = F.transform(F.arrays_zip("starts", "counts"), lambda x: F.struct(x["starts"].alias("start"), (F.call_function("shiftleft", F.lit(1).cast("long"), x["counts"]) - 1).alias("mask")))
        whole = found.filter("kind = 0").select("rk", "id", spans.alias("spans"))
        contents = found.filter("kind = 1").select("m", "c", "id", "rk", "start", "n")
        # what was decided of frequent minimizers goes to their runs
        said = materialize(found.filter("kind = 3").select("m", F.col("id").alias("least"), (F.col("n") > 0).alias("open")), "hot-minimizer-answers")
        hot = found.filter("kind = 4").select("m", "c", "id", "rk", "start", "n").join(broadcast_if_small(said), "m")
        one = F.array(F.struct("start", F.expr("shiftleft(1L, n) - 1").alias("mask")))
        whole = whole.unionByName(hot.filter("not open and least < id").select("rk", "id", one.alias("spans")))
        some = found.filter("kind in (1, 2)").select("m", "c", "id", "rk", "start")
        return whole, contents, some.unionByName(hot.filter("open").select("m", "c", "id", "rk", "start"))


def _combined(m: np.ndarray, c: np.ndarray, own: np.ndarray, start: np.ndarray, hot_runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have one of the minimizers that ``hot_runs`` or more have, and which of these speak for their content: those of the least and of the greatest id."""
    _, group, count = np.unique(m, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(count[group] >= hot_runs)
    order = hot[np.lexsort((start[hot], own[hot], c[hot], m[hot]))]
    new = np.ones(len(order), bool)
    new[1:] = (m[order][1:] != m[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1 if len(order) else first
    return hot, order[np.unique(np.concatenate([first, last]))]


def _blobs(held: list, rk: np.ndarray, ids: np.ndarray, bits: int, hot_runs: int) -> pa.RecordBatch:
    """Packed runs by bucket.  Runs of frequent minimizers go to a salted group of their bucket; in the bucket itself few speak for them."""
    row, start, n, m, c = (np.concatenate([h[i] for h in held]) for i in range(5))
    bucket = (m >> np.uint64(64 - bits)).astype(np.int64)
    hot, speak = _combined(m, c, ids[row], start, hot_runs)
    if len(hot):
        salted = bucket.copy()
        salted[hot] |= (1 + int(rk[row[hot[0]]]) % _SALTS) << bits
        row, start, n, m, c = (np.concatenate([x, x[speak]]) for x in (row, start, n, m, c))
        n[len(salted) :] |= 128
        bucket = np.concatenate([salted, bucket[speak]])
    order = np.lexsort((row, bucket))
    row, start, n, m, c, bucket = (x[order] for x in (row, start, n, m, c, bucket))
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True])
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        blobs.append(pack({"m": m[a:b], "c": c[a:b], "row": row[a:b], "start": start[a:b], "n": n[a:b]}, rk, ids))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _joined(parts: list) -> tuple[np.ndarray, ...]:
    """rk and id of the texts, and m, c, start, n and text of the runs, of unpacked blobs."""
    shift = np.cumsum([0] + [len(p[1]) for p in parts])
    rk, ids = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    m, c, start, n = (np.concatenate([p[0][k] for p in parts]) for k in ("m", "c", "start", "n"))
    return rk, ids, m, c, start, n, np.concatenate([p[0]["row"] + s for p, s in zip(parts, shift, strict=False)])


def _rows(kind: np.ndarray, m: np.ndarray, c: np.ndarray, ids: np.ndarray, rk: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    lists = pa.nulls(len(kind), pa.list_(pa.int32()))
    columns = {"kind": pa.array(kind.astype(np.int8)), "m": pa.array(m.view(np.int64)), "c": pa.array(c.view(np.int64)), "id": pa.array(ids), "rk": pa.array(rk), "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32))}
    return pa.table(columns | {"starts": lists, "counts": lists})


def _held(name: np.uint64, parts: list) -> pa.Table:
    """Kind 4: runs that wait for what is decided of their minimizer."""
    rk, ids, m, c, start, n, row = _joined(parts)
    return _rows(np.full(len(m), 4), m | name, c, ids[row], rk[row], start, n)


def _decide(name: np.uint64, parts: list) -> pa.Table:
    """What the runs of a bucket say: kind 0 spans of a text that go, 1 an open content, 2 another run that has it, 3 least id and whether contents are open for a frequent minimizer."""
    rk, ids, m, c, start, n, row = _joined(parts)
    hot, n = n >> 7 == 1, n & 127
    order = np.argsort(m, kind="stable")
    ms = m[order]
    first = np.flatnonzero(np.r_[True, ms[1:] != ms[:-1]])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ms))))
    own = ids[row[order]]
    least, most = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    cs = c[order]
    several = np.minimum.reduceat(cs, first) != np.maximum.reduceat(cs, first)
    shared = least < most
    said = np.flatnonzero(shared & np.logical_or.reduceat(hot[order], first))
    gone = order[(shared & ~several)[group] & (least[group] < own)]
    gone = gone[np.argsort(row[gone], kind="stable")]
    cut = np.flatnonzero(np.r_[True, np.diff(row[gone]) != 0]) if len(gone) else np.empty(0, np.int64)
    # open: the least (id, start) of each content stands for it
    some = order[(shared & several)[group]]
    some = some[np.lexsort((start[some], ids[row[some]], c[some], m[some]))]
    lead = np.ones(len(some), bool)
    lead[1:] = (m[some][1:] != m[some][:-1]) | (c[some][1:] != c[some][:-1])
    k = len(cut)
    lists = [pa.ListArray.from_arrays(pa.array(np.append(cut, len(gone)).astype(np.int32)), pa.array(x[gone].astype(np.int32))) for x in (start, n)] if k else [pa.array([], pa.list_(pa.int32()))] * 2
    none = lambda kind: pa.nulls(k, kind)
    spans = pa.table({"kind": pa.array(np.zeros(k, np.int8)), "m": none(pa.int64()), "c": none(pa.int64()), "id": pa.array(ids[row[gone[cut]]]), "rk": pa.array(rk[row[gone[cut]]]), "start": none(pa.int32()), "n": none(pa.int32()), "starts": lists[0], "counts": lists[1]})
    open_ = _rows(np.where(lead, 1, 2), m[some] | name, c[some], ids[row[some]], rk[row[some]], start[some], n[some])
    zero = np.zeros(len(said), np.int64)
    answers = _rows(np.full(len(said), 3), ms[first[said]] | name, zero.view(np.uint64), least[said], zero, zero, several[said])
    return pa.concat_tables([spans, open_, answers])


def _kernel(width: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in blocks(off, _BLOCK):
                part, bounds = data[off[i] : off[j]], off[i : j + 1] - off[i]
                gone = removed_units(batch.column(2).slice(i, j - i), bounds, width)
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                inner = bounds[:-1][bounds[:-1] < len(part)]
                rise[inner] = gone[inner]  # a run ends with its text
                removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (gone, rise))
                kept = [part[a:b][~gone[a:b]].tobytes() if x else part[a:b].tobytes() for a, b, x in zip(bounds[:-1], bounds[1:], removed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
                    ["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )
            trim()

    return finish


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    A byte goes if a string of ``width`` bytes that covers it also starts in a
    row with a smaller id, judged on the input.  For nulls, repeated rows and
    ties see :class:`Windows`; texts shorter than the width keep everything;
    an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = ByteWindows(docs, id_col, text_col, byte_units, resolve_bytes, width, min(GRAM, width))
    out = found.finish(_kernel(width), f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("own", id_col)
