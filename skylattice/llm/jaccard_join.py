"""Exact Jaccard self-join on word shingles.

1. Candidates come from keys that similar sets must share.  Shingles have one
   order, by hash.  A set of ``n`` sends its first ``n - ceil((2t - 1) n) + 1``
   shingles, ``e`` more than a prefix needs for threshold ``t``; so similar
   sets share more of them than either has to spare (``e = ceil(t n) -
   ceil((2t - 1) n)``, and ``ceil(t n) - e`` never falls with ``n``).  How
   many sets sent a key is then counted, and every set takes back the ``e``
   that most others sent, by one order of all keys: similar sets still share
   one that both keep.  Passages, licences and common phrases go that way,
   unless they make up half of a text.  Documents that share a key form
   candidate blocks.
2. Blocks are cut into tiles by size band and hash.  Tiles whose bands can
   hold partners meet: bitmaps of hashed shingles bound the overlap from
   above, and what passes is decided by intersecting sorted arrays.  Pairs
   already connected inside the tile need no check, so a tile returns at most
   one link a document.
3. Links and equal sets give components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.text import blocks, bound_batches, buffers, mix, rolling, trim, word_bounds, word_hashes
from skylattice.operators.components import connected_components
from skylattice.storage import broadcast_if_small, materialize

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a block, and their bounds."""
    starts, ends, at = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    counts = np.diff(at)
    n = len(counts)
    per = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(bounds[-1], np.uint64)
    grams = rolling(h, words)
    full = np.flatnonzero(counts >= words)
    if len(full):
        total = per[full]
        inner = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        out[np.repeat(bounds[full], total) + inner] = grams[np.repeat(at[full], total) + inner]
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        x = _U(int(counts[i]))
        for w in h[at[i] : at[i + 1]]:
            x = mix(np.array([x]) * _U(0x9E3779B97F4A7C15) + w)[0]
        out[bounds[i]] = x
    for i in range(n):
        out[bounds[i] : bounds[i + 1]].sort()
    doc = np.repeat(np.arange(n), per)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def prefix_sizes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles sets of ``n`` send as keys, and how many of them they may take back."""
    need = -(-percent * n // 100)
    rest = np.maximum(1, -(-(2 * percent - 100) * n // 100))
    return n - rest + 1, need - rest


def prefix_keys(sets: np.ndarray, bounds: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, keys to spare) of the first shingles by hash of the chosen rows' sets, which must not be empty."""
    sizes = np.diff(bounds)[rows]
    first = np.cumsum(sizes) - sizes
    at = np.repeat(bounds[rows] - first, sizes) + np.arange(sizes.sum())
    token, owner = mix(sets[at] + _U(5)), np.repeat(np.arange(len(rows)), sizes)
    order = np.lexsort((token, owner))
    take, spare = prefix_sizes(sizes, percent)
    use = order[np.arange(len(at)) - np.repeat(first, sizes) < np.repeat(take, sizes)]
    return rows[owner[use]], token[use], spare[owner[use]]


def bitmaps(sets: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """One row of ``bits`` hashed bits a set, packed into 64-bit words."""
    n = len(bounds) - 1
    out = np.zeros((n, bits), bool)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    out[doc, (mix(sets + _U(77)) % _U(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union|, by sorted arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def tile_links(ids: np.ndarray, sides: list, sets: list[np.ndarray], maps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What the links of a tile connect, as (smallest id, other id); rows of one side meet only where there is a single side."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    single = len(set(sides)) == 1
    sorted_sizes, sorted_maps, sorted_sides = sizes[order], maps[order], np.asarray(sides)[order]
    roots = np.arange(len(ids))  # of the sorted rows, kept up to date
    for k in range(1, len(order)):
        n = sorted_sizes[k]
        lo = int(np.searchsorted(100 * sorted_sizes[:k], percent * n))
        if lo == k:
            continue
        ok = roots[lo:k] != roots[k]
        if not single:
            ok &= sorted_sides[lo:k] != sorted_sides[k]
        near = np.flatnonzero(ok) + lo
        if not len(near):
            continue
        only = np.bitwise_count(sorted_maps[k] & ~sorted_maps[near]).sum(axis=1, dtype=np.int64)
        back = np.bitwise_count(sorted_maps[near] & ~sorted_maps[k]).sum(axis=1, dtype=np.int64)
        m = sorted_sizes[near]
        most = np.minimum(n - only, m - back)
        near = near[100 * most >= percent * (n + m - most)]
        for j in near[::-1]:
            if roots[j] != roots[k] and similar(sets[order[j]], sets[order[k]], percent):
                roots[roots == roots[k]] = roots[j]
    names = np.asarray(ids)[order]
    group = np.unique(roots, return_inverse=True)[1]
    least = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(least, group, names)
    far = least[group] != names
    return list(zip(least[group][far].tolist(), names[far].tolist(), strict=True))


def _set_rows(batch: pa.RecordBatch, column: int, words: int):
    data, off = buffers(batch.column(column))
    for i, j in blocks(off, 1 << 18):
        sets, bounds = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], words)
        yield i, sets, bounds
    trim()


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    percent: int = 90,
    tile: int = 256,
    bits: int = 2048,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Texts are lower-cased on A-Z; with fewer than ``words`` words the whole
    sequence is one shingle.  A row without words, or with null text, links
    with nothing and is its own component.  A null id takes no part in links
    and has a null component.  Rows that share an id are one document.  An
    empty table gives none; other columns are not read.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            keys, out = [], []
            # equal sets of a batch speak once, by their smallest id
            seen: dict[tuple[int, int], int] = {}
            least: list[int] = []
            for i, sets, bounds in _set_rows(batch, 1, words):
                n = np.diff(bounds)
                token = mix(sets + _U(11))
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(t)]) for t in (token, mix(token))]
                f, g = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                out.append((0, ids[i : i + len(n)], n, f, g, valid[i : i + len(n)]))
                first, number = np.zeros(len(n), bool), np.zeros(len(n), np.int64)
                for r in np.flatnonzero(valid[i : i + len(n)]).tolist():
                    k = seen.setdefault((f[r], g[r]), len(least))
                    if k == len(least):
                        first[r] = True
                        least.append(ids[i + r])
                    number[r], least[k] = k, min(least[k], ids[i + r])
                use = np.flatnonzero(first & (n > 0))
                if len(use):
                    who, key, spare = prefix_keys(sets, bounds, use, percent)
                    keys.append((number[who], key, spare))
            yield from (_table(*x) for x in out)
            for who, key, spare in keys:
                yield _table(1, np.array(least, np.int64)[who], spare, key.view(np.int64), None, None)

    schema = "kind byte, id long, n long, f long, g long"
    found = materialize(rows.mapInArrow(signatures, schema), "shingle-parts")
    sizes = found.filter("kind = 0").select("id", "n", "f", "g")
    classes = materialize(sizes.filter("n > 0 and id is not null").groupBy("n", "f", "g").agg(F.min("id").alias("rep")), "shingle-classes")

    edges = _candidates(found.filter("kind = 1").select("id", F.col("n").alias("spare"), "f"))
    block = connected_components(materialize(edges, "shingle-candidates"))
    members = block.join(classes.select(F.col("rep").alias("node"), F.col("n")), "node").select(F.col("node").alias("id"), F.col("component").alias("block"), "n")
    tiles = _tiles(materialize(members, "shingle-blocks"), percent, tile)
    texts = rows.join(broadcast_if_small(tiles), "id").select("id", "block", "tiles", "side", "text")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets, bounds in _set_rows(batch, 4, words):
                n = len(bounds) - 1
                maps = bitmaps(sets, bounds, bits)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, n) for c in range(4)), pa.array([m.tobytes() for m in maps], pa.binary()), pa.array([sets[bounds[r] : bounds[r + 1]].tobytes() for r in range(n)], pa.binary())],
                    ["id", "block", "tiles", "side", "map", "shingles"],
                )

    held = texts.mapInArrow(arrays, "id long, block long, tiles array<string>, side string, map binary, shingles binary")
    held = held.select("id", "block", F.explode("tiles").alias("tile"), "side", "map", "shingles")

    def links(table: pa.Table) -> pa.Table:
        a, b = [], []
        block = table.column("block").to_numpy()
        ids, side = table.column("id").to_numpy(), table.column("side").to_pylist()
        maps, sets = table.column("map").to_pylist(), table.column("shingles").to_pylist()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for own in np.split(order, cuts):
            if len(own) > 1:
                got = tile_links(
                    ids[own], [side[i] for i in own], [np.frombuffer(sets[i], np.uint64) for i in own], np.stack([np.frombuffer(maps[i], np.uint64) for i in own]), percent
                )
                a += [x for x, _ in got]
                b += [y for _, y in got]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    linked = materialize(held.groupBy("tile").applyInArrow(links, "a long, b long"), "shingle-links")
    label = connected_components(linked).select(F.col("node").alias("rep"), "component")
    label = materialize(classes.join(broadcast_if_small(materialize(label, "shingle-labels")), "rep", "left"), "shingle-components")
    label = label.select("n", "f", "g", F.coalesce("component", "rep").alias("component"))
    shared = label.filter("component is not null")
    out = sizes.join(broadcast_if_small(shared), ["n", "f", "g"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _table(kind: int, ids, n, f, g, valid) -> pa.RecordBatch:
    size = len(ids)
    cols = [pa.array(ids, pa.int64(), mask=None if valid is None else ~valid)]
    cols += [pa.nulls(size, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x), pa.int64()) for x in (n, f, g)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), *cols], ["kind", "id", "n", "f", "g"])


def _candidates(keys: DataFrame) -> DataFrame:
    """a, b: each document that keeps a key, with the smallest that does.

    Keys are counted and their rows found again in one exchange (every column
    is used on both sides, so that it is one).  A text has hundreds of keys,
    so even one that all texts have is a small part of the rows.
    """
    spread = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(spread, "f")
    often = dealt.groupBy("f").agg(F.count("id").alias("k"), F.min("spare").alias("least")).filter("k > 1 and least >= 0").select("f", "k")
    shared = dealt.join(often.hint("shuffle_hash"), "f")  # the few keys that several documents have, of one partition
    # a document takes back its most frequent keys; rows that share an id are one document, with the least to spare
    own = Window.partitionBy("id")
    kept = shared.withColumn("r", F.row_number().over(own.orderBy(F.desc("k"), "f"))).withColumn("e", F.min("spare").over(own))
    kept = materialize(kept.filter("r > e").select("id", "f"), "shingle-keys")
    low = kept.groupBy("f").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("f", "a")
    return kept.join(low, "f").filter("a < id").select("a", F.col("id").alias("b")).distinct()


def _tiles(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """id, block, side and the tiles that a document goes to.

    A block of at most ``tile`` documents is one tile, and small blocks share
    tasks, as many as it takes for about ``tile`` documents each.  In a larger one, a document's side is its size band (one step of
    the threshold) and a hash bucket of about ``tile`` documents; every side
    meets itself and the sides of its own and the next band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100.0 / percent) * 1.0001)).cast("int")
    members = members.withColumn("band", band)
    count = members.groupBy("block", "band").agg(F.count(F.lit(1)).alias("k"))
    count = count.select("block", "k", F.struct("band", F.ceil(F.col("k") / tile).cast("int").alias("m")).alias("entry"))
    info = count.groupBy("block").agg(F.sum("k").alias("total"), F.map_from_entries(F.collect_list("entry")).alias("buckets")).filter("total > 1")
    info = materialize(info, "shingle-tiles")
    x = members.join(broadcast_if_small(info), "block")
    x = x.withColumn("h", F.expr("cast(pmod(xxhash64(id), buckets[band]) as int)"))
    here = "transform(sequence(0, buckets[band] - 1), o -> concat_ws('/', block, band, least(h, o), band, greatest(h, o)))"
    above = "if(buckets[band + 1] is null, array(), transform(sequence(0, buckets[band + 1] - 1), o -> concat_ws('/', block, band, h, band + 1, o)))"
    below = "if(buckets[band - 1] is null, array(), transform(sequence(0, buckets[band - 1] - 1), o -> concat_ws('/', block, band - 1, o, band, h)))"
    small = F.col("total") <= tile
    shared = max(1, math.ceil((info.filter(F.col("total") <= tile).agg(F.sum("total")).first()[0] or 0) / tile))
    tiles = F.when(small, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(shared))))).otherwise(F.expr(f"concat({here}, {above}, {below})"))
    side = F.when(small, F.lit("")).otherwise(F.concat_ws("/", "band", "h"))
    return materialize(x.select("id", "block", tiles.alias("tiles"), side.alias("side")), "shingle-members")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    found = jaccard_components(docs, id_col, text_col, words, percent)
    gone = materialize(found.filter(f"{id_col} > component_id").select(F.col(id_col).alias("__gone_id")).distinct(), "near-gone")
    return docs.join(broadcast_if_small(gone), F.col(id_col) == F.col("__gone_id"), "left_anti")
