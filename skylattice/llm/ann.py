"""Approximate nearest neighbours by a robust-pruned directed graph a shard.

Vectors are dealt to shards by hash; each shard builds its own graph: greedy
searches from an entry point propose neighbours for a batch of new points,
relaxed distance pruning (``alpha``) keeps close but diverse edges, and edges
are added in both directions.  Queries, in blocks, run a beam search in every
shard, and the shards' best are merged.  All points of a batch and all queries
of a block advance side by side.

Equal vectors are one point of the graph that carries the ``top + 1`` smallest
ids, which is all that a result can hold, so a vector that is a third of all
rows is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.storage import materialize


def beam_search(data: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, trail_max: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest points found (by largest dot product of unit vectors), their products, and the same of the first ``trail_max`` points expanded on the way.

    Missing entries are -1.
    """
    q, n = len(queries), len(data)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # -1 as an index: nothing
    ids = np.full((q, beam), -1, np.int64)
    score = np.full((q, beam), -np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    k = min(len(entry), beam)
    ids[:, :k] = entry[:k]
    score[:, :k] = queries @ data[entry[:k]].T
    open_[:, :k] = True
    seen[:, entry[:k]] = True
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score, open_ = (np.take_along_axis(x, order, 1) for x in (ids, score, open_))
    trail = np.full((q, trail_max), -1, np.int64)
    trail_score = np.full((q, trail_max), -np.inf, np.float32)
    hops = np.zeros(q, np.int64)
    live = np.arange(q)
    while len(live):
        live = live[open_[live].any(axis=1)]
        if not len(live):
            break
        at = open_[live].argmax(axis=1)  # the nearest not yet expanded
        node = ids[live, at]
        open_[live, at] = False
        if trail_max:
            keep = hops[live] < trail_max
            trail[live[keep], hops[live[keep]]] = node[keep]
            trail_score[live[keep], hops[live[keep]]] = score[live[keep], at[keep]]
            hops[live] += 1
        near = graph[node]
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        s = np.einsum("qrd,qd->qr", data[near], queries[live])
        s = np.where(new & (near >= 0), s, -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(s > -np.inf, near, -1)], axis=1)
        all_s = np.concatenate([score[live], s], axis=1)
        all_open = np.concatenate([open_[live], s > -np.inf], axis=1)
        pick = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, pick, 1)
        score[live] = np.take_along_axis(all_s, pick, 1)
        open_[live] = np.take_along_axis(all_open, pick, 1)
    return ids, score, trail, trail_score


def robust_prune(data: np.ndarray, points: np.ndarray, ids: np.ndarray, score: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours for each point out of its candidates.

    The nearest candidate stays, and candidates that it is ``alpha`` times
    nearer to than the point is are dropped; and so on.  Distances are squared
    Euclidean ones between unit vectors.
    """
    ids = np.where(ids == points[:, None], -1, ids)
    order = np.argsort(np.where(ids < 0, np.inf, -score), axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    ids[:, 1:][(ids[:, 1:] == ids[:, :-1])] = -1  # repeats have equal scores and lie side by side
    alive = ids >= 0
    far = 2.0 - 2.0 * score
    out = np.full((len(points), degree), -1, np.int64)
    vectors = data[ids]
    rows = np.arange(len(points))
    for r in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, r] = ids[rows[some], at[some]]
        chosen = vectors[rows, at]
        between = 2.0 - 2.0 * np.einsum("pcd,pd->pc", vectors, chosen)
        alive &= alpha * alpha * between > far
        alive[rows, at] = False
        alive[~some] = False
    return out


def build_graph(data: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (-1: none) of unit vectors and the entry points.

    Points are added in batches that double up to ``batch``, so most searches
    run on a graph that already covers the data.
    """
    n = len(data)
    rng = np.random.default_rng(seed)
    center = data.mean(axis=0)
    start = int((data @ center).argmax())
    entry = np.unique(np.concatenate([[start], rng.choice(n, min(n, 8), replace=False)]))
    graph = np.full((n + 1, degree), -1, np.int64)
    order = rng.permutation(np.setdiff1d(np.arange(n), entry))
    graph[entry] = robust_prune(data, entry, np.tile(entry, (len(entry), 1)), data[entry] @ data[entry].T, degree, alpha)
    at, size = 0, 8
    while at < len(order):
        points = order[at : at + size]
        ids, score, trail, far = beam_search(data, graph, entry, data[points], beam, beam)
        ids, score = np.concatenate([ids, trail], axis=1), np.concatenate([score, far], axis=1)
        graph[points] = robust_prune(data, points, ids, score, degree, alpha)
        _add_back(data, graph, points, degree, alpha)
        at, size = at + size, min(batch, 2 * size)
    return graph[:n], entry


def _add_back(data: np.ndarray, graph: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to new points; a list that overflows is pruned."""
    to = graph[points]
    source = np.repeat(points, degree)[to.ravel() >= 0]
    target = to.ravel()[to.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    most = int(count.max(initial=0))
    for lo in range(0, len(nodes), 512):
        part = nodes[lo : lo + 512]
        c, f = count[lo : lo + 512], first[lo : lo + 512]
        wide = np.full((len(part), degree + most), -1, np.int64)
        wide[:, :degree] = graph[part]
        for k in range(int(c.max())):
            ok = c > k
            wide[ok, degree + k] = source[f[ok] + k]
        width = int((wide >= 0).sum(axis=1).max())
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable")[:, :width], 1)
        full = (wide >= 0).sum(axis=1) > degree
        keep = np.full((len(part), degree), -1, np.int64)
        m = min(degree, width)
        keep[:, :m] = wide[:, :m]
        if full.any():
            w = wide[full]
            s = np.einsum("pcd,pd->pc", data[w], data[part[full]]).astype(np.float32)
            keep[full] = robust_prune(data, part[full], w, s, degree, alpha)
        graph[part] = keep


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v as doubles) whose vector is not null, empty or zero and has finite components only."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 50,
    top: int = 5,
    shard_rows: int = 4096,
    degree: int = 32,
    beam: int = 64,
    query_block: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for each row whose id is divisible by ``every``.

    Nearness is the cosine in double precision on the original vectors; ties
    go to the smaller id; a row is never its own result, but rows that repeat
    an id are one vector each.  Unusable vectors (see :func:`usable`) take no
    part; vectors must have one length, and those of another than the most
    frequent take no part either.  An empty table gives none.
    """
    rows = materialize(usable(vectors, id_col, vec_col).distinct(), "ann-rows")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    rows = rows.filter(F.size("v") == (lengths.d if lengths else 0))
    shards = max(1, math.ceil((lengths.n if lengths else 0) / shard_rows))
    same = Window.partitionBy("v").orderBy("id")
    points = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= top + 1)
    points = points.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort([x[0] for x in table.column("ids").to_pylist()], kind="stable")
        table = table.take(pa.array(order))
        raw = _matrix(table.column("v"))
        graph, entry = build_graph(_unit(raw), degree, beam)
        ids = table.column("ids").to_pylist()
        wide = np.full((len(ids), top + 1), -1, np.int64)
        for i, x in enumerate(ids):
            wide[i, : len(x)] = x
        blob = [raw.tobytes(), graph.astype(np.int32).tobytes(), entry.astype(np.int64).tobytes(), wide.tobytes()]
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": pa.array([len(ids)], pa.int64()), **{k: pa.array([b], pa.binary()) for k, b in zip(("v", "graph", "entry", "ids"), blob, strict=True)}})

    index = points.groupBy("shard").applyInArrow(build, "shard int, n long, v binary, graph binary, entry binary, ids binary")
    index = materialize(index, "ann-index")

    ask = rows.filter(F.pmod("id", F.lit(every)) == 0)
    n_ask = ask.count()
    blocks = max(1, math.ceil(n_ask / query_block))
    ask = ask.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    ask = ask.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # about query_block rows each
    pairs = ask.select("block", "asked", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    pairs = pairs.join(index.hint("merge"), "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column(2)[r].as_py()
                raw, graph, entry, ids = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((3, np.float64), (4, np.int32), (5, np.int64), (6, np.int64)))
                raw, graph, ids = raw.reshape(n, -1), graph.reshape(n, -1).astype(np.int64), ids.reshape(n, -1)
                asked = batch.column(1).slice(r, 1).flatten()
                qid = np.asarray(asked.field("id"))
                q = _matrix(asked.field("v"))
                found, *_ = beam_search(_unit(raw), graph, entry, _unit(q), beam)
                ok = found >= 0
                who = np.repeat(np.arange(len(q)), ok.sum(axis=1))
                point = found[ok]
                score = (q[who] * raw[point]).sum(axis=1) / (np.sqrt((q * q).sum(axis=1))[who] * np.sqrt((raw * raw).sum(axis=1))[point])
                # every id of a point, but not the query's own; the best of this shard by score, then id
                near = ids[point]
                keep = (near >= 0) & (near != qid[who][:, None])
                who, score, near = np.repeat(who, keep.sum(axis=1)), np.repeat(score, keep.sum(axis=1)), near[keep]
                order = np.lexsort((near, -score, who))
                who, score, near = who[order], score[order], near[order]
                start = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.empty(0, bool)
                rank = np.arange(len(who)) - np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))
                best = rank < top
                yield pa.RecordBatch.from_arrays([pa.array(qid[who[best]]), pa.array(near[best]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    pairs = pairs.select("shard", "asked", "n", "v", "graph", "entry", "ids")
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
