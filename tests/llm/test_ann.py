"""Recall against brute force, and edge cases of the graph search."""

import numpy as np

from skylattice.llm import ann


def brute(rows, every=50, top=5):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = (x @ x[k]) / (norm * norm[k])
        s[ids == ids[k]] = -np.inf
        out[int(ids[k])] = [(int(ids[i]), float(s[i])) for i in np.lexsort((ids, -np.round(s, 12)))[:top] if s[i] > -np.inf]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    out: dict = {}
    for r in sorted(ann.nearest(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 24))
    rows = [(i, (centers[i % 12] + 0.6 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(3000)]
    got, want = search(spark, rows, shard_rows=1100, query_block=16), brute(rows)  # three shards, four blocks of queries
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in got:
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in got[q] if i in exact)


def test_copies_nulls_and_few(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(700)] + [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700, 760)]
    rows += [(800, None), (850, [0.0] * 8), (900, [float("nan")] + [1.0] * 7), (950, [float("inf")] * 8), (None, hot), (1000, [1.0] * 3), (1050, []), (50, hot)]
    got, want = search(spark, rows, shard_rows=100), brute([r for r in rows if not r[1] or len(r[1]) == 8])
    assert set(got) == set(want)
    for q in range(0, 700, 50):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    few = search(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])
    assert [i for i, _ in few[0]] == [1, 2]
    assert search(spark, []) == {} and search(spark, [(0, [1.0, 2.0])]) == {}


def test_pruning_keeps_diverse_edges():
    data = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1.0]], np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    ids = np.array([[1, 2, 3]])
    out = ann.robust_prune(data, np.array([0]), ids, data[[0]] @ data[[1, 2, 3]].T, 3, 1.2)
    assert out[0].tolist() == [1, 3, -1]
