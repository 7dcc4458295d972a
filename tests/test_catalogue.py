"""Every catalogue query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skylattice.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.astype(str)) == rows(want.astype(str))


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_greedy_pairs_by_hand(spark, con):
    left = [r[0] for r in con.sql("SELECT c_name FROM customer ORDER BY c_custkey").fetchall()]
    free = [r[0] for r in con.sql("SELECT 'Customer' || substr(s_name, 9) FROM supplier ORDER BY s_suppkey").fetchall()]
    want = []
    for a in left:
        common = [len(os.path.commonprefix([a, b])) for b in free]
        if common and max(common) >= 6:
            at = common.index(max(common))
            want.append((a, free.pop(at), common[at]))
    got = catalogue.queries()["q_pair_greedy"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_fill_order_by_hand(spark, con):
    """The heaviest edge from what is filled to what is not, over and over."""
    edges = con.sql(
        "WITH items AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem) SELECT x.s, y.s, count(*) FROM items x JOIN items y ON x.k = y.k AND x.s <> y.s GROUP BY 1, 2 HAVING count(*) >= 36"
    ).fetchall()
    filled = {r[0] for r in con.sql("SELECT s_suppkey FROM supplier WHERE s_acctbal < -900").fetchall()}
    left = {r[0] for r in con.sql("SELECT s_suppkey FROM supplier").fetchall()}
    total = {i: sum(w for a, _, w in edges if a == i) for i in left}
    want = []
    while left:
        reach = [(-w, b, a) for a, b, w in edges if a in filled and b in left]
        if reach:
            w, image, source = min(reach)
            want.append((len(want), image, source, -w))
        else:
            image = min(left, key=lambda i: (-total[i], i))
            want.append((len(want), image, None, 0))
        left.discard(image)
        filled.add(image)
    got = catalogue.queries()["q_fill_order"](spark, SF).orderBy("step").collect()
    # of equally heavy edges to one image any may be named
    assert [(r.step, r.image, r.weight) for r in got] == [(s, i, w) for s, i, _, w in want]
    assert all(r.predecessor is None or (r.predecessor, r.image, r.weight) in set(edges) for r in got)


def test_planted_homographies_are_found(spark):
    import numpy as np

    from skylattice.operators.robust import project

    h = np.array(catalogue._H).reshape(3, 3)
    corners = np.array([[10.0, 5], [500, 5], [10, 400], [500, 400]])
    got = catalogue.queries()["q_ransac"](spark, SF).collect()
    assert len(got) == 10
    for r in got:
        assert 0.7 * r.n < r.inliers < 0.9 * r.n and r.rmse < 1e-3
        assert np.allclose(project(np.array(r.m).reshape(3, 3), corners), project(h, corners), atol=0.05)


def test_vocabulary_settles(spark):
    """Every word is near the mean of the vectors that are nearest to it, and all words together fit better than one."""
    import numpy as np

    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("embedding").collect()], float)
    rows = catalogue.queries()["q_vocab"](spark, SF).collect()
    centers = np.array([r.center for r in sorted(rows, key=lambda r: r.word)])
    assert [r.word for r in sorted(rows, key=lambda r: r.word)] == list(range(min(32, max(2, len(x) // 10))))
    far = ((x[:, None] - centers) ** 2).sum(axis=2)
    near, own = far.argmin(axis=1), far.min(axis=1)
    assert own.sum() < 0.9 * ((x - x.mean(axis=0)) ** 2).sum()
    moved = sum(((x[near == k].mean(axis=0) - c) ** 2).sum() for k, c in enumerate(centers) if (near == k).any())
    assert moved < 0.05 * own.sum()


@pytest.mark.parametrize("name", ["q_tracks", "q_corr", "q_reachable", "q_track_summary"])
def test_tracks_of_large_part_numbers(spark, tmp_path, name):
    """Part numbers beyond what a long can order (46,117 for nodes, 92,233 for rows) give the tracks of small ones."""
    shift = 5_000_000
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.withColumn("l_partkey", items.l_partkey + shift).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = catalogue.queries()[name](spark, SF).toPandas()
    got = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    for c in {"feature_id", "kp_a", "kp_b"} & set(got.columns):
        got[c] -= shift
    assert len(got) and rows(got) == rows(want)
