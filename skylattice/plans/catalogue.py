"""The query catalogue: operators applied to the test tables, with their SQL.

The tables are no images, so each operator runs on a table of the same shape.
Every query reads its whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geometry as geo
from skylattice.operators import composite, matchgraph, numbering, organize, retrieval, robust, surface
from skylattice.plans import incremental, registration
from skylattice.sources import files
from skylattice.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- organising -----------------------------------------------------------


@query("""
WITH s AS (SELECT regexp_replace(list_last(regexp_extract_all(s_name, '\\d+')), '^0+(\\d)', '\\1') AS id, s_name, s_suppkey FROM supplier),
c AS (SELECT regexp_replace(list_last(regexp_extract_all(c_name, '\\d+')), '^0+(\\d)', '\\1') AS id, c_name, c_custkey FROM customer),
p AS (SELECT id, arg_min(s_name, s_suppkey) AS thermal FROM s GROUP BY id),
q AS (SELECT id, arg_min(c_name, c_custkey) AS visible FROM c GROUP BY id)
SELECT row_number() OVER (ORDER BY id::BIGINT) AS idx, id, thermal, visible FROM p JOIN q USING (id)
""")
def q_pair_exact(spark, sf_dir):
    thermal = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))
    visible = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    return organize.number_pairs(organize.pair_by_id(thermal, visible)).select("idx", "id", "thermal", "visible")


_PREFIX_SQL = """
WITH a AS (SELECT DISTINCT c_name AS a FROM customer), b AS (SELECT DISTINCT 'Customer' || substr(s_name, 9) AS b FROM supplier),
x AS (SELECT a, unnest(range(6, len(a) + 1)) AS n FROM a), y AS (SELECT b, unnest(range(6, len(b) + 1)) AS n FROM b),
hit AS (SELECT a, x.n, min(b) AS b FROM x JOIN y ON x.n = y.n AND substr(a, 1, x.n) = substr(b, 1, y.n) GROUP BY a, x.n)
SELECT a, arg_max(b, n) AS b, max(n)::INTEGER AS length FROM hit GROUP BY a
"""


def _prefix_sides(spark, sf_dir):
    right = F.concat(F.lit("Customer"), F.expr("substring(s_name, 9)")).alias("b")
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("a"), F.col("c_custkey").alias("o")), _table(spark, sf_dir, "supplier").select(right, F.col("s_suppkey").alias("o"))


@query(_PREFIX_SQL)
def q_pair_prefix(spark, sf_dir):
    left, right = _prefix_sides(spark, sf_dir)
    return organize.best_prefix_partner(left, right, "a", "b")


@query()
def q_pair_greedy(spark, sf_dir):
    left, right = _prefix_sides(spark, sf_dir)
    return organize.greedy_prefix_pairs(left, right, "a", "b", "o")


_THRESHOLD = """SELECT sqrt(p * nx) AS threshold FROM (SELECT p, lead(p) OVER (ORDER BY p) AS nx FROM (SELECT DISTINCT n_chars::DOUBLE AS p FROM documents))
WHERE nx IS NOT NULL ORDER BY nx / p DESC, p LIMIT 1"""


@query(f"SELECT round(threshold, 6) AS threshold FROM ({_THRESHOLD})")
def q_threshold(spark, sf_dir):
    return organize.auto_threshold(_table(spark, sf_dir, "documents"), "n_chars").select(F.round("threshold", 6).alias("threshold"))


@query(f"""
SELECT kind, lang, count(*) AS n FROM (SELECT CASE WHEN n_chars <= threshold THEN 'thermal' ELSE 'visible' END AS kind, lang
FROM documents, ({_THRESHOLD})) GROUP BY kind, lang
""")
def q_classify(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("n_chars", "lang")
    return organize.classify(docs, "n_chars", organize.auto_threshold(docs, "n_chars")).groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_custkey LIMIT 50")
def q_pending(spark, sf_dir):
    done = _table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return organize.pending(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey", F.col("c_custkey"), 50)


@query("""
WITH o AS (SELECT c_custkey, lower(c_name) AS name FROM customer WHERE c_nationkey < 13), n AS (SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_acctbal > 5000)
SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n
""")
def q_upsert(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    old = c.filter("c_nationkey < 13").select("c_custkey", F.lower("c_name").alias("name"))
    return organize.upsert(old, c.filter("c_acctbal > 5000").select("c_custkey", F.upper("c_name").alias("name")), "c_custkey")


# --- match graph ----------------------------------------------------------


def _supplier_pairs(spark, sf_dir, status: str | None = None) -> DataFrame:
    """A row for each order in which two suppliers occur together."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    if status:
        some = _table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("l_orderkey"))
        items = items.join(some, "l_orderkey", "left_semi")
    return items.toDF("k", "image_a").join(items.toDF("k", "image_b"), "k").filter("image_a < image_b").select("image_a", "image_b")


_PAIRS = """items AS (SELECT DISTINCT l_orderkey AS k, l_suppkey::VARCHAR AS s FROM lineitem),
w AS (SELECT x.s AS a, y.s AS b, count(*) AS weight FROM items x JOIN items y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2)"""


@query(f"WITH {_PAIRS} SELECT a, b, weight FROM w UNION ALL SELECT b, a, weight FROM w")
def q_edge_weight(spark, sf_dir):
    return matchgraph.edge_weights(_supplier_pairs(spark, sf_dir))


@query(f"""
WITH {_PAIRS}, e AS (SELECT a, b, weight FROM w WHERE weight >= 25 UNION ALL SELECT b, a, weight FROM w WHERE weight >= 25),
run AS (SELECT s_suppkey::VARCHAR AS image FROM supplier WHERE s_acctbal < 0),
inv AS (SELECT image FROM run UNION SELECT b FROM e JOIN run ON a = image)
SELECT a, b, weight FROM e WHERE a IN (SELECT image FROM inv) AND b IN (SELECT image FROM inv)
""")
def q_involved(spark, sf_dir):
    edges = matchgraph.edge_weights(_supplier_pairs(spark, sf_dir)).filter("weight >= 25")
    run = _table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("image"))
    return matchgraph.between(edges, matchgraph.involved(run, edges))


@query("""
WITH items AS (SELECT DISTINCT l_orderkey AS k, l_suppkey::VARCHAR AS s FROM lineitem),
p AS (SELECT x.k, x.s AS image_a, y.s AS image_b FROM items x JOIN items y ON x.k = y.k AND x.s < y.s),
tried AS (SELECT DISTINCT image_a, image_b FROM p JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'P')
SELECT image_a, image_b, (count(*) >= 15)::INTEGER AS verified, count(*) AS inliers
FROM p ANTI JOIN tried USING (image_a, image_b) GROUP BY image_a, image_b
""")
def q_status(spark, sf_dir):
    return matchgraph.pair_status(_supplier_pairs(spark, sf_dir), _supplier_pairs(spark, sf_dir, "P"))


@query("""
WITH RECURSIVE items AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem),
w AS (SELECT x.s AS a, y.s AS b FROM items x JOIN items y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 36),
u AS (SELECT a, b FROM w UNION SELECT b, a FROM w),
r AS (SELECT s_suppkey AS v, s_suppkey AS c FROM supplier UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v),
l AS (SELECT v, min(c) AS component FROM r GROUP BY v)
SELECT component, count(*) AS size FROM l GROUP BY component ORDER BY size DESC, component LIMIT 10
""")
def q_components(spark, sf_dir):
    pairs = _supplier_pairs(spark, sf_dir).groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("w")).filter("w >= 36")
    edges = pairs.select(F.col("image_a").cast("long").alias("a"), F.col("image_b").cast("long").alias("b"))
    nodes = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return matchgraph.component_sizes(edges, nodes).orderBy(F.desc("size"), "component").limit(10)


def _history(spark, sf_dir) -> DataFrame:
    """Match rows: an order's part and the next order's with the same part in the same month.

    r is a row's position by part, month and order.  The number that orders
    the rows in SQL exceeds a long from part 46,117 on, so it is a decimal
    here and only its rank goes on; rows without it have none.
    """
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m")).distinct()
    from pyspark.sql import Window

    nxt = F.lead("l_orderkey").over(Window.partitionBy("l_partkey", "m").orderBy("l_orderkey"))
    rows = rows.withColumn("b", nxt).filter("b is not null")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    key = wide("l_partkey") * F.lit(10**14).cast("decimal(15,0)") + wide("m") * F.lit(10**9).cast("decimal(10,0)") + wide("l_orderkey")
    rows = numbering.number_rows(rows.withColumn("key", key), ["key"], "r", 0)
    r = F.when(F.col("key").isNotNull(), F.col("r"))
    return rows.select(r.alias("r"), F.col("l_orderkey").alias("image_a"), F.col("l_partkey").alias("kp_a"), F.col("b").alias("image_b"), F.col("l_partkey").alias("kp_b"))


_TRACKS = """
WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, year(l_shipdate) * 12 + month(l_shipdate) AS m FROM lineitem),
n AS (SELECT k AS a, p AS ka, lead(k) OVER (PARTITION BY p, m ORDER BY k) AS b, p AS kb, (p * 100000 + m) * 1000000000 + k AS r FROM d),
matches AS (SELECT * FROM n WHERE b IS NOT NULL),
obs AS (SELECT a im, ka kp, 2 * r seq FROM matches UNION ALL SELECT b, kb, 2 * r + 1 FROM matches),
node AS (SELECT im, kp, min(seq) seq FROM obs GROUP BY 1, 2),
e AS (SELECT x.seq s, y.seq d FROM matches JOIN node x ON x.im = a AND x.kp = ka JOIN node y ON y.im = b AND y.kp = kb),
u AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
reach AS (SELECT seq v, seq c FROM node UNION SELECT u.d, reach.c FROM reach JOIN u ON u.s = reach.v),
comp AS (SELECT v seq, min(c) c FROM reach GROUP BY 1),
keep AS (SELECT c, count(DISTINCT im) n_img FROM comp JOIN node USING (seq) GROUP BY 1 HAVING count(DISTINCT im) >= 2),
num AS (SELECT c, n_img, row_number() OVER (ORDER BY c) - 1 track_id FROM keep),
tracks AS (SELECT track_id, im, kp, seq, n_img FROM comp JOIN num USING (c) JOIN node USING (seq)),
last AS (SELECT track_id, im, arg_max(kp, seq) kp FROM tracks GROUP BY 1, 2),
corr AS (SELECT x.im a, y.im b, x.kp kp_a, y.kp kp_b FROM tracks x JOIN last y ON x.track_id = y.track_id AND x.im <> y.im)
"""


@query(_TRACKS + "SELECT track_id, im AS image, kp AS feature_id, n_img AS n_images FROM tracks")
def q_tracks(spark, sf_dir):
    return matchgraph.create_tracks(_history(spark, sf_dir)).drop("seq")


@query(_TRACKS + "SELECT a, b, kp_a, kp_b FROM corr")
def q_corr(spark, sf_dir):
    return matchgraph.correspondences(matchgraph.create_tracks(_history(spark, sf_dir)))


@query(_TRACKS + "SELECT a, b, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM (SELECT a, b, count(*) AS shared FROM corr GROUP BY 1, 2)")
def q_reachable(spark, sf_dir):
    return matchgraph.reachable(matchgraph.create_tracks(_history(spark, sf_dir)))


@query()
def q_fill_order(spark, sf_dir):
    edges = matchgraph.edge_weights(_supplier_pairs(spark, sf_dir)).filter("weight >= 36")
    s = _table(spark, sf_dir, "supplier")
    return matchgraph.fill_order(edges, s.select(F.col("s_suppkey").alias("image")), s.filter("s_acctbal < -900").select(F.col("s_suppkey").alias("image")))


# --- retrieval ------------------------------------------------------------


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
w AS (SELECT doc_id, word, tf, tf * ln((n + 1.0) / (df + 1.0)) AS w FROM tf JOIN df USING (word), n)
SELECT doc_id, word, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM w
""")
def q_tfidf(spark, sf_dir):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    terms = _table(spark, sf_dir, "documents").select("doc_id", words.alias("word"))
    return retrieval.tfidf(terms, "doc_id", "word").select("doc_id", "word", "tf", F.round("weight", 4).alias("weight"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS sim FROM e x JOIN e y ON x.vec_id <> y.vec_id)
SELECT a, b, rank FROM (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b DESC) AS rank FROM p) WHERE rank <= 10 AND sim > 0
""")
def q_topm(spark, sf_dir):
    return retrieval.top_cosine(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10).select("a", "b", "rank")


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT x.vec_id AS a, y.vec_id AS b, list_distance(x.v, y.v) AS d FROM e x JOIN e y ON x.label < 5 AND y.label >= 5),
r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS d2 FROM d)
SELECT a, b FROM r WHERE r = 1 AND d < 0.95 * d2
""")
def q_ratio(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return retrieval.ratio_matches(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding", 0.95)


@query("""
WITH x AS (SELECT label, embedding::DOUBLE[] AS v, vec_id FROM embeddings),
c AS (SELECT label, i, avg(v[i]) AS m FROM x, range(1, 65) t(i) GROUP BY label, i),
d AS (SELECT vec_id, c.label AS word, sum((v[i] - m) * (v[i] - m)) AS d FROM x, c GROUP BY vec_id, c.label)
SELECT vec_id AS id, arg_min(word, (d, word)) AS word FROM d GROUP BY vec_id
""")
def q_nearest_word(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centers = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))  # ten labels
    return retrieval.nearest_word(e, centers.select("label", F.col("c.m").alias("c")), "vec_id", "embedding", "label", "c")


@query()
def q_vocab(spark, sf_dir):
    return retrieval.vocabulary(_table(spark, sf_dir, "embeddings"), "embedding", 32)


@query("""
WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
s AS (SELECT DISTINCT CASE WHEN i = 24 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 24))::BIGINT END AS pos FROM n, range(25) t(i))
SELECT pos, o_orderkey FROM o JOIN s USING (pos)
""")
def q_sample(spark, sf_dir):
    return numbering.even_sample(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 25)


# --- surfaces -------------------------------------------------------------


def _cloud(spark, sf_dir) -> DataFrame:
    z = F.round(F.col("l_discount") * 100).alias("z")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), z, "l_returnflag", "l_linenumber")


_GRID = """
WITH pt AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, round(l_discount * 100) AS z FROM lineitem),
ext AS (SELECT min(x) AS x0, min(y) AS y0, (floor(max(x) - min(x)) + 1)::INTEGER AS nx, (floor(max(y) - min(y)) + 1)::INTEGER AS ny FROM pt),
grid AS (SELECT least(floor(y - y0)::INTEGER, ny - 1) AS iy, least(floor(x - x0)::INTEGER, nx - 1) AS ix, max(z) AS z FROM pt, ext GROUP BY 1, 2),
cells AS (SELECT y.i::INTEGER AS iy, x.i::INTEGER AS ix FROM ext, range(ny) y(i), range(nx) x(i)),
near AS (SELECT c.iy, c.ix, arg_min(g.z, ((g.iy - c.iy) * (g.iy - c.iy) + (g.ix - c.ix) * (g.ix - c.ix), g.iy, g.ix)) AS z
         FROM (SELECT * FROM cells ANTI JOIN grid USING (iy, ix)) c, grid g GROUP BY 1, 2),
filled AS (SELECT iy, ix, z, FALSE AS filled FROM grid UNION ALL SELECT iy, ix, z, TRUE FROM near)
"""


@query(_GRID + "SELECT iy, ix, z FROM grid")
def q_dsm(spark, sf_dir):
    points = _cloud(spark, sf_dir)
    return surface.rasterize(points, surface.grid_extent(points, 1.0), 1.0)


def _filled(spark, sf_dir):
    points = _cloud(spark, sf_dir)
    extent = surface.grid_extent(points, 1.0)
    return surface.fill_empty(surface.rasterize(points, extent, 1.0), extent), extent


@query(_GRID + "SELECT iy, ix, z, filled FROM filled")
def q_dsm_fill(spark, sf_dir):
    return _filled(spark, sf_dir)[0]


@query(_GRID + """,
p AS (SELECT p_partkey, greatest(0.0, least(p_size + 0.25 - x0, nx - 1.001)) AS gx, greatest(0.0, least(p_retailprice / 20 - y0, ny - 1.001)) AS gy FROM part, ext),
k AS (SELECT p_partkey, gx, gy, floor(gx)::INTEGER AS ix, floor(gy)::INTEGER AS iy, gx - floor(gx) AS fx, gy - floor(gy) AS fy FROM p)
SELECT p_partkey, round(a.z * (1 - fx) * (1 - fy) + b.z * fx * (1 - fy) + c.z * (1 - fx) * fy + d.z * fx * fy, 4) AS ground FROM k
JOIN filled a ON a.iy = k.iy AND a.ix = k.ix JOIN filled b ON b.iy = k.iy AND b.ix = k.ix + 1
JOIN filled c ON c.iy = k.iy + 1 AND c.ix = k.ix JOIN filled d ON d.iy = k.iy + 1 AND d.ix = k.ix + 1
""")
def q_bilinear(spark, sf_dir):
    grid, extent = _filled(spark, sf_dir)
    at = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 0.25).alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    return surface.bilinear(at, grid, extent, 1.0).select("p_partkey", F.round("ground", 4).alias("ground"))


@query("""
WITH b AS (SELECT user_id * 1000 + dayofyear(ts) AS id, min(epoch(ts)) AS x0, max(epoch(ts)) AS x1, min(value) AS y0, max(value) AS y1
FROM (SELECT user_id, date_trunc('second', ts) AS ts, value FROM events) GROUP BY user_id * 1000 + dayofyear(ts))
SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.id < q.id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1
""")
def q_overlap(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("x"), "value")
    boxes = e.groupBy("id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("value").alias("y0"), F.max("value").alias("y1"))
    return surface.overlapping_boxes(boxes, "id", 21600.0)


@query("""
WITH pt AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, round(l_discount * 100) AS z, l_returnflag AS c, l_linenumber AS i FROM lineitem),
a AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1, count(*) n, min(i) i0, max(i) i1 FROM pt)
SELECT 'bbox' AS section, 'x_min' AS key, x0::DOUBLE AS value FROM a UNION ALL SELECT 'bbox', 'x_max', x1 FROM a UNION ALL SELECT 'bbox', 'y_min', y0 FROM a
UNION ALL SELECT 'bbox', 'y_max', y1 FROM a UNION ALL SELECT 'bbox', 'z_min', z0 FROM a UNION ALL SELECT 'bbox', 'z_max', z1 FROM a
UNION ALL SELECT 'count', 'points', n FROM a UNION ALL SELECT 'intensity', 'min', i0 FROM a UNION ALL SELECT 'intensity', 'max', i1 FROM a
UNION ALL SELECT 'class', c, count(*) FROM pt GROUP BY c
""")
def q_las_profile(spark, sf_dir):
    return surface.profile(_cloud(spark, sf_dir), "l_returnflag", "l_linenumber")


# --- compositing ----------------------------------------------------------

_RANK = ["purchase", "click", "view", "signup", "error"]


def _layers(spark, sf_dir) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, _RANK)), F.col("event_type")).cast("int") - 1
    return _table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("hour"), rank.alias("rank"), "value", (F.coalesce("value", F.lit(0.0)) > 2).alias("valid"))


_LAYERS = f"""WITH l AS (SELECT user_id, hour(ts)::INTEGER AS hour, list_position({_RANK}, event_type)::INTEGER - 1 AS rank, value, coalesce(value, 0) > 2 AS valid FROM events)"""


@query(_LAYERS + " SELECT user_id, hour, arg_min(rank, (rank, value)) AS layer, arg_min(value, (rank, value)) AS value FROM l WHERE valid GROUP BY user_id, hour")
def q_composite(spark, sf_dir):
    return composite.first_valid(_layers(spark, sf_dir), ["user_id", "hour"], "rank", "value", "valid")


@query(_LAYERS + """, p AS (SELECT user_id, hour, max((valid AND rank <= 1)::INTEGER) AS own, max(valid::INTEGER) AS "any" FROM l GROUP BY 1, 2)
SELECT count(*) AS pixels, sum(own)::BIGINT AS own, sum("any")::BIGINT AS "any", round(sum(own) / count(*), 6) AS before, round(sum("any") / count(*), 6) AS after FROM p""")
def q_coverage(spark, sf_dir):
    out = composite.coverage(_layers(spark, sf_dir), ["user_id", "hour"], "rank", "valid", 1)
    return out.select("pixels", "own", "any", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


# --- geometry and fits ----------------------------------------------------


@query("""
WITH m AS (SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS conf FROM lineitem),
fit AS (SELECT sum(x * y) / sum(x * x) AS k FROM m WHERE conf >= 0.05),
r AS (SELECT abs(y - k * x) AS e, conf FROM m, fit), kept AS (SELECT e FROM r WHERE conf >= 0.05 OR (conf >= 0.02 AND e < 20000))
SELECT round(any_value(k), 4) AS ratio, (SELECT count(*) FROM kept) AS kept, (SELECT round(sqrt(avg(e * e)), 4) FROM kept) AS rmse, (SELECT round(median(e), 4) FROM kept) AS median FROM fit
""")
def q_hilo(spark, sf_dir):
    pool = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("conf"))
    return robust.guided_ratio(pool, "x", "y", "conf", 0.05, 0.02, 20000.0)


_H = (1.02, 0.03, -4.0, -0.02, 0.97, 6.5, 0.0004, -0.0002, 1.0)


@query(f"""SELECT l_orderkey, l_linenumber, round(({_H[0]} * x + {_H[1]} * y + {_H[2]}) / w, 4) AS u, round(({_H[3]} * x + {_H[4]} * y + {_H[5]}) / w, 4) AS v
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, {_H[6]} * l_quantity + {_H[7]} * l_discount + {_H[8]} AS w FROM lineitem)""")
def q_apply_h(spark, sf_dir):
    u, v = geo.apply_homography(_H, F.col("l_quantity"), F.col("l_discount"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS dx, l_discount * 100 - 5 AS dy FROM lineitem)
SELECT l_orderkey, l_linenumber, round(25 + dx / (1 + 0.1 * (dx * dx + dy * dy) / 900), 4) AS ux, round(5 + dy / (1 + 0.1 * (dx * dx + dy * dy) / 900), 4) AS uy,
round(25 + dx * (1 - 0.1 * (dx * dx + dy * dy) / 900), 4) AS ix, round(5 + dy * (1 - 0.1 * (dx * dx + dy * dy) / 900), 4) AS iy FROM d
""")
def q_distort(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    out = [*geo.undistort(x, y, 0.1, (25, 5), 30), *geo.distort(x, y, 0.1, (25, 5), 30)]
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(n) for c, n in zip(out, ("ux", "uy", "ix", "iy"), strict=True)))


_SVD = """
WITH m AS (SELECT p_partkey, 1 + p_size / 100.0::DOUBLE AS a, p_retailprice / 5000 AS b, -p_size / 80.0::DOUBLE AS c, 1 - p_size / 30.0::DOUBLE AS d, p_size / 40000.0::DOUBLE AS g FROM part),
v AS (SELECT *, 0.5 * atan2(2 * (a * b + c * d), a * a + c * c - b * b - d * d) AS t FROM m),
u AS (SELECT *, cos(t) AS vx, sin(t) AS vy, a * cos(t) + b * sin(t) AS ux, c * cos(t) + d * sin(t) AS uy, -a * sin(t) + b * cos(t) AS wx, -c * sin(t) + d * cos(t) AS wy FROM v),
s AS (SELECT *, sqrt(ux * ux + uy * uy) AS s1, sqrt(wx * wx + wy * wy) AS s2 FROM u),
r AS (SELECT *, degrees(atan2(uy / s1 * vx - wy / s2 * vy, ux / s1 * vx - wx / s2 * vy)) AS rotation, (s1 + s2) / 2 AS scale, s1 / s2 AS anisotropy, a * d - b * c < 0 AS reflection FROM s)
"""


@query(_SVD + "SELECT p_partkey, round(rotation, 3) AS rotation, round(scale, 4) AS scale, reflection, abs(a * d - b * c) < 1e-9 OR abs(g) * 640 > 0.5 AS degenerate FROM r")
def q_sanity(spark, sf_dir):
    m, parts = _affine(spark, sf_dir)
    flat = geo.degenerate([F.col("a"), F.col("b"), 0.0, F.col("c"), F.col("d"), 0.0, F.col("g"), 0.0, 1.0], 640, 480)
    # the determinant of the 3x3 is that of the 2x2 part here
    return m.select("p_partkey", F.round(parts["rotation"], 3).alias("rotation"), F.round(parts["scale"], 4).alias("scale"), parts["reflection"].alias("reflection"), flat.alias("degenerate"))


def _affine(spark, sf_dir):
    """2x2 parts of all kinds, reflections among them."""
    size = F.col("p_size").cast("double")
    m = _table(spark, sf_dir, "part").select("p_partkey", (1 + size / 100).alias("a"), (F.col("p_retailprice") / 5000).alias("b"), (-size / 80).alias("c"), (1 - size / 30).alias("d"), (size / 40000).alias("g"))
    return m, geo.decompose_affine([F.col(c) for c in "abcd"])


@query(_SVD + """SELECT p_partkey, concat_ws(',', CASE WHEN NOT scale BETWEEN 0.3 AND 3 THEN 'scale' END, CASE WHEN abs(rotation) > 25 THEN 'rotation' END,
CASE WHEN anisotropy > 1.6 THEN 'anisotropy' END, CASE WHEN reflection THEN 'reflection' END) AS warnings FROM r""")
def q_affine_warnings(spark, sf_dir):
    m, parts = _affine(spark, sf_dir)
    return m.select("p_partkey", F.concat_ws(",", geo.affine_warnings(parts)).alias("warnings"))


@query("""
SELECT l_orderkey, l_linenumber, round(x * greatest(w, h) + w / 2, 6) AS px, round(y * greatest(w, h) + h / 2, 6) AS py, round((x * greatest(w, h) + w / 2) * 640 / w, 6) AS wx,
round((y * greatest(w, h) + h / 2) * 480 / h, 6) AS wy, round(sqrt(power(x * w - y, 2) + power(y * h - x, 2)), 6) AS e
FROM (SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS x, l_tax - 0.04 AS y, 4000 + l_quantity AS w, 3000 + l_linenumber AS h FROM lineitem)
""")
def q_frames(spark, sf_dir):
    """Normalised coordinates, frames of another size, and distances."""
    x, y, w, h = F.col("l_discount") - 0.05, F.col("l_tax") - 0.04, F.col("l_quantity") + 4000, F.col("l_linenumber") + 3000
    px, py = geo.normalized_to_pixel(x, y, w, h)
    wx, wy = geo.rescale(px, py, (w, h), (640, 480))
    out = {"px": px, "py": py, "wx": wx, "wy": wy, "e": geo.reprojection_error(x * w, y * h, y, x)}
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query("""
SELECT p_partkey, round(p_size * 4032 / 36.0, 6) AS a, CASE WHEN p_size % 10 = 0 THEN NULL ELSE round(640 / (2 * tan(radians(p_size % 10 * 12) / 2)), 6) END AS b,
round(p_retailprice / 100 * 3000 / CASE p_size % 4 WHEN 2 THEN 25.4 WHEN 3 THEN 10.0 END, 6) AS c FROM part
""")
def q_focal(spark, sf_dir):
    """Focal lengths by three rules; a field of view of 0 and an unknown unit give null."""
    size = F.col("p_size").cast("double")
    out = {"a": geo.focal_from_35mm(size, 4032, 3024), "b": geo.focal_from_hfov(size % 10 * 12, 640), "c": geo.focal_from_plane(F.col("p_retailprice") / 100, 3000, size % 4)}
    return _table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query("""
WITH m AS (SELECT p_partkey, 1 + p_size / 100.0::DOUBLE AS a, p_size / 500.0::DOUBLE AS b, 4.0 + p_size AS c FROM part)
SELECT p_partkey, round((4000.0 / 640) ** -1 * a * (2000.0 / 640), 9) AS m00, round((1500.0 / 480) * b * (640.0 / 4000), 9) AS m10, round((2000.0 / 640) * c, 9) AS m02 FROM m
""")
def q_full_frame(spark, sf_dir):
    """An affine transform between work frames, padded, as one between full frames."""
    size = F.col("p_size").cast("double")
    m = geo.pad_affine([1 + size / 100, size / 500, 4.0 + size, size / 500, 1 + size / 100, 2.0])
    full = geo.conjugate_resize(m, (4000, 3000), (2000, 1500), (640, 480))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(full[0], 9).alias("m00"), F.round(full[3], 9).alias("m10"), F.round(full[2], 9).alias("m02"))


@query("""
WITH a AS (SELECT p_partkey, radians(p_size * 3.0) AS t, p_retailprice / 100 AS s FROM part)
SELECT p_partkey, round(cos(t), 6) AS r00, round(-sin(t), 6) AS r01, round(2 * (cos(t) * s - sin(t) * 2) + 5, 6) AS cx, round(2 * (sin(t) * s + cos(t) * 2) - 7, 6) AS cy, round(11.0, 6) AS cz FROM a
""")
def q_pose(spark, sf_dir):
    """Rotations about the vertical as axis-angle vectors, and camera centres of a chunk in the world."""
    zero, one = F.lit(0.0), F.lit(1.0)
    turn = geo.rodrigues(F.array(zero, zero, F.radians(F.col("p_size") * 3.0)))
    eye = F.array(one, zero, zero, zero, one, zero, zero, zero, one)
    pose = geo.compose_pose(eye, F.array(F.col("p_retailprice") / 100, F.lit(2.0), F.lit(4.0)), turn, F.array(F.lit(5.0), F.lit(-7.0), F.lit(3.0)), F.lit(2.0))
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(turn[0], 6).alias("r00"), F.round(turn[1], 6).alias("r01"), *(F.round(pose["C"][i], 6).alias(n) for i, n in enumerate(("cx", "cy", "cz"))))


@query("""
SELECT c_custkey, round(50 + degrees(c_acctbal / 6371000.0), 9) AS lat, round(10 + degrees(c_nationkey * 1000 / (6371000.0 * cos(radians(50)))), 9) AS lon,
(32600 + floor((c_nationkey * 14 - 180 + 180) / 6) + 1 + CASE WHEN c_acctbal < 0 THEN 100 ELSE 0 END)::INTEGER AS zone FROM customer
""")
def q_origin(spark, sf_dir):
    """Offsets around an origin as degrees, and the zones of places."""
    lat, lon = geo.enu_to_lat_lon(F.col("c_nationkey") * 1000.0, F.col("c_acctbal"), 50.0, 10.0)
    zone = geo.utm_zone(F.col("c_acctbal"), F.col("c_nationkey") * 14.0 - 180)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), zone.alias("zone"))


@query("""
WITH a AS (SELECT s_suppkey, 6378137.0 / sqrt(1 - (1 - power(1 - 1 / 298.257223563, 2)) * power(sin(radians(s_nationkey * 3.5 - 40)), 2)) AS n, radians(s_nationkey * 3.5 - 40) AS p, s_acctbal AS h FROM supplier)
SELECT s_suppkey, round(degrees(p), 6) AS lat, round(7.0, 6) AS lon, round(h, 3) AS height FROM a
""")
def q_earth_centred(spark, sf_dir):
    """Places of known latitude and height, out to earth-centred metres and back."""
    lat, lon, h = F.radians(F.col("s_nationkey") * 3.5 - 40), F.lit(math.radians(7.0)), F.col("s_acctbal")
    e2 = 1 - (1 - 1 / 298.257223563) ** 2
    n = 6378137.0 / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", ((n + h) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + h) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - e2) + h) * F.sin(lat)).alias("z"))
    back = geo.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return rows.select("s_suppkey", *(F.round(c, d).alias(n_) for c, n_, d in zip(back, ("lat", "lon", "height"), (6, 6, 3), strict=True)))


@query("""
WITH c AS (SELECT c_custkey, c_name AS a, 'Customer#' || lpad((c_custkey // 3)::VARCHAR, 9, '0') AS b FROM customer)
SELECT c_custkey, coalesce(list_min(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) - 1, len(a))::INTEGER AS n FROM c
""")
def q_common_prefix(spark, sf_dir):
    other = F.format_string("Customer#%09d", F.floor(F.col("c_custkey") / 3).cast("long"))
    return _table(spark, sf_dir, "customer").select("c_custkey", organize.common_prefix(F.col("c_name"), other).alias("n"))


@query(_TRACKS + "SELECT count(*) AS tracks, max(n_img) AS longest, count(*) FILTER (n_img >= 3) AS in_three FROM num")
def q_track_summary(spark, sf_dir):
    return matchgraph.track_summary(matchgraph.create_tracks(_history(spark, sf_dir)))


@query("""
SELECT target, source, inliers, row_number() OVER (PARTITION BY target ORDER BY inliers DESC, source::BIGINT) AS rank
FROM (SELECT c_nationkey::VARCHAR AS target, s_nationkey::VARCHAR AS source, count(*) AS inliers FROM customer JOIN supplier ON c_custkey = s_suppkey GROUP BY 1, 2)
""")
def q_by_inliers(spark, sf_dir):
    pairs = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    fits = pairs.groupBy(F.col("c_nationkey").cast("string").alias("target"), F.col("s_nationkey").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("inliers"))
    return matchgraph.by_inliers(fits).select("target", "source", "inliers", "rank")


@query("""
WITH m AS (SELECT o_orderkey, o_orderpriority || (o_orderkey % 97) AS original, 'f' || (o_custkey % 500) AS new FROM orders)
SELECT max(o_orderkey)::VARCHAR AS idx, arg_max(original, o_orderkey) AS original, new FROM m GROUP BY new
""")
def q_original_names(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    mapping = o.select(F.col("o_orderkey").cast("string").alias("index"), F.concat(F.lit("in/"), "o_orderpriority", F.col("o_orderkey") % 97).alias("original_visible"), F.concat(F.lit("out/f"), F.col("o_custkey") % 500).alias("new_visible"))
    return organize.original_names(mapping)


@query("""
WITH p AS (SELECT user_id, min(value) AS x0, max(value) AS x1, min(hour(ts)) AS y0, max(hour(ts)) AS y1 FROM events GROUP BY user_id) SELECT user_id, x0, x1, y0::INTEGER AS y0, y1::INTEGER AS y1 FROM p
""")
def q_footprint_box(spark, sf_dir):
    corners = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("value").alias("x"), F.hour("ts").alias("y"))).alias("c"))
    return corners.select("user_id", *(c.alias(n) for n, c in surface.footprint_box(F.col("c")).items()))


@query("""
WITH f AS (SELECT c_name AS name FROM customer), p AS (SELECT DISTINCT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS visible FROM orders)
SELECT 'visible' AS side, name FROM f WHERE name NOT IN (SELECT visible FROM p)
""")
def q_unmatched(spark, sf_dir):
    pairs = _table(spark, sf_dir, "orders").select(F.format_string("Customer#%09d", "o_custkey").alias("visible")).distinct()
    return organize.unmatched(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), pairs, "name", "visible")


@query(_GRID + "SELECT count(*) AS cells, count(*) FILTER (filled) AS empty, round(avg(filled::INTEGER), 6) AS share FROM filled")
def q_empty_share(spark, sf_dir):
    return surface.empty_share(_filled(spark, sf_dir)[0]).select("cells", "empty", F.round("share", 6).alias("share"))


@query("""SELECT round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, round(avg(x) * (1 - 56.3 / sqrt(power(avg(x), 2) + power(avg(y), 2) + power(avg(z), 2))), 4) AS gx
FROM (SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS z FROM lineitem)""")
def q_mean_center(spark, sf_dir):
    poses = _table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_tax").alias("C"))
    return surface.mean_center(poses).select(*(F.round(c, 4).alias(c) for c in ("x", "y", "z", "gx")))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r = n // 2")
def q_middle(spark, sf_dir):
    return numbering.middle_row(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query("""
SELECT round(avg((x BETWEEN 5 AND 50 AND y BETWEEN 1 AND 90)::INTEGER), 6) AS fraction, avg((x BETWEEN 5 AND 50 AND y BETWEEN 1 AND 90)::INTEGER) > 0.8 AS aligned,
round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg(z), 4) AS mean_z FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, round(l_discount * 100) AS z FROM lineitem)
""")
def q_align(spark, sf_dir):
    out = surface.inside_fraction(_cloud(spark, sf_dir), (5, 50, 1, 90))
    return out.select(F.round("fraction", 6).alias("fraction"), "aligned", *(F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in "xyz"))


@query("""
SELECT c_custkey, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN '3d' ELSE '2d' END AS method FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a ON a.k = c_custkey
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON b.k = c_custkey
""")
def q_method(spark, sf_dir):
    orders, name = _table(spark, sf_dir, "orders"), lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    poses = [orders.filter(f).select(name(side, "o_custkey").alias("image")) for side, f in (("v", "o_orderstatus = 'F'"), ("t", "o_orderpriority = '1-URGENT'"))]
    pairs = _table(spark, sf_dir, "customer").select("c_custkey", name("v", "c_custkey").alias("visible"), name("t", "c_custkey").alias("thermal"))
    return registration.choose_method(pairs, poses[0].unionByName(poses[1]), "visible", "thermal").select("c_custkey", "method")


@query("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS x FROM supplier WHERE s_nationkey = (SELECT arg_max(s_nationkey, (n, -s_nationkey)) FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1))")
def q_json(spark, sf_dir):
    """A reconstruction document with one part a nation; the part with most shots is read back."""
    s = _table(spark, sf_dir, "supplier")
    shot = F.struct(F.lit("c").alias("camera"), F.array(F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(0.0)).alias("rotation"), F.array("s_acctbal", F.lit(0.0), F.lit(0.0)).alias("translation"))
    part = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").cast("string").alias("k"), shot.alias("v"))).alias("shots"))
    parts = part.agg(F.array_sort(F.collect_list(F.struct("s_nationkey", "shots"))).alias("p"))
    camera = F.create_map(F.lit("c"), F.struct(F.lit(4000).alias("width"), F.lit(3000).alias("height"), F.lit(0.9).alias("focal")))
    document = parts.select(F.to_json(F.transform("p", lambda x: F.struct(camera.alias("cameras"), F.map_from_entries(x["shots"]).alias("shots")))).alias("value"))
    path = new_path(spark, "reconstruction")
    document.write.text(path)
    found = files.read_reconstruction(spark, path)
    return found.select(F.col("shot").cast("long").alias("s_suppkey"), F.col("rotation")[0].cast("int").alias("s_nationkey"), F.round(F.col("translation")[0], 2).alias("x"))


@query()
def q_ransac(spark, sf_dir):
    """A homography planted a supplier group, with one outlier in five."""
    items = _table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") * 10, F.col("l_extendedprice") / 200
    u, v = geo.apply_homography(_H, x, y)
    out = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)) == 0
    rows = items.select((F.col("l_suppkey") % 25).alias("pair"), x.alias("x"), y.alias("y"), F.when(out, u + 200).otherwise(u).alias("u"), F.when(out, v - 150).otherwise(v).alias("v"))
    return robust.fit_groups(rows, "pair", model="homography")


@query("""
SELECT o_orderkey AS key, o_orderstatus AS status, count(l_orderkey) AS items, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def q_incremental(spark, sf_dir):
    """Bounded batches against a state table give what one large run gives."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    work = lambda df: df.join(items, "key", "left").fillna(0, ["items", "quantity"])
    return incremental.run_in_batches(orders, "key", batches=2, work=work)
