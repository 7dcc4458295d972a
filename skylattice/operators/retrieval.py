"""Candidate retrieval: TF-IDF, cosine neighbours, ratio test, visual words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.storage import BROADCAST_NESTED_BYTES, estimated_bytes, materialize


def tfidf(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """doc, term, tf, df, weight: idf ln((N+1)/(df+1)), rows scaled to unit length; a zero row stays zero.

    ``terms`` has a row per occurrence.  N counts the documents that occur.
    """
    tf = materialize(terms.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(doc).alias("n"))
    raw = tf.join(df, term).join(F.broadcast(n)).withColumn("w", F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)))  # one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    weight = F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.lit(0.0))
    return raw.withColumn("norm", norm).select(doc, term, "tf", "df", weight.alias("weight"))


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, rows: int) -> tuple[DataFrame, int]:
    n = vectors.count()
    blocks = max(1, math.ceil(n / rows))
    dealt = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows")), blocks  # about ``rows`` each


def _side(column: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    flat = column.slice(r, 1).flatten()
    ids = np.asarray(flat.field("id"))
    v = flat.field("v")
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _pairs_of_blocks(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, rows: int) -> DataFrame:
    a, _ = _blocks(left, id_col, vec_col, rows)
    b, n = _blocks(right, id_col, vec_col, rows)
    a = a.select("rows", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    spread = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(spread).join(b.withColumnRenamed("rows", "others"), "block").select("rows", "others")


def top_cosine(vectors: DataFrame, id_col: str, vec_col: str, m: int, rows: int = 1024, digits: int = 6) -> DataFrame:
    """a, b, sim, rank: the ``m`` most similar others of each row by rounded cosine > 0, ties to the larger id.

    Exact, in blocks: a task multiplies two blocks and keeps ``m`` a row, so
    no pair but these leaves it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ia, va), (ib, vb) = _side(batch.column(0), r), _side(batch.column(1), r)
                length = lambda v: np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
                sim = np.round((va / length(va)) @ (vb / length(vb)).T, digits)
                sim[ia[:, None] == ib[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(-ib, sim.shape), -sim), axis=1)[:, :m]
                score = np.take_along_axis(sim, order, 1).ravel()
                a, b = np.repeat(ia, order.shape[1]), ib[order].ravel()
                ok = score > 0
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(score[ok])], ["a", "b", "sim"])

    near = _pairs_of_blocks(vectors, vectors, id_col, vec_col, rows).mapInArrow(kernel, "a long, b long, sim double")
    w = Window.partitionBy("a").orderBy(F.desc("sim"), F.desc("b"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m)


def ratio_matches(left: DataFrame, right: DataFrame, id_col: str, vec_col: str, ratio: float = 0.75, rows: int = 1024) -> DataFrame:
    """a, b: nearest descriptor of the right for each of the left, if nearer than ``ratio`` times the second nearest.

    Exact Euclidean distances in blocks; fewer than two on the right give
    none, and equal distances go to the smaller id (and fail the test).
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ia, va), (ib, vb) = _side(batch.column(0), r), _side(batch.column(1), r)
                for at in range(0, len(ia), 64):
                    d = np.sqrt(((va[at : at + 64, None, :] - vb[None, :, :]) ** 2).sum(axis=2))
                    order = np.lexsort((np.broadcast_to(ib, d.shape), d), axis=1)[:, :2]
                    a, b = np.repeat(ia[at : at + 64], order.shape[1]), ib[order].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.take_along_axis(d, order, 1).ravel())], ["a", "b", "d"])

    near = _pairs_of_blocks(left, right, id_col, vec_col, rows).mapInArrow(kernel, "a long, b long, d double")
    w = Window.partitionBy("a").orderBy("d", "b")
    near = near.withColumn("second", F.lead("d").over(w)).withColumn("r", F.row_number().over(w))
    return near.filter((F.col("r") == 1) & (F.col("d") < ratio * F.col("second"))).select("a", "b")


def nearest_word(vectors: DataFrame, words: DataFrame, id_col: str, vec_col: str, word_col: str, center_col: str, limit: int = BROADCAST_NESTED_BYTES) -> DataFrame:
    """id, word: the nearest centre of each vector, ties to the smaller word.

    A vocabulary of at most ``limit`` bytes goes to every task as one row; a
    larger one meets the vectors in blocks.
    """
    words = materialize(words.select(F.col(word_col).alias("w"), F.col(center_col).cast("array<double>").alias("c")), "words")
    x = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    if estimated_bytes(words) > limit:
        return _nearest_in_blocks(x, words)
    book = words.agg(F.sort_array(F.collect_list(F.struct("w", "c"))).alias("book"))
    far = lambda c: F.aggregate(F.zip_with("v", c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y)
    best = F.array_min(F.transform("book", lambda e: F.struct(far(e["c"]).alias("d"), e["w"].alias("w"))))
    return x.join(F.broadcast(book)).select("id", best["w"].alias("word"))


def _nearest_in_blocks(x: DataFrame, words: DataFrame, rows: int = 1024) -> DataFrame:
    """The same, a block of vectors and a block of words at a time; words are numbers here."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ia, va), (ib, vb) = _side(batch.column(0), r), _side(batch.column(1), r)
                order = np.argsort(ib, kind="stable")
                ib, vb = ib[order], vb[order]
                d = np.stack([((v - vb) ** 2).sum(axis=1) for v in va])
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ia), pa.array(ib[at]), pa.array(d[np.arange(len(ia)), at])], ["id", "word", "d"])

    book = words.select(F.col("w").alias("id"), F.col("c").alias("v"))
    near = _pairs_of_blocks(x, book, "id", "v", rows).mapInArrow(kernel, "id long, word long, d double")
    best = near.groupBy("id").agg(F.min(F.struct("d", "word")).alias("b"))
    return best.select(F.col("id").cast(x.schema["id"].dataType).alias("id"), F.col("b.word").cast(words.schema["w"].dataType).alias("word"))


def vocabulary(vectors: DataFrame, vec_col: str, n_words: int = 750, sample: int = 200_000, seed: int = 0) -> DataFrame:
    """word, center by k-means over at most ``sample`` descriptors; k = min(n_words, max(2, n // 10))."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(F.col(vec_col).cast("array<double>").alias("v"))
    n = rows.count()
    if n > sample:
        rows = rows.orderBy(F.xxhash64("v", F.lit(seed))).limit(sample)
        n = sample
    k = min(n_words, max(2, n // 10))
    model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="f").fit(rows.select(array_to_vector("v").alias("f")))
    spark = vectors.sparkSession
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "word int, center array<double>")
