"""The match graph: pairs, tracks, correspondences and fill order."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.components import connected_components
from skylattice.operators.numbering import number_rows
from skylattice.storage import materialize

#: Matches that verify a pair, and distinct images that make a track.
MIN_MATCHES, MIN_TRACK = 15, 2


def canonical(matches: DataFrame) -> DataFrame:
    """Matches with image_a < image_b as strings, key points swapped along."""
    swap = F.col("image_a") > F.col("image_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    columns = {"image_a": pick("image_a", "image_b"), "image_b": pick("image_b", "image_a")}
    if "kp_a" in matches.columns:
        columns |= {"kp_a": pick("kp_a", "kp_b"), "kp_b": pick("kp_b", "kp_a")}
    return matches.withColumns(columns)


def edge_weights(matches: DataFrame) -> DataFrame:
    """a, b, weight for both directions of each pair of images."""
    one = canonical(matches).groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("weight"))
    return one.select(F.explode(F.array(F.struct(F.col("image_a").alias("a"), F.col("image_b").alias("b")), F.struct(F.col("image_b").alias("a"), F.col("image_a").alias("b")))).alias("e"), "weight").select("e.*", "weight")


def pair_status(candidates: DataFrame, history: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """image_a, image_b, verified, inliers of candidate pairs that were never tried."""
    new = canonical(candidates).groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("inliers"))
    new = new.join(canonical(history).select("image_a", "image_b").distinct(), ["image_a", "image_b"], "left_anti")
    return new.select("image_a", "image_b", (F.col("inliers") >= min_matches).cast("int").alias("verified"), "inliers")


def involved(run: DataFrame, edges: DataFrame) -> DataFrame:
    """The images of a run and their candidates: image."""
    near = edges.join(run.select(F.col("image").alias("a")), "a", "left_semi").select(F.col("b").alias("image"))
    return run.select("image").union(near).distinct()


def between(edges: DataFrame, images: DataFrame) -> DataFrame:
    """Edges with both ends among the images."""
    return edges.join(images.select(F.col("image").alias("a")), "a", "left_semi").join(images.select(F.col("image").alias("b")), "b", "left_semi")


def create_tracks(matches: DataFrame, min_length: int = MIN_TRACK) -> DataFrame:
    """track_id, image, feature_id, seq, n_images: components of the whole match history.

    ``matches`` has r (the row's position, unique), image_a, kp_a, image_b,
    kp_b.  Nodes are numbered by first appearance, a before b; tracks with at
    least ``min_length`` distinct images are numbered from 0 by their first
    node.
    """
    obs = matches.select("image_a", "kp_a", (2 * F.col("r")).alias("seq")).toDF("image", "kp", "seq")
    obs = obs.union(matches.select("image_b", "kp_b", 2 * F.col("r") + 1))
    node = materialize(obs.groupBy("image", "kp").agg(F.min("seq").alias("seq")), "track-nodes")
    # a node is named by the place of its first appearance, so the least name of a component is its first node
    ends = matches.select("r", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("image_a").alias("image"), F.col("kp_a").alias("kp")), F.struct(F.lit(1).alias("end"), F.col("image_b").alias("image"), F.col("kp_b").alias("kp")))).alias("e"))
    ends = ends.select("r", "e.*").join(node, ["image", "kp"])
    edges = ends.groupBy("r").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    label = connected_components(edges).withColumnRenamed("node", "seq")
    member = materialize(node.join(label, "seq"), "track-members")
    length = member.groupBy("component").agg(F.count_distinct("image").alias("n_images")).filter(F.col("n_images") >= min_length)
    numbered = number_rows(length, ["component"], "track_id", 0)
    out = member.join(numbered, "component")
    return out.select("track_id", "image", F.col("kp").alias("feature_id"), "seq", "n_images")


def track_summary(tracks: DataFrame) -> DataFrame:
    """One row: tracks, longest track, tracks in three or more images."""
    one = tracks.groupBy("track_id").agg(F.first("n_images").alias("n"))
    return one.agg(F.count(F.lit(1)).alias("tracks"), F.max("n").alias("longest"), F.count_if(F.col("n") >= 3).alias("in_three"))


def correspondences(tracks: DataFrame) -> DataFrame:
    """a, b, kp_a, kp_b: every point of ``a`` in a track with the last point of ``b`` there; not symmetric."""
    last = tracks.groupBy("track_id", "image").agg(F.max_by("feature_id", "seq").alias("kp_b"))
    last = last.select("track_id", F.col("image").alias("b"), "kp_b")
    own = tracks.select("track_id", F.col("image").alias("a"), F.col("feature_id").alias("kp_a"))
    return own.join(last, "track_id").filter("a <> b").select("a", "b", "kp_a", "kp_b")


def reachable(tracks: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """a, b, shared, rank: other images that share tracks, most shared points first, ties by image number."""
    shared = correspondences(tracks).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    if available is not None:
        shared = shared.join(available.select(F.col("image").alias("b")), "b", "left_semi")
    w = Window.partitionBy("a").orderBy(F.desc("shared"), F.col("b").try_cast("long"), F.col("b"))
    return shared.withColumn("rank", F.row_number().over(w)).select("a", "b", "shared", "rank")


def by_inliers(fits: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """``fits`` (target, source, inliers) with rank: most inliers first, ties by image number; sources without an output are left out."""
    if available is not None:
        fits = fits.join(available.select(F.col("image").alias("source")), "source", "left_semi")
    w = Window.partitionBy("target").orderBy(F.desc("inliers"), F.col("source").try_cast("long"), F.col("source"))
    return fits.withColumn("rank", F.row_number().over(w))


def fragmentation(edges: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """component, size, share, fragmented of the ``top`` largest components; fragmented: the largest holds under half of all images."""
    sizes = component_sizes(edges, nodes)
    total = sizes.agg(F.sum("size").alias("n"), F.max("size").alias("most"))
    out = sizes.join(F.broadcast(total)).select("component", "size", F.try_divide("size", "n").alias("share"), (2 * F.col("most") < F.col("n")).alias("fragmented"))
    return out.orderBy(F.desc("size"), "component").limit(top)


def component_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, size over all nodes; a node without edges is its own component.  ``a``, ``b`` and ``node`` are integers."""
    label = connected_components(edges)
    full = nodes.join(label, "node", "left").select(F.coalesce("component", "node").alias("component"))
    return full.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def fill_order(edges: DataFrame, pending: DataFrame, seeds: DataFrame) -> DataFrame:
    """step, image, predecessor, weight: best-first expansion from the seeds.

    The heaviest edge to a pending image goes next, ties to the smaller image;
    with none left, the pending image with the greatest total weight starts a
    new component.  The rule is sequential over all images, so it runs in one
    task, on the edges between images only.
    """
    rows = edges.select(F.lit(0).alias("kind"), F.col("a").cast("long"), F.col("b").cast("long"), F.col("weight").cast("long"))
    rows = rows.union(pending.select(F.lit(1), F.col("image").cast("long"), F.lit(None), F.lit(None)))
    rows = rows.union(seeds.select(F.lit(2), F.col("image").cast("long"), F.lit(None), F.lit(None)))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        near, total = defaultdict(list), defaultdict(int)
        edge = pdf[pdf.kind == 0]
        for a, b, w in zip(edge.a, edge.b, edge.weight, strict=True):
            near[a].append((b, int(w)))
            total[a] += int(w)
        left = set(pdf.a[pdf.kind == 1])
        heap, out = [], []

        def push(image) -> None:
            for b, w in near[image]:
                if b in left:
                    heapq.heappush(heap, (-w, b, image))

        for image in sorted(pdf.a[pdf.kind == 2]):
            push(image)
        while left:
            while heap and heap[0][1] not in left:
                heapq.heappop(heap)
            if heap:
                w, image, source = heapq.heappop(heap)
                out.append((image, source, -w))
            else:
                image = min(left, key=lambda i: (-total[i], i))
                out.append((image, None, 0))
            left.discard(image)
            push(image)
        return pd.DataFrame([(i, *o) for i, o in enumerate(out)], columns=["step", "image", "predecessor", "weight"]).astype({"predecessor": "Int64"})

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(order, "step long, image long, predecessor long, weight long")
