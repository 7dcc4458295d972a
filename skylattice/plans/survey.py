"""The entry points from end to end: organise, register, import matches, densify, profile.

Every step can be restarted: what has a result already is left out, results
are appended, and tables that are derived from the whole history are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import matchgraph, organize
from skylattice.operators.surface import profile
from skylattice.plans import densify, registration
from skylattice.sources import files, las
from skylattice.storage import exists, materialize


@dataclass(frozen=True)
class Organised:
    """A survey's pairs (idx, visible, thermal, new names), the files left over (side, path), and copy results if files were copied."""

    plan: DataFrame
    unmatched: DataFrame
    copied: DataFrame | None


def organise(spark: SparkSession, folder: str, target: str | None = None, threshold: float | None = None, move: bool = False) -> Organised:
    """Pair the images below ``folder`` and number them; with ``target``, copy them there under their new names.

    Thermal and visible images are told apart by their pixel counts (by
    ``threshold`` if given and not 0, else the widest gap).  Pairs share the
    last number in their names; what is left pairs by common prefixes.
    Without ``target`` nothing is written (see ``organize.dry_run``).
    """
    sizes = files.read_sizes(spark, folder).filter("error is null")
    found = files.scan_images(spark, folder).select("path").join(sizes.select("path", (F.col("width").cast("long") * F.col("height")).alias("pixels")), "path")
    found = materialize(found, "survey-files")
    cut = spark.range(1).select(F.lit(float(threshold)).alias("threshold")) if threshold else organize.auto_threshold(found, "pixels")
    kinds = materialize(organize.classify(found, "pixels", cut).select("path", "kind", organize.stem(F.col("path")).alias("s")), "survey-kinds")
    thermal, visible = (kinds.filter(F.col("kind") == k).select("path", "s") for k in ("thermal", "visible"))
    by_id = materialize(organize.pair_by_id(thermal, visible, name="path", order="path"), "survey-pairs")
    rest = [side.join(by_id.select(F.col(name).alias("path")), "path", "left_anti") for side, name in ((thermal, "thermal"), (visible, "visible"))]
    ranked = [organize.number_rows(r.groupBy("s").agg(F.min("path").alias("path")), ["path"], "o") for r in rest]
    by_prefix = organize.greedy_prefix_pairs(ranked[0], ranked[1], "s", "s", "o")
    by_prefix = by_prefix.join(ranked[0].select(F.col("s").alias("a"), F.col("path").alias("thermal")), "a").join(ranked[1].select(F.col("s").alias("b"), F.col("path").alias("visible")), "b")
    both = by_id.unionByName(by_prefix.select(organize.extract_id(F.col("a")).alias("id"), "thermal", "visible"))
    numbered = organize.planned_names(organize.number_pairs(both))
    plan = materialize(numbered.withColumn("idx", F.format_string("%04d", "idx")), "survey-plan")
    left = [organize.unmatched(side, plan, "path", name) for side, name in ((thermal.select("path"), "thermal"), (visible.select("path"), "visible"))]
    copied = files.copy_planned(plan, target, move) if target else None
    return Organised(plan, left[0].unionByName(left[1]), copied)


def mapping(plan: DataFrame) -> DataFrame:
    """The table of original and new names."""
    return plan.select(F.col("idx").alias("index"), F.col("visible").alias("original_visible"), F.col("thermal").alias("original_thermal"), "new_visible", "new_thermal")


def load_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """idx, visible, thermal: the contents of organised pairs; images without a partner are left out."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    sides = [files.index_folder(content.select("path"), tag).join(content, "path").select("idx", F.col("content").alias(name)) for tag, name in (("V", "visible"), ("T", "thermal"))]
    return sides[0].join(sides[1], "idx")


def register(pairs: DataFrame, raw: DataFrame, results: str, config: registration.CalibrationConfig = registration.CalibrationConfig(), limit: int | None = None, again: bool = False) -> registration.Calibration:
    """Calibrate once, and warp what is pending: pairs (idx, visible, thermal) into the table ``results``/warped.

    At most ``limit`` pairs a run; failed pairs are not stored and come again.
    """
    spark = pairs.sparkSession
    found = registration.calibrate_once(raw, f"{results}/calibration", config, again)
    path = f"{results}/warped"
    done = spark.read.parquet(path).select("idx") if exists(spark, path) else pairs.select("idx").limit(0)
    todo = organize.pending(pairs, done, "idx", F.col("idx"), limit)
    registration.apply_calibration(todo, found).filter("error is null").drop("error").write.mode("append").parquet(path)
    return found


def import_matches(candidates: DataFrame, results: str, min_matches: int = 1) -> int:
    """Append the matches (image_a, kp_a, image_b, kp_b) of pairs that were never imported, and their status; the number of new pairs.

    Both tables of ``results`` are appended in one pass.  The matches come
    first, and pairs that already have some are not written again, so a run
    that was cut short is made good by the next one.
    """
    spark = candidates.sparkSession
    status_path, inlier_path = f"{results}/pairs.csv", f"{results}/inliers.csv"
    rows = matchgraph.canonical(candidates.filter("image_a <> image_b")).select("image_a", "image_b", "kp_a", "kp_b")
    status = files.read_table(spark, status_path, files.PAIR_STATUS)
    new = materialize(matchgraph.pair_status(rows, status.select("image_a", "image_b"), min_matches), "new-pairs")
    kept = files.read_table(spark, inlier_path, files.INLIERS).select("image_a", "image_b").distinct()
    todo = new.filter("verified = 1").join(kept, ["image_a", "image_b"], "left_anti").select("image_a", "image_b")
    files.append_rows(materialize(rows.join(todo, ["image_a", "image_b"], "left_semi"), "new-matches"), inlier_path, files.INLIERS)
    files.append_rows(new, status_path, files.PAIR_STATUS)
    return new.count()


def build_tracks(spark: SparkSession, results: str) -> DataFrame:
    """Tracks over the whole match history, which are also exported; rows of the history are ordered by their ends."""
    rows = files.read_table(spark, f"{results}/inliers.csv", files.INLIERS)
    rows = organize.number_rows(rows, ["image_a", "image_b", "kp_a", "kp_b"], "r", 0)
    tracks = materialize(matchgraph.create_tracks(rows), "tracks")
    files.export_tracks(tracks, f"{results}/tracks.csv")
    return tracks


def densify_survey(visible: DataFrame, points: DataFrame, results: str, rule: densify.FillRule = densify.FULL) -> DataFrame:
    """Fill all images that have no dense output yet from their neighbours, and append the outputs to ``results``/dense.

    ``visible`` has idx and visible (PNG), ``points`` image, kp, x, y in
    native pixels; warped images and matches are those in ``results``.
    """
    spark = visible.sparkSession
    path = f"{results}/dense"
    done = spark.read.parquet(path).filter("dense is not null") if exists(spark, path) else None
    warped = spark.read.parquet(f"{results}/warped").select("idx", F.col("warped").alias("own"))
    targets = visible.join(warped, "idx")
    if done is not None:
        targets = targets.join(done.select("idx"), "idx", "left_anti")
    tracks = build_tracks(spark, results)
    matches = files.read_table(spark, f"{results}/inliers.csv", files.INLIERS)
    edges = matchgraph.edge_weights(matches).select(F.col("a").cast("long"), F.col("b").cast("long"), "weight")
    fits = densify.neighbour_fits(tracks, points, rule.least)
    out = densify.fill_by_matches(targets, fits, edges, rule, done)
    out = materialize(out, "dense")
    out.write.mode("append").parquet(path)
    return out


def cloud_profile(spark: SparkSession, path: str) -> DataFrame:
    """section, key, value of a point cloud: bounding box, classes, intensities, and whether points have a colour."""
    las.register(spark)
    points = spark.read.format("las").load(path)
    colour = points.agg((F.count("red") > 0).cast("double").alias("value")).select(F.lit("colour").alias("section"), F.lit("rgb").alias("key"), "value")
    return profile(points, "classification", "intensity").unionByName(colour)
