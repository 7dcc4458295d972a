"""Filling of images from their neighbours: by matches, wave by wave, or by poses.

An image and the layers that fill it meet in one task; their number is the
image's neighbours, whatever the survey's size.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators import matchgraph, raster, robust
from skylattice.operators.numbering import random_sample
from skylattice.operators.rays import Grid, Ground, Pose, footprint, reprojection, warp_map
from skylattice.operators.surface import mean_center, overlapping_boxes
from skylattice.plans.registration import fill_waves
from skylattice.storage import broadcast_if_small, materialize

#: Cells of a surface that the driver takes and every task gets.
GRID_CELLS = 16_000_000


@dataclass(frozen=True)
class FillRule:
    """How layers fill a target; the named rules are the variants of the survey's matrix."""

    alpha: str = "relative"  # see raster.alpha_mask
    dilate: int = 0
    feather: int = 0
    box: bool = False  # write around the matched points only
    inpaint: int = 0  # radius by which the rest is filled in; 0 leaves it
    nearest: bool = False
    least: int = 15  # shared points of a neighbour


#: Full frame, hard edges; around the points, blended; full frame, blended; by poses, exact pixels.
FULL, BOXED, BLENDED, EXACT = FillRule(), FillRule("half", 8, 15, True, 5, least=4), FillRule("half", 8, 15, False, 5, least=4), FillRule("positive", nearest=True)
_ERRORS = (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error, np.linalg.LinAlgError)


@dataclass
class Layer:
    """A neighbour: its RGBA image, and a transform into the target's frame or a map of where target pixels are in it."""

    name: str
    image: np.ndarray
    m: np.ndarray | None = None
    field: tuple | None = None
    points: np.ndarray | None = None

    def place(self, size: tuple[int, int], rule: FillRule) -> tuple[np.ndarray, np.ndarray]:
        """Colour and mask in the target's frame of (width, height)."""
        color, alpha = self.image[..., :3], self.image[..., 3]
        if self.field is not None:
            gx, gy, u, v = self.field
            u, v = (raster.upsample(gx, gy, f, *size) for f in (u, v))
            color, _ = raster.remap(color, u, v, rule.nearest)
            alpha, inside = raster.remap(alpha, u, v, rule.nearest)
        else:
            if not np.isfinite(self.m).all() or abs(np.linalg.det(self.m)) < 1e-9:
                raise ValueError("a degenerate transform")
            color, _ = raster.warp(color, self.m, size, rule.nearest)
            alpha, inside = raster.warp(alpha, self.m, size, rule.nearest)
        mask = raster.alpha_mask(alpha, rule.alpha) & inside if alpha.any() else np.zeros(alpha.shape, bool)
        if rule.box:
            x0, y0, x1, y1 = raster.crop_box(self.points, *size, rule.dilate + 2)
            only = np.zeros(mask.shape, bool)
            only[y0:y1, x0:x1] = True
            mask &= only
        return raster.dilate(color, mask, rule.dilate)


def fill_image(visible: np.ndarray, own: np.ndarray | None, layers: list[Layer], rule: FillRule) -> dict:
    """dense, real (mask of true content), before and after (covered shares), sources, errors.

    The own layer comes first, then the others in order; the first that is
    valid at a pixel wins.  A neighbour that fails is left out and named.
    What is filled in by guessing is never part of ``real``.
    """
    dense, covered, errors, used = visible.copy(), np.zeros(visible.shape[:2], bool), [], 0
    if own is not None:
        color, mask = raster.dilate(own[..., :3], own[..., 3] > 0, rule.dilate)
        dense, covered = raster.composite(dense, covered, color, mask)
        used = 1
    before = float(covered.mean())
    for layer in layers:
        try:
            color, mask = layer.place((visible.shape[1], visible.shape[0]), rule)
        except _ERRORS as e:
            errors.append(f"{layer.name}: {type(e).__name__}: {e}")
            continue
        dense, covered = raster.composite(dense, covered, color, mask, rule.feather)
        used += 1
    real = covered.copy()
    if rule.inpaint and not covered.all() and covered.any():
        dense = raster.inpaint(dense, ~covered, rule.inpaint)
    return {"dense": dense, "real": real, "before": before, "after": float(real.mean()), "sources": used, "errors": errors}


_POSE = ("K", "R", "t", "C")
_FILLED = "idx string, dense binary, sidecar binary, real binary, before double, after double, sources int, errors array<string>"


def _pose(r, prefix: str) -> Pose:
    k, rot, t, c = (np.array(getattr(r, f"{prefix}{n}"), float) for n in _POSE)
    return Pose(k.reshape(3, 3), rot.reshape(3, 3), t, c)


def fill_targets(targets: DataFrame, layers: DataFrame, rule: FillRule, ground: Ground | None = None) -> DataFrame:
    """idx, dense, sidecar (RGBA of the true content), real (its mask), before, after, sources, errors: PNGs of filled targets.

    ``targets`` has idx, visible, own (PNG or null); ``layers`` idx, source,
    rank, image (RGBA PNG) and either m (nine doubles) with points (flat x, y
    pairs; only for ``box``), or with ``ground`` the poses a_* of the target
    and b_* of the source.  A target that fails reports why.
    """

    def run(key: tuple, one: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in one.itertuples():
            try:
                visible = raster.three_channels(raster.decode_png(bytes(r.visible)))
                own = raster.decode_png(bytes(r.own), alpha=True) if r.own is not None else None
                placed, broken = [], []
                for o in others.sort_values(["rank", "source"]).itertuples():
                    try:
                        image = raster.decode_png(bytes(o.image), alpha=True)
                        if ground is not None:
                            layer = Layer(o.source, image, field=warp_map(_pose(o, "a_"), _pose(o, "b_"), visible.shape[1], visible.shape[0], ground))
                        else:
                            points = np.array(o.points, float).reshape(-1, 2) if rule.box else None
                            layer = Layer(o.source, image, np.array(o.m, float).reshape(3, 3), points=points)
                        placed.append(layer)
                    except _ERRORS as e:
                        broken.append(f"{o.source}: {type(e).__name__}: {e}")
                got = fill_image(visible, own, placed, rule)
                real = got["real"].astype(np.uint8) * 255
                side = np.dstack([np.where(got["real"][..., None], got["dense"], 0).astype(np.uint8), real])
                out.append((r.idx, *map(raster.encode_png, (got["dense"], side, real)), got["before"], got["after"], got["sources"], broken + got["errors"]))
            except _ERRORS as e:
                out.append((r.idx, None, None, None, None, None, 0, [f"{type(e).__name__}: {e}"]))
        return pd.DataFrame(out, columns=["idx", "dense", "sidecar", "real", "before", "after", "sources", "errors"])

    return targets.groupBy("idx").cogroup(layers.groupBy("idx")).applyInPandas(run, _FILLED)


def neighbour_fits(tracks: DataFrame, points: DataFrame, least: int = 15) -> DataFrame:
    """target, source, shared, inliers, m, points: transforms from source to target frames by shared track points.

    ``points`` has image, kp, x, y.  Neighbours with fewer than ``least``
    shared points, or without a fit of four inliers, are left out.
    """
    pairs = matchgraph.correspondences(tracks)
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= max(4, least))
    at = lambda image, kp, x, y: points.select(F.col("image").alias(image), F.col("kp").alias(kp), F.col("x").alias(x), F.col("y").alias(y))
    rows = pairs.join(counts, ["a", "b"]).join(at("a", "kp_a", "u", "v"), ["a", "kp_a"]).join(at("b", "kp_b", "x", "y"), ["b", "kp_b"])
    rows = materialize(rows.withColumn("pair", F.to_json(F.struct("a", "b"))), "neighbour-points")
    fits = robust.fit_groups(rows.select("pair", "x", "y", "u", "v"), "pair").filter("m is not null and inliers >= 4")
    box = rows.groupBy("a", "b", "pair").agg(F.first("shared").alias("shared"), F.array(F.min("u"), F.min("v"), F.max("u"), F.max("v")).alias("points"))
    return box.join(fits.select("pair", "inliers", "m"), "pair").select(F.col("a").alias("target"), F.col("b").alias("source"), "shared", "inliers", "m", "points")


def fill_by_matches(targets: DataFrame, fits: DataFrame, edges: DataFrame, rule: FillRule = FULL, done: DataFrame | None = None) -> DataFrame:
    """The dense outputs of ``targets`` (idx, visible, own), best-first.

    Images of one wave do not read each other and are one job; a neighbour
    that is filled already, in this run or in ``done`` (idx, sidecar), gives
    its filled pixels, else its own.  ``edges`` (a, b, weight) give the order.
    """
    targets = materialize(targets, "fill-targets")
    images = targets.select(F.col("idx").cast("long").alias("image"))
    past = targets.select("idx", F.lit(None).cast("binary").alias("sidecar")).limit(0) if done is None else done.select("idx", "sidecar")
    seeds = past.select(F.col("idx").cast("long").alias("image"))
    order = matchgraph.fill_order(edges, images.join(seeds, "image", "left_anti"), seeds)
    waves = materialize(fill_waves(order, edges), "fill-waves")
    ranked = materialize(matchgraph.by_inliers(fits), "fill-ranks")
    raw = targets.filter("own is not null").select(F.col("idx").alias("source"), F.col("own").alias("image"))
    out = None
    for wave in range((waves.agg(F.max("wave")).first()[0] or 0) + 1 if not waves.isEmpty() else 0):
        now = waves.filter(F.col("wave") == wave).select(F.col("image").alias("__n"))
        mine = targets.join(F.broadcast(now), F.col("idx").cast("long") == F.col("__n")).drop("__n")  # images of a wave
        dense = past.select(F.col("idx").alias("source"), F.col("sidecar").alias("image")).filter("image is not null")
        best = dense.unionByName(raw.join(dense.select("source"), "source", "left_anti"))
        layers = ranked.join(F.broadcast(mine.select(F.col("idx").alias("target"))), "target").join(best, "source")
        got = materialize(fill_targets(mine, layers.withColumnRenamed("target", "idx"), rule), "filled-wave")
        out = got if out is None else out.unionByName(got)
        past = past.unionByName(got.select("idx", "sidecar"))
    return out if out is not None else fill_targets(targets.limit(0), ranked.withColumnsRenamed({"target": "idx"}).withColumn("image", F.lit(None).cast("binary")).limit(0), rule)


def surface_grid(grid: DataFrame, extent: DataFrame, resolution: float) -> Grid:
    """A filled surface as an array on the driver; refused beyond :data:`GRID_CELLS` cells."""
    box = extent.first()
    if box.nx * box.ny > GRID_CELLS:
        raise ValueError(f"{box.nx} x {box.ny} cells are too many for one array: use coarser cells")
    table = grid.select("iy", "ix", "z").toArrow()
    z = np.full((box.ny, box.nx), np.nan)
    z[table.column("iy").to_numpy(), table.column("ix").to_numpy()] = table.column("z").to_numpy()
    return Grid(z, box.x_min, box.y_min, resolution)


def plane_or_surface(poses: DataFrame, load: Callable[[], tuple[Grid, Callable]] | None = None, altitude: float = 56.3) -> tuple[Ground, str]:
    """The ground below the cameras, and which it is: a loaded surface, or the flat plane where loading fails, with the reason."""
    r = mean_center(poses, altitude).first()
    point = np.array([r.gx, r.gy, r.gz], float)
    up = point / np.linalg.norm(point)
    plane = Ground(float(point @ up), up)
    if load is None:
        return plane, "plane"
    try:
        grid, to_grid = load()
    except Exception as e:  # whatever is wrong with the surface, the plane is still there
        return plane, f"plane: {type(e).__name__}: {e}"
    return Ground(plane.height, up, grid, to_grid), "surface"


def footprints(poses: DataFrame, ground: Ground) -> DataFrame:
    """idx, x0, x1, y0, y1: boxes of what images (idx, width, height, K, R, t, C) see; images that see no ground are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                p = footprint(_pose(r, ""), int(r.width), int(r.height), ground)
                p = p[np.isfinite(p).all(axis=1)]
                if len(p):
                    rows.append((r.idx, p[:, 0].min(), p[:, 0].max(), p[:, 1].min(), p[:, 1].max()))
            yield pd.DataFrame(rows, columns=["idx", "x0", "x1", "y0", "y1"])

    return poses.mapInPandas(run, "idx string, x0 double, x1 double, y0 double, y1 double")


def validate_poses(pairs: DataFrame, poses: DataFrame, matches: DataFrame, ground: Ground, limit: float = 50.0, n: int = 8, seed: int = 0) -> tuple[bool, float]:
    """Whether poses may fill, and the pooled RMSE in pixels over ``n`` random overlapping pairs with independent matches.

    ``matches`` has a, b, x0, y0, x1, y1.  Without evidence: no.
    """
    some = random_sample(pairs, n, ["a", "b"], seed)
    both = lambda side: poses.select(F.col("idx").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _POSE))
    rows = matches.join(F.broadcast(some), ["a", "b"]).join(both("a"), "a").join(both("b"), "b")  # n pairs

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = next(pdf.itertuples())
        e = reprojection(_pose(r, "a_"), _pose(r, "b_"), pdf[["x0", "y0"]].to_numpy(float), pdf[["x1", "y1"]].to_numpy(float), ground)
        return pd.DataFrame({"n": [len(e)], "se": [float((e**2).sum())]})

    total = rows.groupBy("a", "b").applyInPandas(run, "n long, se double").agg(F.sum("n").alias("n"), F.sum("se").alias("se")).first()
    rmse = float(np.sqrt(total.se / total.n)) if total.n else float("inf")
    return rmse <= limit, rmse


def fill_by_poses(targets: DataFrame, poses: DataFrame, matches: DataFrame, ground: Ground, cell: float, limit: float = 50.0) -> tuple[DataFrame | None, str]:
    """The dense outputs of targets (idx, visible, own) with a pose, by geometry alone, and why there are none if there are none.

    Pairs of images whose footprints overlap fill each other with exact
    pixels, in the order of their numbers, after the poses have been
    validated on independent matches.  Targets without a pose are left to
    :func:`fill_by_matches`.
    """
    boxes = materialize(footprints(poses, ground), "footprints")
    pairs = materialize(overlapping_boxes(boxes, "idx", cell, cell_y=cell), "overlaps")
    fine, rmse = validate_poses(pairs, poses, matches, ground, limit)
    if not fine:
        return None, f"the poses are not confirmed: RMSE {rmse:.1f} pixels"
    near = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    warped = targets.filter("own is not null").select(F.col("idx").alias("b"), F.col("own").alias("image"))
    named = lambda side: poses.select(F.col("idx").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _POSE))
    layers = near.join(warped, "b").join(broadcast_if_small(named("a")), "a").join(broadcast_if_small(named("b")), "b")
    rank = F.coalesce(F.col("b").try_cast("long"), F.lit(1 << 62))
    layers = layers.withColumns({"idx": F.col("a"), "source": F.col("b"), "rank": rank})
    posed = targets.join(broadcast_if_small(poses.select("idx")), "idx", "left_semi")
    return fill_targets(posed, layers, EXACT, ground), "poses"
