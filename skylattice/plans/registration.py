"""Calibration and neighbour filling put together from the operators."""

from __future__ import annotations

import io
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geometry as geo
from skylattice.operators import raster, robust
from skylattice.operators.composite import first_valid
from skylattice.operators.numbering import even_sample
from skylattice.storage import exists, materialize, replace_table


class TooFewMatches(ValueError):
    """The pool cannot support a transform."""


@dataclass(frozen=True)
class CalibrationConfig:
    """Parameters of a calibration; see the coverage table for their defaults."""

    model: str = "homography"
    width: int = 640
    height: int = 480
    sample_pairs: int = 25
    high: float = 0.5
    low: float = 0.15
    threshold: float = 3.0
    min_matches: int = 20
    min_inliers: int = 15
    min_ratio: float = 0.25
    scale_range: tuple[float, float] = (0.3, 3.0)
    max_rotation: float = 25.0
    max_anisotropy: float = 1.6


@dataclass(frozen=True)
class Calibration:
    """A fitted transform from thermal to visible in the work frame.

    ``field`` is (gx, gy, correction): where to read, beside a visible pixel,
    in the thermal image that the transform has warped there.
    """

    m: list[float]
    model: str
    n_pooled: int
    n_inliers: int
    rmse: float
    k: float
    center: tuple[float, float]
    scale: float
    field: tuple | None
    width: int = 640
    height: int = 480
    n_pairs: int = 0
    warnings: tuple[str, ...] = ()


def calibrate(matches: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> Calibration:
    """One transform, thermal (x1, y1) to visible (x0, y0), for all pairs from matches (idx, x0, y0, x1, y1, conf) of an even sample of pairs.

    The confident pool is fitted robustly; less confident matches that agree
    with the fit replace it, and the fit is repeated (if that fails, the first
    one stays).  A lens coefficient (only for homographies) and a residual
    field follow where there are points enough, from all points.  A low share
    of inliers and an implausible transform only warn.

    The fit is sequential, so the pool of ``sample_pairs`` pairs (a few
    thousand matches each) comes to the driver as arrays.
    """
    pairs = matches.select("idx").distinct()
    sample = even_sample(pairs.withColumn("number", F.col("idx").try_cast("long")), ["number", "idx"], config.sample_pairs)
    pool = matches.join(F.broadcast(sample.select("idx")), "idx").filter(F.col("conf") >= config.low)  # sample_pairs rows
    held = pool.select(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "conf"))).toArrow()
    rows = np.column_stack([c.to_numpy() for c in held.columns]).reshape(-1, 5)
    rows = rows[np.lexsort(rows.T[3::-1])]
    # visible points first, thermal ones second
    q, p, conf = rows[:, :2], rows[:, 2:4], rows[:, 4]
    sure = conf >= config.high
    if sure.sum() < config.min_matches:
        raise TooFewMatches(f"{sure.sum()} confident matches; {config.min_matches} are needed")
    m, ok = robust.consensus(p[sure], q[sure], config.model, config.threshold)
    if m is None:
        raise TooFewMatches("no transform fits the confident matches")
    near = np.sqrt(((robust.project(m, p) - q) ** 2).sum(axis=1)) < config.threshold
    again, fine = robust.consensus(p[near], q[near], config.model, config.threshold)
    notes = []
    if again is None:
        notes.append("the fit after guided recovery failed")
        p, q = p[sure], q[sure]
    else:
        m, ok, p, q = again, fine, p[near], q[near]
    pooled = len(p)
    if ok.sum() < config.min_inliers:
        raise TooFewMatches(f"{int(ok.sum())} of {pooled} matches agree; {config.min_inliers} are needed")
    if ok.mean() < config.min_ratio:
        notes.append(f"only {ok.mean():.0%} of the matches agree")
    notes += check_transform(m, config)
    p, q = p[ok], q[ok]
    center, scale, k = (config.width / 2, config.height / 2), float(np.hypot(config.width, config.height) / 2), 0.0
    if config.model == "homography":
        m, k = robust.adopt_lens(p, q, np.array(center), scale)
    moved = robust.project(m, robust.divide(p, k, np.array(center), scale))
    rmse = float(np.sqrt(((moved - q) ** 2).sum(axis=1).mean()))
    field = robust.residual_field(q, moved - q, config.width, config.height)
    return Calibration(m.ravel().tolist(), config.model, pooled, int(ok.sum()), rmse, k, center, scale, field, config.width, config.height, sample.count(), tuple(notes))


def check_transform(m: np.ndarray, config: CalibrationConfig) -> list[str]:
    """What is implausible about a transform; see ``geometry`` for the same on columns."""
    if config.model == "homography":
        h = m / m[2, 2] if m[2, 2] else m
        flat = abs(np.linalg.det(m)) < 1e-9
        bent = not m[2, 2] or abs(h[2, 0]) * config.width > 0.5 or abs(h[2, 1]) * config.height > 0.5
        return ["the transform nearly collapses the plane"] * bool(flat) + ["strong perspective"] * bool(bent)
    u, s, vt = np.linalg.svd(m[:2, :2])
    r = u @ vt
    turn, ratio = abs(np.degrees(np.arctan2(r[1, 0], r[0, 0]))), s[0] / s[1] if s[1] > 1e-9 else np.inf
    lo, hi = config.scale_range
    found = ((not lo <= s.mean() <= hi, f"scale {s.mean():.3f}"), (turn > config.max_rotation, f"rotation {turn:.1f}"), (ratio > config.max_anisotropy, f"anisotropy {ratio:.2f}"), (np.linalg.det(m[:2, :2]) < 0, "a reflection"))
    return [text for bad, text in found if bad]


_SAVED = "m array<double>, model string, n_pooled long, n_inliers long, rmse double, k double, center array<double>, scale double, gx array<double>, gy array<double>, field array<double>, width int, height int, n_pairs long, warnings array<string>"


def save_calibration(spark: SparkSession, found: Calibration, path: str) -> None:
    """One row of Parquet at ``path``, which is replaced at once."""
    gx, gy, field = found.field if found.field is not None else (None, None, None)
    flat = lambda x: None if x is None else [float(v) for v in np.ravel(x)]
    row = (flat(found.m), found.model, found.n_pooled, found.n_inliers, float(found.rmse), float(found.k), flat(found.center), float(found.scale), flat(gx), flat(gy), flat(field), found.width, found.height, found.n_pairs, list(found.warnings))
    replace_table(spark.createDataFrame([row], _SAVED), path)


def load_calibration(spark: SparkSession, path: str) -> Calibration:
    """A saved calibration.  Columns that older tables lack have these defaults: an affine model, no lens, no field."""
    r = spark.read.parquet(path).first().asDict()
    w, h = int(r.get("width") or 640), int(r.get("height") or 480)
    field = None
    if r.get("field") is not None:
        gx, gy = np.array(r["gx"]), np.array(r["gy"])
        field = gx, gy, np.array(r["field"]).reshape(len(gy), len(gx), 2)
    center = tuple(r.get("center") or (w / 2, h / 2))
    return Calibration(list(r["m"]), r.get("model") or "affine", r.get("n_pooled") or 0, r.get("n_inliers") or 0, r.get("rmse") or 0.0, r.get("k") or 0.0, center, r.get("scale") or float(np.hypot(w, h) / 2), field, w, h, r.get("n_pairs") or 0, tuple(r.get("warnings") or ()))


def read_calibration_bundle(spark: SparkSession, path: str) -> Calibration:
    """A calibration from an array bundle; optional arrays have the defaults of :func:`load_calibration`.

    The bundle holds a whole map of source coordinates, of which the
    correction at every twentieth pixel (and the last) is kept.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    # fixed values: the names of the arrays
    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as b:
        m, (w, h) = np.asarray(b["M_work"], float), (int(v) for v in b["work_size"])
        get = lambda name, default: b[name][()] if name in b.files else default
        center = tuple(float(v) for v in (b["dist_center"] if "dist_center" in b.files else (w / 2, h / 2)))
        field = None
        if bool(get("has_tps", False)):
            gx, gy = (np.unique(np.append(np.arange(0, n, 20), n - 1)) for n in (w, h))
            at = np.ix_(gy, gx)
            field = gx, gy, np.stack([b["map_x"][at] - gx, b["map_y"][at] - gy[:, None]], axis=-1).astype(float)
        m = np.vstack([m, [0, 0, 1]]) if m.shape == (2, 3) else m
        numbers = [int(get(name, 0)) for name in ("n_pooled_matches", "n_inliers")]
        return Calibration(m.ravel().tolist(), str(get("transform_model", "affine")), *numbers, float(get("rmse_px", 0.0)), float(get("k_thermal", 0.0)), center, float(get("dist_scale", np.hypot(w, h) / 2)), field, w, h, int(get("n_sample_pairs", 0)))


def calibrate_once(matches: DataFrame, path: str, config: CalibrationConfig = CalibrationConfig(), again: bool = False) -> Calibration:
    """The calibration saved at ``path``, or a new one that is saved there.

    A saved one wins over ``config`` (and says so in its warnings if its model
    is another), until ``again`` asks for a new fit.
    """
    spark = matches.sparkSession
    if not again and exists(spark, path):
        found = load_calibration(spark, path)
        if found.model != config.model:
            note = f"saved with model {found.model}, the configuration says {config.model}"
            found = replace(found, warnings=(*found.warnings, note))
        return found
    found = calibrate(matches, config)
    save_calibration(spark, found, path)
    return found


def full_matrix(found: Calibration, thermal: tuple[int, int], visible: tuple[int, int]) -> np.ndarray:
    """The transform between full frames (width, height) of one between work frames."""
    scale = lambda size: np.diag([found.width / size[0], found.height / size[1], 1.0])
    return np.linalg.inv(scale(visible)) @ np.array(found.m).reshape(3, 3) @ scale(thermal)


def warp_thermal(thermal: np.ndarray, size: tuple[int, int], found: Calibration) -> tuple[np.ndarray, np.ndarray]:
    """A thermal image in its visible frame of (width, height), and which pixels it covers: lens, transform, residual field."""
    h, w = thermal.shape[:2]
    if found.k:
        sx, sy = w / found.width, h / found.height
        gx, gy = np.meshgrid((np.arange(w) / sx - found.center[0]), (np.arange(h) / sy - found.center[1]))
        f = 1 - found.k * (gx**2 + gy**2) / found.scale**2  # where a straightened pixel is in the distorted image
        thermal, _ = raster.remap(thermal, (found.center[0] + gx * f) * sx, (found.center[1] + gy * f) * sy)
    out, mask = raster.warp(thermal, full_matrix(found, (w, h), size), size)
    _, mask = raster.warp(np.ones(thermal.shape[:2], np.uint8), full_matrix(found, (w, h), size), size, nearest=True)
    if found.field is not None:
        gx, gy, field = found.field
        sx, sy = size[0] / found.width, size[1] / found.height
        x, y = np.meshgrid(np.arange(size[0], dtype=float), np.arange(size[1], dtype=float))
        at = [raster.resample(gx, gy, field[..., i], np.arange(size[0]) / sx, np.arange(size[1]) / sy) for i in (0, 1)]
        out, _ = raster.remap(out, x + at[0] * sx, y + at[1] * sy)
        covered, inside = raster.remap(mask.astype(np.uint8), x + at[0] * sx, y + at[1] * sy, nearest=True)
        mask = (covered > 0) & inside
    return out, mask


def apply_calibration(pairs: DataFrame, found: Calibration) -> DataFrame:
    """idx, warped (BGRA as RGBA PNG), overlay (PNG), coverage, error of pairs (idx, visible, thermal: PNG contents).

    A pair that fails reports its error, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for idx, v, t in zip(pdf.idx, pdf.visible, pdf.thermal, strict=True):
                try:
                    visible, thermal = (raster.three_channels(raster.decode_png(bytes(x))) for x in (v, t))
                    out, mask = warp_thermal(thermal, visible.shape[1::-1], found)
                    warped = raster.encode_png(np.dstack([out, mask.astype(np.uint8) * 255]))
                    row = (idx, warped, raster.encode_png(raster.overlay(visible, out, mask)), float(mask.mean()), None)
                except (ValueError, KeyError, TypeError, struct.error, zlib.error, np.linalg.LinAlgError) as e:
                    row = (idx, None, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["idx", "warped", "overlay", "coverage", "error"])

    return pairs.select("idx", "visible", "thermal").mapInPandas(run, "idx string, warped binary, overlay binary, coverage double, error string")


def choose_method(pairs: DataFrame, poses: DataFrame, visible: str, thermal: str) -> DataFrame:
    """``pairs`` with method: 3d if both images have a pose, else 2d."""
    names = poses.select("image").distinct()
    out = pairs.join(names.select(F.col("image").alias(visible), F.lit(True).alias("__v")), visible, "left")
    out = out.join(names.select(F.col("image").alias(thermal), F.lit(True).alias("__t")), thermal, "left")
    return out.withColumn("method", F.when(F.col("__v") & F.col("__t"), "3d").otherwise("2d")).drop("__v", "__t")


def fill_waves(order: DataFrame, edges: DataFrame) -> DataFrame:
    """image, wave: an image comes one wave after the last of its neighbours that is filled before it.

    Images of one wave do not read each other, so a wave is one job.  The
    rule follows the fill order, on image-level edges, in one task.
    """
    rows = order.select(F.lit(0).alias("kind"), F.col("step").alias("a"), F.col("image").alias("b"))
    rows = rows.union(edges.select(F.lit(1), F.col("a").cast("long"), F.col("b").cast("long"))).withColumn("all", F.lit(1))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(set)
        for a, b in pdf.loc[pdf.kind == 1, ["a", "b"]].itertuples(index=False):
            near[a].add(b)
        wave: dict[int, int] = {}
        for image in pdf[pdf.kind == 0].sort_values("a").b:
            wave[image] = 1 + max((wave[n] for n in near[image] if n in wave), default=-1)
        return pd.DataFrame(sorted(wave.items()), columns=["image", "wave"])

    return rows.groupBy("all").applyInPandas(number, "image long, wave long")


def propagate(pixels: DataFrame, transforms: DataFrame, waves: DataFrame, width: int, height: int) -> DataFrame:
    """image, y, x, layer, value after filling wave by wave from neighbours already filled.

    ``pixels`` holds each image's own valid pixels (image, y, x, value) and
    ``transforms`` target, source, rank (from 1) and m, nine numbers from
    source to target.  A pixel takes the first layer by rank, the own one
    being 0.  Each wave is one job that reads what earlier waves wrote.
    """
    done = materialize(pixels.select("image", "y", "x", F.lit(0).alias("layer"), "value"), "filled")
    last = waves.agg(F.max("wave")).first()[0]
    spark = pixels.sparkSession
    frame = spark.range(height).select(F.col("id").cast("int").alias("y")).join(F.broadcast(spark.range(width).select(F.col("id").cast("int").alias("x"))))
    for wave in range(1, (last or 0) + 1):
        targets = waves.filter(F.col("wave") == wave).select(F.col("image").alias("target"))
        moves = transforms.join(F.broadcast(targets), "target")  # one row an image
        back = _inverse(F.col("m"))
        # every pixel of the target looks back to the source, so magnified sources leave no holes
        u, v = geo.apply_homography(back, F.col("x").cast("double"), F.col("y").cast("double"))
        asks = frame.join(F.broadcast(moves)).select(F.col("target").alias("image"), "y", "x", "source", F.col("rank").alias("layer"), F.rint(u).alias("u"), F.rint(v).alias("v"))
        asks = asks.filter(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)).withColumns({"u": F.col("u").cast("int"), "v": F.col("v").cast("int")})
        have = done.select(F.col("image").alias("source"), F.col("y").alias("v"), F.col("x").alias("u"), "value")
        moved = asks.join(have, ["source", "v", "u"]).select("image", "y", "x", "layer", "value")
        own = done.join(F.broadcast(targets.withColumnRenamed("target", "image")), "image", "left_semi")
        new = first_valid(own.unionByName(moved).withColumn("valid", F.lit(True)), ["image", "y", "x"], "layer", "value", "valid")
        rest = done.join(F.broadcast(targets.withColumnRenamed("target", "image")), "image", "left_anti")
        done = materialize(rest.unionByName(new), "filled")
    return done


def _inverse(m: Column) -> list[Column]:
    """The inverse of a 3x3 array up to scale (its adjugate)."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
