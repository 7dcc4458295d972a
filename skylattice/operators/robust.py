"""Robust fits: ratios, homographies, affine and similarity transforms, lens and residual fields.

Groups are fitted side by side; the sequential kernels are numpy on a bounded
sample of a group's matches, and sums over all of them.  Random draws are
seeded, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geometry import apply_homography
from skylattice.operators.numbering import exact_median
from skylattice.storage import broadcast_if_small, materialize

#: Pixel threshold, confidence and iterations of the consensus search.
THRESHOLD, CONFIDENCE, ITERATIONS = 3.0, 0.999, 5000


def guided_ratio(pool: DataFrame, x: str, y: str, conf: str, high: float, low: float, tolerance: float) -> DataFrame:
    """One row: ratio fitted on the confident pool, rows kept (confident, or agreeing with the fit), their RMSE and median residual.

    Without a confident row with x the ratio is null, as are the residuals.
    """
    sure = pool.filter(F.col(conf) >= high)
    ratio = sure.agg((F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)))).alias("k"))
    residual = pool.join(F.broadcast(ratio)).select(F.abs(F.col(y) - F.col("k") * F.col(x)).alias("e"), F.col(conf).alias("c"), "k")
    kept = residual.filter((F.col("c") >= high) | ((F.col("c") >= low) & (F.col("e") < tolerance)))
    kept = materialize(kept.select("e", "k"), "guided")
    median = exact_median(kept, "e")
    out = kept.agg(F.round(F.first("k"), 4).alias("ratio"), F.count(F.lit(1)).alias("kept"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 4).alias("rmse"))
    return out.withColumn("median", F.round(F.lit(median).cast("double"), 4))


def project(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points through a 3x3 transform."""
    q = np.column_stack([p, np.ones(len(p))]) @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def _center(p: np.ndarray) -> np.ndarray:
    """The transform that moves points to mean 0 and mean distance sqrt(2)."""
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(1e-12, np.sqrt(((p - c) ** 2).sum(axis=1)).mean())
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def solve(p: np.ndarray, q: np.ndarray, model: str) -> np.ndarray | None:
    """The least-squares transform of point pairs; None where it is undetermined."""
    least = {"homography": 4, "affine": 3, "similarity": 2}[model]
    if len(p) < least:
        return None
    x, y, o, i = p[:, 0], p[:, 1], np.zeros(len(p)), np.ones(len(p))
    if model == "homography":
        a, b = _center(p), _center(q)
        pn, qn = project(a, p), project(b, q)
        (x, y), (u, v) = pn.T, qn.T
        rows = np.concatenate([np.column_stack([x, y, i, o, o, o, -u * x, -u * y, -u]), np.column_stack([o, o, o, x, y, i, -v * x, -v * y, -v])])
        if len(rows) < 9:
            rows = np.concatenate([rows, np.zeros((9 - len(rows), 9))])
        s, vt = np.linalg.svd(rows.T @ rows if len(rows) > 64 else rows)[1:]
        if s[7] < 1e-10 * s[0]:
            return None
        m = np.linalg.inv(b) @ vt[-1].reshape(3, 3) @ a
        return m / m[2, 2] if abs(m[2, 2]) > 1e-12 and np.isfinite(m).all() else None
    if model == "affine":
        w, _, rank, _ = np.linalg.lstsq(np.column_stack([x, y, i]), q, rcond=None)
        return np.vstack([w.T, [0, 0, 1]]) if rank == 3 else None
    rows = np.concatenate([np.column_stack([x, -y, i, o]), np.column_stack([y, x, o, i])])
    w, _, rank, _ = np.linalg.lstsq(rows, np.concatenate([q[:, 0], q[:, 1]]), rcond=None)
    return np.array([[w[0], -w[1], w[2]], [w[1], w[0], w[3]], [0, 0, 1]]) if rank == 4 else None


def consensus(p: np.ndarray, q: np.ndarray, model: str = "homography", threshold: float = THRESHOLD, confidence: float = CONFIDENCE, iterations: int = ITERATIONS, seed: int = 0):
    """(transform, inlier mask) with the most inliers over random minimal samples, refitted on them; (None, none) if there is none."""
    n, least = len(p), {"homography": 4, "affine": 3, "similarity": 2}[model]
    none = np.zeros(n, bool)
    if n < least:
        return None, none
    rng, best, need, k = np.random.default_rng(seed), none, iterations, 0
    while k < min(need, iterations):
        k += 1
        some = rng.choice(n, least, replace=False)
        m = solve(p[some], q[some], model)
        if m is None:
            continue
        ok = ((project(m, p) - q) ** 2).sum(axis=1) < threshold**2
        if ok.sum() > best.sum():
            best = ok
            share = min(1 - 1e-9, max(1e-9, (ok.sum() / n) ** least))
            need = int(np.ceil(np.log(1 - confidence) / np.log(1 - share)))
    m = None
    for _ in range(5):
        new = solve(p[best], q[best], model)
        if new is None:
            break
        m = new
        ok = ((project(m, p) - q) ** 2).sum(axis=1) < threshold**2
        if (ok == best).all():
            break
        best = ok
    return (m, best) if m is not None else (None, none)


#: Rows of a group on which hypotheses are drawn and compared.
SAMPLE = 4096


def fit_groups(matches: DataFrame, key: str, model: str = "homography", threshold: float = THRESHOLD, sample: int = SAMPLE, rounds: int = 2) -> DataFrame:
    """key, n, inliers, rmse, m (nine doubles, null if nothing fits), error: one robust fit a group of (x, y, u, v).

    Hypotheses are drawn, and the best is chosen, on at most ``sample`` rows
    of a group (those with the smallest hashes).  Then ``rounds`` times all
    rows of the group are tested against it and the transform is fitted anew
    to all that agree, from sums that are combined on the map side; so a
    group may have any number of rows.  A failing group reports its error and
    does not stop the others.  Rows with a null take no part; a null key is
    one group.
    """
    kind = matches.schema[key].dataType.simpleString()
    rows = matches.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(c) for c in "xyuv")).dropna(subset=list("xyuv"))
    rows = materialize(rows, "fit-rows")
    first = Window.partitionBy("k").orderBy(F.xxhash64(*"xyuv"), *"xyuv")
    some = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample)

    def fit(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "u", "v"])
        p, q = pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
        m, error = None, None
        try:
            m, _ = consensus(p, q, model, threshold)
        except (np.linalg.LinAlgError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
        flat = lambda x: None if x is None else x.ravel().tolist()
        return pd.DataFrame({"k": [name[0]], "m": [flat(m)], "a": [flat(_center(p))], "b": [flat(_center(q))], "error": [error]})

    fields = f"k {kind}, m array<double>, a array<double>, b array<double>, error string"
    found = materialize(some.groupBy("k").applyInPandas(fit, fields), "fits")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = []
            for r in pdf.itertuples():
                new = None if r.m is None or not r.hits else solve_sums(np.array(r.sums, float), np.reshape(r.a, (3, 3)), np.reshape(r.b, (3, 3)), model)
                m.append(r.m if new is None else new.ravel().tolist())
            yield pdf.assign(m=m)[["k", "m", "a", "b", "error"]]

    for _ in range(rounds):
        found = materialize(_scored(rows, found, threshold, True).mapInPandas(again, fields), "fits")
    out = _scored(rows, found, threshold, False)
    rmse = F.when(F.col("hits") > 0, F.sqrt(F.col("se") / F.col("hits")))
    return out.select(F.col("k").alias(key), "n", F.when(F.col("m").isNull(), 0).otherwise(F.col("hits")).cast("long").alias("inliers"), F.when(F.col("m").isNotNull(), rmse).alias("rmse"), "m", "error")


def _scored(rows: DataFrame, found: DataFrame, threshold: float, sums: bool) -> DataFrame:
    """``found`` with n, hits and se (rows, those that agree, their squared errors), and the sums that :func:`solve_sums` takes."""
    at = lambda name, i: F.col(name)[i]
    joined = rows.join(broadcast_if_small(found.withColumnRenamed("k", "g")), F.col("k").eqNullSafe(F.col("g")))
    px, py = apply_homography([at("m", i) for i in range(9)], F.col("x"), F.col("y"))
    e = (px - F.col("u")) * (px - F.col("u")) + (py - F.col("v")) * (py - F.col("v"))
    joined = joined.withColumn("e", e).withColumn("ok", F.coalesce(F.col("e") < threshold**2, F.lit(False)))
    columns = [F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("hits"), F.sum(F.when(F.col("ok"), F.col("e"))).alias("se")]
    if sums:
        x, y = (at("a", 3 * i + i) * F.col(c) + at("a", 3 * i + 2) for i, c in enumerate("xy"))
        u, v = (at("b", 3 * i + i) * F.col(c) + at("b", 3 * i + 2) for i, c in enumerate("uv"))
        joined = joined.select("g", "e", "ok", x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
        products = [F.col("x") * F.col("x"), F.col("x") * F.col("y"), F.col("x"), F.col("y") * F.col("y"), F.col("y"), F.lit(1.0)]
        weights = [F.lit(1.0), F.col("u"), F.col("v"), F.col("u") * F.col("u") + F.col("v") * F.col("v")]
        columns.append(F.array(*(F.sum(F.when(F.col("ok"), w * p).otherwise(F.lit(0.0))) for w in weights for p in products)).alias("sums"))
    totals = joined.groupBy("g").agg(*columns)
    return totals.join(broadcast_if_small(found), F.col("g").eqNullSafe(F.col("k"))).drop("g")


def solve_sums(sums: np.ndarray, a: np.ndarray, b: np.ndarray, model: str) -> np.ndarray | None:
    """The least-squares transform from sums over point pairs in normalised frames (``a`` and ``b`` lead there); None where it is undetermined.

    ``sums`` has x x, x y, x, y y, y, 1, weighted by 1, u, v and u u + v v.
    """
    s, su, sv, sw = (np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]) for c in sums.reshape(4, 6))
    if not np.isfinite(sums).all():
        return None
    if model == "homography":
        o = np.zeros((3, 3))
        value, vector = np.linalg.eigh(np.block([[s, o, -su], [o, s, -sv], [-su, -sv, sw]]))
        if value[1] < 1e-10 * value[-1]:
            return None
        m = vector[:, 0].reshape(3, 3)
    elif model == "affine":
        if np.linalg.matrix_rank(s) < 3:
            return None
        m = np.vstack([np.linalg.solve(s, np.column_stack([su[:, 2], sv[:, 2]])).T, [0, 0, 1]])
    else:
        n, x, y, r = s[2, 2], s[0, 2], s[1, 2], s[0, 0] + s[1, 1]
        left = np.array([[r, 0, x, y], [0, r, -y, x], [x, -y, n, 0], [y, x, 0, n]])
        if np.linalg.matrix_rank(left) < 4:
            return None
        c, d, tx, ty = np.linalg.solve(left, [su[0, 2] + sv[1, 2], sv[0, 2] - su[1, 2], su[2, 2], sv[2, 2]])
        m = np.array([[c, -d, tx], [d, c, ty], [0, 0, 1]])
    m = np.linalg.inv(b) @ m @ a
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 and np.isfinite(m).all() else None


def divide(p: np.ndarray, k: float, center: np.ndarray, scale: float) -> np.ndarray:
    d = p - center
    return center + d / (1 + k * (d**2).sum(axis=1, keepdims=True) / scale**2)


def fit_lens(p: np.ndarray, q: np.ndarray, center: np.ndarray, scale: float, soft: float = 2.0, evaluations: int = 3000) -> tuple[np.ndarray, float]:
    """A homography and a radial coefficient together, by Levenberg-Marquardt on soft-L1 residuals."""
    m = solve(p, q, "homography")
    if m is None:
        raise ValueError("no start homography")
    x = np.append(m.ravel()[:8], 0.0)

    def residuals(x: np.ndarray) -> np.ndarray:
        h = np.append(x[:8], 1.0).reshape(3, 3)
        return (project(h, divide(p, x[8], center, scale)) - q).ravel()

    def cost(r: np.ndarray) -> float:
        return float((2 * soft**2 * (np.sqrt(1 + (r / soft) ** 2) - 1)).sum())

    lam, r, used = 1e-3, residuals(x), 1
    while used < evaluations:
        step = 1e-6 * np.maximum(np.abs(x), 1e-3)
        jac = np.column_stack([(residuals(x + np.eye(9)[i] * step[i]) - r) / step[i] for i in range(9)])
        used += 9
        w = 1 / np.sqrt(1 + (r / soft) ** 2)
        a, g = jac.T @ (jac * w[:, None]), jac.T @ (w * r)
        better = False
        for _ in range(12):
            new = x - np.linalg.lstsq(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            rn, used = residuals(new), used + 1
            if np.isfinite(rn).all() and cost(rn) < cost(r):
                gain = cost(r) - cost(rn)
                x, r, lam, better = new, rn, lam / 3, gain > 1e-12 * (1 + cost(rn))
                break
            lam *= 4
        if not better:
            break
    return np.append(x[:8], 1.0).reshape(3, 3), float(x[8])


def adopt_lens(p: np.ndarray, q: np.ndarray, center: np.ndarray, scale: float, least: int = 120, share: float = 0.2, gain: float = 0.05, seed: int = 0) -> tuple[np.ndarray | None, float]:
    """The lens fit on all points if held-out points gain at least ``gain`` pixels from it, else a plain homography and 0."""
    plain = solve(p, q, "homography")
    if len(p) < least:
        return plain, 0.0
    order = np.random.default_rng(seed).permutation(len(p))
    n = max(20, int(share * len(p)))
    held, rest = order[:n], order[n:]
    base = solve(p[rest], q[rest], "homography")
    m, k = fit_lens(p[rest], q[rest], center, scale)
    rmse = lambda d: float(np.sqrt((d**2).sum(axis=1).mean()))
    if base is None or rmse(project(m, divide(p[held], k, center, scale)) - q[held]) < rmse(project(base, p[held]) - q[held]) - gain:
        return fit_lens(p, q, center, scale)
    return plain, 0.0


def residual_field(points: np.ndarray, residual: np.ndarray, width: int, height: int, grid: int = 20, cap: float = 15.0, smoothing: float = 2.0, least: int = 80, dense: int = 3000):
    """(gx, gy, field) of a thin-plate spline through residuals, capped, on a grid that ends at the frame's edge; None if points are few.

    The system is dense: more than ``dense`` points count by cells of half a
    grid step, as their mean with a smoothing less by their number.
    """
    if len(points) < least:
        return None
    count = np.ones(len(points))
    if len(points) > dense:
        cell, count = np.unique(np.floor(points / (grid / 2)), axis=0, return_inverse=True, return_counts=True)[1:]
        mean = lambda x: np.column_stack([np.bincount(cell.ravel(), v) for v in x.T]) / count[:, None]
        points, residual = mean(points), mean(residual)

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return 0.5 * r2 * np.log(np.maximum(r2, 1e-300))

    unit = float(max(width, height))  # solve in units of the frame; the smoothing scales with its square
    points = points / unit
    n, ones = len(points), np.ones((len(points), 1))
    top = np.concatenate([kernel(points, points) + smoothing / unit**2 * np.diag(1 / count), ones, points], axis=1)
    low = np.concatenate([np.concatenate([ones, points], axis=1).T, np.zeros((3, 3))], axis=1)
    system, right = np.concatenate([top, low]), np.concatenate([residual, np.zeros((3, 2))])
    flat = np.linalg.matrix_rank(low[:, :n]) < 3  # points on a line
    w = np.linalg.lstsq(system, right, rcond=None)[0] if flat else np.linalg.solve(system, right)
    gx, gy = (np.unique(np.append(np.arange(0, size, grid), size - 1)) for size in (width, height))
    at = np.stack(np.meshgrid(gx, gy), axis=-1).reshape(-1, 2) / unit
    field = kernel(at, points) @ w[:n] + np.column_stack([np.ones(len(at)), at]) @ w[n:]
    return gx, gy, np.clip(field, -cap, cap).reshape(len(gy), len(gx), 2)
