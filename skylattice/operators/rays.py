"""Rays against surfaces: footprints, projective maps and pose checks (numpy, one pose at a time)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Pose:
    """A camera: intrinsics K, world-to-camera rotation R and translation t, centre C."""

    K: np.ndarray
    R: np.ndarray
    t: np.ndarray
    C: np.ndarray

    def rays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Unit world directions through pixels."""
        d = np.linalg.inv(self.K) @ np.stack([x, y, np.ones_like(x)])
        d = self.R.T @ d
        return (d / np.linalg.norm(d, axis=0)).T

    def project(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pixels of world points, and whether the points lie in front."""
        c = self.R @ p.T + self.t[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            uv = (self.K @ c)[:2] / c[2]
        return uv.T, c[2] > 0


@dataclass
class Grid:
    """A surface: z[iy, ix] from (x_min, y_min) in cells of ``resolution``."""

    z: np.ndarray
    x_min: float
    y_min: float
    resolution: float

    def height(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ny, nx = self.z.shape
        gx = np.clip((x - self.x_min) / self.resolution, 0, nx - 1.001)
        gy = np.clip((y - self.y_min) / self.resolution, 0, ny - 1.001)
        ix, iy = np.floor(gx).astype(int), np.floor(gy).astype(int)
        fx, fy = gx - ix, gy - iy
        z = self.z
        return (z[iy, ix] * (1 - fx) + z[iy, ix + 1] * fx) * (1 - fy) + (z[iy + 1, ix] * (1 - fx) + z[iy + 1, ix + 1] * fx) * fy


def hit_plane(origin: np.ndarray, rays: np.ndarray, ground: float, up: np.ndarray | None = None) -> np.ndarray:
    """Points where rays meet the plane at height ``ground`` along ``up`` (z by default); NaN behind or alongside it."""
    up = np.array([0.0, 0.0, 1.0]) if up is None else up
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (ground - origin @ up) / (rays @ up)
    t = np.where(t > 0, t, np.nan)
    return origin + t[:, None] * rays


def hit_grid(
    origin: np.ndarray, rays: np.ndarray, grid: Grid, step: float = 2.0, far: float = 800.0, refine: int = 8, to_grid: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Points where rays first go below the surface, and whether they do; a miss ends at the largest distance.

    The crossing is the middle of its bracket after ``refine`` bisections.
    ``to_grid`` takes points (n x 3) of the rays' frame to the surface's.
    """

    def above_at(t: np.ndarray) -> np.ndarray:
        p = origin + t[:, None] * rays
        p = p if to_grid is None else to_grid(p)
        return p[:, 2] > grid.height(p[:, 0], p[:, 1])

    n = len(rays)
    lo, hi, found, above = np.zeros(n), np.full(n, far), np.zeros(n, bool), above_at(np.zeros(n))
    for t in np.arange(step, far + step / 2, step):
        now = above_at(np.full(n, t))
        new = above & ~now & ~found
        lo[new], hi[new] = t - step, t
        found |= new
        above = now
        if found.all():
            break
    for _ in range(refine):
        mid = (lo + hi) / 2
        up = above_at(mid)
        lo, hi = np.where(found & up, mid, lo), np.where(found & ~up, mid, hi)
    return origin + np.where(found, (lo + hi) / 2, far)[:, None] * rays, found


@dataclass
class Ground:
    """What rays meet: a plane at ``height`` along ``up``, or a surface in a frame of its own."""

    height: float = 0.0
    up: np.ndarray | None = None
    grid: Grid | None = None
    to_grid: Callable[[np.ndarray], np.ndarray] | None = None

    def hit(self, origin: np.ndarray, rays: np.ndarray) -> np.ndarray:
        if self.grid is not None:
            return hit_grid(origin, rays, self.grid, to_grid=self.to_grid)[0]
        return hit_plane(origin, rays, self.height, self.up)


def footprint(pose: Pose, width: int, height: int, ground: Ground = Ground()) -> np.ndarray:
    """Ground points of the four corners and the centre (5 x 3)."""
    x = np.array([0, width - 1, width - 1, 0, width / 2], float)
    y = np.array([0, 0, height - 1, height - 1, height / 2], float)
    return ground.hit(pose.C, pose.rays(x, y))


def warp_map(target: Pose, source: Pose, width: int, height: int, ground: Ground = Ground(), cell: int = 20):
    """(gx, gy, map_x, map_y): where pixels of the target are in the source, on a coarse grid; NaN behind the source."""
    gx, gy = (np.unique(np.append(np.arange(0, n, cell), n - 1)).astype(float) for n in (width, height))
    x, y = (v.ravel() for v in np.meshgrid(gx, gy))
    uv, front = source.project(ground.hit(target.C, target.rays(x, y)))
    uv[~front] = np.nan
    return gx, gy, uv[:, 0].reshape(len(gy), -1), uv[:, 1].reshape(len(gy), -1)


def reprojection(a: Pose, b: Pose, pa: np.ndarray, pb: np.ndarray, ground: Ground = Ground()) -> np.ndarray:
    """Distances in pixels of matches of ``a``, back-projected to the ground and seen from ``b``; those not seen are left out."""
    if not len(pa):
        return np.empty(0)
    uv, front = b.project(ground.hit(a.C, a.rays(pa[:, 0], pa[:, 1])))
    e = np.linalg.norm(uv - pb, axis=1)[front]
    return e[np.isfinite(e)]


def pose_error(a: Pose, b: Pose, pa: np.ndarray, pb: np.ndarray, ground: Ground = Ground()) -> float:
    """The RMSE of :func:`reprojection`; infinite without any match."""
    e = reprojection(a, b, pa, pb, ground)
    return float(np.sqrt((e**2).mean())) if len(e) else float("inf")


def accept_rig(rig: float, baseline: float, factor: float = 1.5) -> bool:
    """Whether a rig's error is below ``factor`` times the plain transform's."""
    return bool(np.isfinite(rig) and rig < factor * baseline)


def accept_fill(errors: list[float], limit: float = 50.0, pairs: int = 8) -> bool:
    """Whether geometric fill may be used: evidence from at most ``pairs`` pairs, none of it too bad; without evidence, no."""
    some = [e for e in errors[:pairs] if np.isfinite(e)]
    return bool(some) and float(np.sqrt(np.mean(np.square(some)))) <= limit


def homography_motions(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(R, t / d, n) with h ~ R + t n' / d: up to four motions of a calibrated camera over a plane.

    From the eigenvectors of h'h, scaled so that the middle singular value is
    1; a pure rotation gives one motion without translation.
    """
    h = h / np.linalg.svd(h)[1][1]
    h = h if np.linalg.det(h) > 0 else -h
    value, vector = np.linalg.eigh(h.T @ h)
    s3, s1 = value[0], value[2]
    if s1 - s3 < 1e-10:
        return [(h, np.zeros(3), np.array([0.0, 0.0, 1.0]))]
    v3, v2, v1 = vector.T
    a, b = np.sqrt(max(0.0, 1 - s3)), np.sqrt(max(0.0, s1 - 1))
    out = []
    for u in ((a * v1 + b * v3) / np.sqrt(s1 - s3), (a * v1 - b * v3) / np.sqrt(s1 - s3)):
        frame = np.column_stack([v2, u, np.cross(v2, u)])
        moved = np.column_stack([h @ v2, h @ u, np.cross(h @ v2, h @ u)])
        r, n = moved @ frame.T, np.cross(v2, u)
        out += [(r, (h - r) @ n, n), (r, -(h - r) @ n, -n)]
    return out


def rig_of_homography(h: np.ndarray, k_target: np.ndarray, k_source: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of the second camera against the first: the motion nearest to no rotation, scaled by the height above ground.

    Of two motions with one rotation, the plane of the right one is in front.
    """
    motions = homography_motions(np.linalg.inv(k_target) @ h @ k_source)
    r, t, _ = min(motions, key=lambda m: (round(np.linalg.norm(m[0] - np.eye(3)), 9), m[2][2] <= 0))
    return r, t * height
