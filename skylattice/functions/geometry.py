"""Plane and pose geometry as column expressions.

A 3x3 matrix is a list of nine columns or numbers, row by row.  Where a
denominator is zero (a point at infinity, the pole of a lens, a frame without
width) the result is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres, of the flat-earth approximation.
EARTH_RADIUS = 6_371_000.0
Value = Column | float


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _over(a: Value, b: Value) -> Column:
    return F.try_divide(_c(a), _c(b))


def normalized_to_pixel(x: Column, y: Column, width: Value, height: Value) -> tuple[Column, Column]:
    """Coordinates from the centre in units of the longer side, as pixels."""
    side = F.greatest(_c(width), _c(height))
    return x * side + _c(width) / 2, y * side + _c(height) / 2


def rescale(x: Column, y: Column, size: tuple[Value, Value], to: tuple[Value, Value]) -> tuple[Column, Column]:
    """Pixels of one frame size as pixels of another."""
    return _over(x * _c(to[0]), size[0]), _over(y * _c(to[1]), size[1])


def apply_homography(m: Sequence[Value], x: Column, y: Column) -> tuple[Column, Column]:
    """A homogeneous transform with perspective divide; null on the line that goes to infinity."""
    h = [_c(v) for v in m]
    w = h[6] * x + h[7] * y + h[8]
    return _over(h[0] * x + h[1] * y + h[2], w), _over(h[3] * x + h[4] * y + h[5], w)


def pad_affine(m: Sequence[Value]) -> list[Value]:
    """A 2x3 affine transform as 3x3."""
    return [*m, 0.0, 0.0, 1.0] if len(m) == 6 else list(m)


def conjugate_resize(m: Sequence[Value], source: tuple[Value, Value], target: tuple[Value, Value], work: tuple[Value, Value]) -> list[Column]:
    """A transform between work frames as one between full frames: inv(S_target) * M * S_source."""
    sx, sy = _over(work[0], source[0]), _over(work[1], source[1])
    tx, ty = _over(target[0], work[0]), _over(target[1], work[1])
    h = [_c(v) for v in m]
    rows = ([tx] * 3, [ty] * 3, [F.lit(1.0)] * 3)
    columns = (sx, sy, F.lit(1.0)) * 3
    return [h[i] * r * c for i, (r, c) in enumerate(zip([x for row in rows for x in row], columns, strict=True))]


def undistort(x: Column, y: Column, k: Value, center: tuple[Value, Value], scale: Value) -> tuple[Column, Column]:
    """The division model: c + d / (1 + k r^2), r in units of ``scale``; null at the pole."""
    dx, dy = x - _c(center[0]), y - _c(center[1])
    f = 1 + _over(_c(k) * (dx * dx + dy * dy), _c(scale) * _c(scale))
    return _c(center[0]) + _over(dx, f), _c(center[1]) + _over(dy, f)


def distort(x: Column, y: Column, k: Value, center: tuple[Value, Value], scale: Value) -> tuple[Column, Column]:
    """Its first-order inverse: c + d * (1 - k r^2)."""
    dx, dy = x - _c(center[0]), y - _c(center[1])
    f = 1 - _over(_c(k) * (dx * dx + dy * dy), _c(scale) * _c(scale))
    return _c(center[0]) + dx * f, _c(center[1]) + dy * f


def reprojection_error(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def determinant(m: Sequence[Value]) -> Column:
    a, b, c, d, e, f, g, h, i = (_c(v) for v in m)
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def degenerate(m: Sequence[Value], width: Value, height: Value) -> Column:
    """Whether a homography nearly collapses the plane or has strong perspective; one that sends the origin to infinity does."""
    px, py = _over(m[6], m[8]), _over(m[7], m[8])
    return F.coalesce((F.abs(determinant(m)) < 1e-9) | (F.abs(px) * _c(width) > 0.5) | (F.abs(py) * _c(height) > 0.5), F.lit(True))


def decompose_affine(m: Sequence[Value]) -> dict[str, Column]:
    """rotation (degrees), scale (mean of the singular values), anisotropy, reflection of a 2x2 part (a, b, c, d).

    The rotation is the angle of the first column of the nearest orthogonal
    matrix, which with a reflection is no rotation.
    """
    a, b, c, d = (_c(v) for v in m)
    mirror = a * d - b * c < 0
    q, r = F.sqrt((a + d) ** 2 + (c - b) ** 2), F.sqrt((a - d) ** 2 + (c + b) ** 2)
    s1, s2 = (q + r) / 2, F.abs(q - r) / 2
    return {
        "rotation": F.degrees(F.when(mirror, F.atan2(c + b, a - d)).otherwise(F.atan2(c - b, a + d))),
        "scale": (s1 + s2) / 2,
        "anisotropy": F.when(s2 <= 1e-9, F.lit(float("inf"))).otherwise(s1 / s2),
        "reflection": mirror,
    }


def affine_warnings(parts: dict[str, Column], scale: tuple[float, float] = (0.3, 3.0), rotation: float = 25.0, anisotropy: float = 1.6) -> Column:
    """What is out of range in a decomposition: an array of scale, rotation, anisotropy and reflection."""
    found = (("scale", ~parts["scale"].between(*scale)), ("rotation", F.abs(parts["rotation"]) > rotation), ("anisotropy", parts["anisotropy"] > anisotropy), ("reflection", parts["reflection"]))
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in found)))


def focal_from_35mm(focal: Value, width: Value, height: Value) -> Column:
    return _c(focal) * F.greatest(_c(width), _c(height)) / 36.0


def focal_from_hfov(degrees: Value, width: Value) -> Column:
    """Null for a field of view of 0."""
    return _over(width, 2 * F.tan(F.radians(_c(degrees)) / 2))


def focal_from_plane(focal_mm: Value, resolution: Value, unit: Value) -> Column:
    """From the focal-plane resolution; unit 2 is inches, 3 centimetres, others give null."""
    mm = F.when(_c(unit) == 2, 25.4).when(_c(unit) == 3, 10.0)
    return _c(focal_mm) * _c(resolution) / mm


def enu_to_lat_lon(east: Column, north: Column, lat: Value, lon: Value) -> tuple[Column, Column]:
    """Flat-earth offsets in metres around an origin, as degrees."""
    return _c(lat) + F.degrees(north / EARTH_RADIUS), _c(lon) + F.degrees(east / (EARTH_RADIUS * F.cos(F.radians(_c(lat)))))


def utm_zone(lat: Column, lon: Column) -> Column:
    """EPSG code of the UTM zone: 326xx in the north, 327xx in the south."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def matmul3(a: Column, b: Column) -> Column:
    """The product of two 3x3 arrays of doubles."""
    cell = lambda i, j: sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j])
    return F.array(*(cell(i, j) for i in range(3) for j in range(3)))


def transform3(m: Column, v: Column) -> Column:
    """A 3x3 array times a vector of three."""
    return F.array(*(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)))


def transpose3(m: Column) -> Column:
    return F.array(*(m[3 * j + i] for i in range(3) for j in range(3)))


def rodrigues(v: Column) -> Column:
    """The rotation matrix of an axis-angle vector."""
    t = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    safe = F.when(t > 0, t).otherwise(F.lit(1.0))
    x, y, z = v[0] / safe, v[1] / safe, v[2] / safe
    c, s = F.cos(t), F.sin(t)
    n = 1 - c
    return F.array(c + x * x * n, x * y * n - z * s, x * z * n + y * s, y * x * n + z * s, c + y * y * n, y * z * n - x * s, z * x * n - y * s, z * y * n + x * s, c + z * z * n)


def compose_pose(local_rotation: Column, local_center: Column, chunk_rotation: Column, chunk_translation: Column, scale: Column) -> dict[str, Column]:
    """World pose of a camera in a chunk: R, t, C with C = s Rc Cl + T, R = (Rc Rl)^T, t = -R C."""
    moved = transform3(chunk_rotation, local_center)
    center = F.array(*(scale * moved[i] + chunk_translation[i] for i in range(3)))
    rotation = transpose3(matmul3(chunk_rotation, local_rotation))
    back = transform3(rotation, center)
    return {"R": rotation, "t": F.array(*(-back[i] for i in range(3))), "C": center}


def lat_lon_to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the transverse Mercator series; ``zone`` is an EPSG code 326xx or 327xx."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone % 100 * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha[1:], 2)), alpha[0] * F.cos(2 * xi) * F.sinh(2 * eta))
    north = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha[1:], 2)), alpha[0] * F.sin(2 * xi) * F.cosh(2 * eta))
    return 500000 + k0 * big * east, k0 * big * north + F.when(zone >= 32700, 10_000_000.0).otherwise(0.0)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude (degrees) and height above the WGS 84 ellipsoid of earth-centred metres.

    Fixed-point steps from the spherical start; three of them are exact to a
    micrometre for heights of aircraft.
    """
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z, p * (1 - f))
    for _ in range(3):
        lat = F.atan2(z + e2 / (1 - e2) * a * (1 - f) * F.pow(F.sin(beta), 3), p - e2 * a * F.pow(F.cos(beta), 3))
        beta = F.atan2((1 - f) * F.sin(lat), F.cos(lat))
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    # along the normal, which holds at the poles too
    height = p * F.cos(lat) + (z + e2 * n * F.sin(lat)) * F.sin(lat) - n
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def ecef_to_utm(x: Column, y: Column, z: Column, zone: Column | int) -> tuple[Column, Column, Column]:
    """Easting, northing and height of earth-centred metres; ``zone`` is an EPSG code 326xx or 327xx."""
    lat, lon, height = ecef_to_geodetic(x, y, z)
    east, north = lat_lon_to_utm(lat, lon, zone if isinstance(zone, Column) else F.lit(zone))
    return east, north, height


def ground_point(x: Value, y: Value, z: Value, altitude: Value = 56.3) -> tuple[Column, Column, Column]:
    """The point ``altitude`` below a camera centre, towards the centre of the earth; null for a centre at 0."""
    r = F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))
    k = 1 - _over(altitude, r)
    return _c(x) * k, _c(y) * k, _c(z) * k
