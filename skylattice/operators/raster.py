"""Raster kernels on numpy arrays, run per image pair inside ``mapInPandas``.

Images are (height, width) or (height, width, channels) arrays of uint8.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of a gray, RGB or RGBA array."""
    h, w = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes, alpha: bool = False) -> np.ndarray:
    """An 8-bit PNG without interlacing; with ``alpha``, a file without transparency is an error."""
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 6: 4}.get(kind)
    if depth != 8 or interlace or channels is None:
        raise ValueError("unsupported PNG")
    if alpha and channels != 4:
        raise ValueError("the image has no alpha channel")
    at, parts = 8, []
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        if name == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w, channels), np.uint8)
    lines = raw[:, 1:].reshape(h, w, channels)
    for y, kind in enumerate(raw[:, 0]):
        line, above = lines[y], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # sums of what stands to the left, modulo 256
            out[y + 1] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + above
        else:
            out[y + 1] = _unfilter(line.astype(np.int32), above.astype(np.int32), kind == 4)
    out = out[1:]
    return out.reshape(h, w, channels) if channels > 1 else out


def _unfilter(line: np.ndarray, above: np.ndarray, paeth: bool) -> np.ndarray:
    """The two filters in which a pixel depends on the one before it: all channels of a pixel at once."""
    out = np.zeros_like(line)
    left = corner = np.zeros(line.shape[1], np.int32)
    for x in range(len(line)):
        up = above[x]
        if paeth:
            p = left + up - corner
            a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            guess = (left + up) // 2
        out[x] = left = (line[x] + guess) & 255
        corner = up
    return out.astype(np.uint8)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Values at coordinates, and whether these lie inside the image."""
    h, w = image.shape[:2]
    inside = np.isfinite(x) & np.isfinite(y) & (x > -0.5) & (y > -0.5) & (x < w - 0.5) & (y < h - 0.5)
    x, y = np.where(inside, x, 0), np.where(inside, y, 0)
    if nearest:
        out = image[np.clip(np.rint(y).astype(int), 0, h - 1), np.clip(np.rint(x).astype(int), 0, w - 1)]
    else:
        x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
        x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
        x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
        fx, fy = x - x0, y - y0
        if image.ndim == 3:
            fx, fy = fx[..., None], fy[..., None]
        p = image.astype(float)
        mixed = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
        out = np.rint(mixed).astype(image.dtype)
    out = np.where(inside[..., None] if image.ndim == 3 else inside, out, 0).astype(image.dtype)
    return out, inside


def warp(image: np.ndarray, m: np.ndarray, size: tuple[int, int], nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The image through a 3x3 transform into a frame of (width, height), and the mask of what it covers."""
    inverse = np.linalg.inv(m)
    gx, gy = np.meshgrid(np.arange(size[0], dtype=float), np.arange(size[1], dtype=float))
    w = inverse[2, 0] * gx + inverse[2, 1] * gy + inverse[2, 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (inverse[0, 0] * gx + inverse[0, 1] * gy + inverse[0, 2]) / w
        y = (inverse[1, 0] * gx + inverse[1, 1] * gy + inverse[1, 2]) / w
    return sample(image, x, y, nearest)


def remap(image: np.ndarray, map_x: np.ndarray, map_y: np.ndarray, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The image through a field of source coordinates."""
    return sample(image, map_x, map_y, nearest)


def upsample(gx: np.ndarray, gy: np.ndarray, field: np.ndarray, width: int, height: int) -> np.ndarray:
    """A coarse field at its exact grid coordinates, bilinearly at every pixel."""
    return resample(gx, gy, field, np.arange(width), np.arange(height))


def resample(gx: np.ndarray, gy: np.ndarray, field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A field on a grid, bilinearly at columns ``x`` and rows ``y``; beyond the grid its edge goes on."""
    i, j = (np.clip(np.searchsorted(g, v, "right") - 1, 0, max(len(g) - 2, 0)) for g, v in ((gx, x), (gy, y)))
    i1, j1 = np.minimum(i + 1, len(gx) - 1), np.minimum(j + 1, len(gy) - 1)
    fx = np.clip((x - gx[i]) / np.maximum(1e-12, gx[i1] - gx[i]), 0, 1)[None, :]
    fy = np.clip((y - gy[j]) / np.maximum(1e-12, gy[j1] - gy[j]), 0, 1)[:, None]
    a = field[np.ix_(j, i)] * (1 - fx) + field[np.ix_(j, i1)] * fx
    b = field[np.ix_(j1, i)] * (1 - fx) + field[np.ix_(j1, i1)] * fx
    return a * (1 - fy) + b * fy


def three_channels(image: np.ndarray) -> np.ndarray:
    """A gray or colour image with three channels; an alpha channel goes."""
    return np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]


def alpha_mask(alpha: np.ndarray, rule: str = "positive") -> np.ndarray:
    """Valid pixels of an alpha channel: ``positive``, over ``half`` of 255, or from 50 % of its ``relative`` maximum."""
    if rule == "half":
        return alpha > 127
    if rule == "relative":
        return (alpha >= 0.5 * alpha.max()) & (alpha > 0)
    return alpha > 0


def _ellipse(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius + 0.5


def dilate(image: np.ndarray, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Colour and mask grown by an ellipse; new pixels take the greatest colour in reach."""
    if radius <= 0:
        return image, mask
    h, w = mask.shape
    color = np.where(mask[..., None] if image.ndim == 3 else mask, image, 0)
    out, grown = color.copy(), mask.copy()
    for dy, dx in np.argwhere(_ellipse(radius)) - radius:
        ys, xs = slice(max(0, dy), h + min(0, dy)), slice(max(0, dx), w + min(0, dx))
        yt, xt = slice(max(0, -dy), h + min(0, -dy)), slice(max(0, -dx), w + min(0, -dx))
        out[yt, xt] = np.maximum(out[yt, xt], color[ys, xs])
        grown[yt, xt] |= mask[ys, xs]
    keep = mask[..., None] if image.ndim == 3 else mask
    return np.where(keep, image, out), grown


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside the mask."""
    h, w = mask.shape
    far = float(h + w)
    column = np.where(mask, far, 0.0)
    for y in range(1, h):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    return np.sqrt(_envelope(column**2))


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over j of f[:, j] + (i - j)^2 for every column i: the lower envelope of parabolas, all rows side by side.

    Memory is a few times the image's, whatever its width.
    """
    h, w = f.shape
    row = np.arange(h)
    at = np.zeros((h, w), np.int64)  # parabolas of the envelope, as a stack a row
    start = np.full((h, w + 1), np.inf)
    start[:, 0] = -np.inf
    top = np.zeros(h, np.int64)
    for j in range(1, w):
        todo = row
        meet = np.empty(h)
        while len(todo):  # drop what the new parabola hides
            last = at[todo, top[todo]]
            cross = (f[todo, j] + j * j - f[todo, last] - last * last) / (2.0 * (j - last))
            hidden = cross <= start[todo, top[todo]]
            meet[todo] = cross
            todo = todo[hidden]
            top[todo] -= 1
        top += 1
        at[row, top], start[row, top] = j, meet
        start[row, np.minimum(top + 1, w)] = np.inf
    out, use = np.empty_like(f, dtype=float), np.zeros(h, np.int64)
    for i in range(w):
        todo = row
        while len(todo):
            todo = todo[start[todo, use[todo] + 1] < i]
            use[todo] += 1
        best = at[row, use]
        out[:, i] = f[row, best] + (i - best) ** 2.0
    return out


def composite(base: np.ndarray, covered: np.ndarray, layer: np.ndarray, mask: np.ndarray, feather: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First valid wins: the layer where the base is not covered yet; with ``feather`` newly covered pixels fade in from their edge."""
    new = mask & ~covered
    weight = np.clip(distance(mask) / feather, 0, 1) if feather else np.ones(mask.shape)
    weight = np.where(new, weight, 0)
    weight = weight[..., None] if base.ndim == 3 else weight
    return np.rint(base * (1 - weight) + layer * weight).astype(base.dtype), covered | mask


def overlay(visible: np.ndarray, thermal: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Thermal where the mask holds, else visible."""
    return np.where(mask[..., None] if visible.ndim == 3 else mask, thermal, visible)


def inpaint(image: np.ndarray, missing: np.ndarray, radius: int = 5) -> np.ndarray:
    """Missing pixels from known ones within the radius, weighted by distance, ring after ring.

    An approximation: fast marching takes gradients along as well.  Nothing
    known anywhere leaves the image as it is; a frame of which more than half
    is missing warns.
    """
    if missing.mean() > 0.5:
        warnings.warn(f"{missing.mean():.0%} of the frame has no source", stacklevel=2)
    out, known = image.astype(float), ~missing
    disk = np.argwhere(_ellipse(radius)) - radius
    disk = disk[(disk != 0).any(axis=1)]
    h, w = missing.shape
    while not known.all() and known.any():
        ring = ~known & dilate(known.astype(np.uint8), known, 1)[1]
        ys, xs = np.nonzero(ring)
        ny, nx = ys[:, None] + disk[:, 0], xs[:, None] + disk[:, 1]
        ok = (ny >= 0) & (nx >= 0) & (ny < h) & (nx < w)
        ny, nx = np.clip(ny, 0, h - 1), np.clip(nx, 0, w - 1)
        weight = (ok & known[ny, nx]) / (disk**2).sum(axis=1)
        near = out[ny, nx]
        weight = weight[..., None] if image.ndim == 3 else weight
        out[ys, xs] = (near * weight).sum(axis=1) / weight.sum(axis=1)
        known[ys, xs] = True
    return np.rint(out).astype(image.dtype)


def crop_box(points: np.ndarray, width: int, height: int, margin: int) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 around points with a margin, inside the frame."""
    lo, hi = np.floor(points.min(axis=0)) - margin, np.ceil(points.max(axis=0)) + margin + 1
    return max(0, int(lo[0])), max(0, int(lo[1])), min(width, int(hi[0])), min(height, int(hi[1]))


def source_box(m: np.ndarray, box: tuple[int, int, int, int], width: int, height: int, margin: int = 20) -> tuple[int, int, int, int]:
    """What a target box needs of the source frame: around the box's corners through the inverse transform."""
    x0, y0, x1, y1 = box
    corners = np.array([[x0, y0, 1], [x1 - 1, y0, 1], [x0, y1 - 1, 1], [x1 - 1, y1 - 1, 1]], float) @ np.linalg.inv(m).T
    if (corners[:, 2] <= 0).any() and (corners[:, 2] >= 0).any():  # the box reaches the horizon
        return 0, 0, width, height
    return crop_box(corners[:, :2] / corners[:, 2:], width, height, margin)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR image."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def warp_pairs(pairs: DataFrame) -> DataFrame:
    """idx, png, coverage, error: thermal PNGs (with ``m``: nine doubles, width, height) warped onto their visible frames.

    A pair that fails reports its error, and the others go on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    image = decode_png(bytes(r.thermal))
                    out, mask = warp(image[..., :3] if image.ndim == 3 else image, np.array(r.m, float).reshape(3, 3), (r.width, r.height))
                    color = out if out.ndim == 3 else np.repeat(out[..., None], 3, axis=2)
                    rows.append((r.idx, encode_png(np.dstack([color, mask.astype(np.uint8) * 255])), float(mask.mean()), None))
                except (ValueError, KeyError, struct.error, zlib.error, np.linalg.LinAlgError) as e:
                    rows.append((r.idx, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["idx", "png", "coverage", "error"])

    return pairs.mapInPandas(run, "idx string, png binary, coverage double, error string")


def resize_area(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Smaller by the mean of covered source pixels, with parts of pixels counted."""

    def weights(size: int, to: int) -> np.ndarray:
        edge = np.linspace(0, size, to + 1)
        at = np.arange(size)
        w = np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at)
        return np.clip(w, 0, None) * to / size

    out = np.tensordot(weights(image.shape[0], height), image.astype(float), axes=(1, 0))
    out = np.moveaxis(np.tensordot(weights(image.shape[1], width), out, axes=(1, 1)), 0, 1)
    return np.rint(out).astype(image.dtype)


def equalize(image: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of a gray image."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    table = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = image[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            count = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            over = np.clip(count - limit, 0, None).sum()
            table[i, j] = np.cumsum(np.minimum(count, limit) + over / 256) * 255 / max(1, part.size)
    cy, cx = (ys[:-1] + ys[1:]) / 2, (xs[:-1] + xs[1:]) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(tiles)), np.interp(np.arange(w), cx, np.arange(tiles))
    y0, x0 = np.minimum(fy.astype(int), tiles - 2)[:, None], np.minimum(fx.astype(int), tiles - 2)[None, :]
    wy, wx = fy[:, None] - y0, fx[None, :] - x0
    out = (table[y0, x0, image] * (1 - wx) + table[y0, x0 + 1, image] * wx) * (1 - wy) + (table[y0 + 1, x0, image] * (1 - wx) + table[y0 + 1, x0 + 1, image] * wx) * wy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def division_map(width: int, height: int, k: float, center: tuple[float, float], scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Where straightened pixels are in the distorted image: the first-order inverse of the division model."""
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    dx, dy = x - center[0], y - center[1]
    f = 1 - k * (dx * dx + dy * dy) / scale**2
    return center[0] + dx * f, center[1] + dy * f
