"""Pixel kernels in NumPy: exact where the operation is in integers. on_images() runs one over image columns by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FNV, PRIME = 2166136261, 16777619


def fnv_rows(plane: np.ndarray) -> int:
    """FNV-1a of each row's bytes, then of the row hashes as 32-bit words, modulo 2**32."""
    rows = np.full(len(plane), FNV, np.uint64)
    for x in plane.reshape(len(plane), -1).T:
        rows = (rows ^ x) * PRIME & 0xFFFFFFFF
    h = FNV
    for r in rows.tolist():
        h = (h ^ r) * PRIME & 0xFFFFFFFF
    return h


def image_hash(planes: list[np.ndarray]) -> int:
    h = FNV
    for p in planes:
        h = (h ^ fnv_rows(p)) * PRIME & 0xFFFFFFFF
    return h


def frame_hash(total: int, h: int) -> int:
    """Order-dependent hash of frames, modulo 2**64."""
    return (total * 1315423911 + h) & (1 << 64) - 1


def half(plane: np.ndarray) -> np.ndarray:
    """2 x 2 means, rounded to nearest."""
    p = plane[: len(plane) // 2 * 2, : plane.shape[1] // 2 * 2].astype(np.uint16)
    return ((p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2] + 2) >> 2).astype(np.uint8)


def bilinear(plane: np.ndarray, w: int, h: int) -> np.ndarray:
    at = lambda n, size: np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
    y, x = at(h, plane.shape[0]), at(w, plane.shape[1])
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, plane.shape[0] - 1), np.minimum(x0 + 1, plane.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    p = plane.astype(float)
    top, bottom = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(np.uint8)


def scale(plane: np.ndarray, w: int, h: int) -> np.ndarray:
    """Halves while both sides are at least twice as large and multiples of four, then bilinear."""
    while plane.shape[1] >= 2 * w and plane.shape[0] >= 2 * h and plane.shape[0] % 4 == 0 and plane.shape[1] % 4 == 0:
        plane = half(plane)
    return plane if plane.shape == (h, w) else bilinear(plane, w, h)


@lru_cache(64)
def _edges(n: int) -> np.ndarray:
    return np.clip(np.arange(-2, n + 2), 0, n - 1)


def blur(plane: np.ndarray) -> np.ndarray:
    """5 x 5 Gaussian (1 4 6 4 1), edges repeated; of a plane, or of a stack of them at once."""
    h, w = plane.shape[-2:]
    # 256 times a byte, and a half, are 16 bits
    p = plane.take(_edges(h), -2).take(_edges(w), -1).astype(np.uint16 if plane.dtype == np.uint8 else np.int32)
    p = p[..., :h, :] + p[..., 4:, :] + (p[..., 1 : h + 1, :] + p[..., 3 : h + 3, :]) * 4 + p[..., 2 : h + 2, :] * 6
    p = p[..., :w] + p[..., 4:] + (p[..., 1 : w + 1] + p[..., 3 : w + 3]) * 4 + p[..., 2 : w + 2] * 6
    return ((p + 128) >> 8).astype(np.uint8)


def mad_4x4(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean absolute difference of 4 x 4 blocks: byte means that round up, nested, as the hardware takes them; then four sums, rounded. Of planes, or of stacks of them at once."""
    d = abs(a.astype(np.int16) - b.astype(np.int16))[..., : a.shape[-2] // 4 * 4, : a.shape[-1] // 4 * 4]
    up = lambda x, y: (x + y + 1) >> 1
    rows = up(up(d[..., 0::4, :], d[..., 1::4, :]), up(d[..., 2::4, :], d[..., 3::4, :]))
    return ((rows[..., 0::4] + rows[..., 1::4] + rows[..., 2::4] + rows[..., 3::4] + 2) >> 2).astype(np.uint8)


def crop(plane: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return plane[y : y + h, x : x + w]


def blend(over: np.ndarray, under: np.ndarray, x: int, y: int) -> np.ndarray:
    out = under.copy()
    out[y : y + over.shape[0], x : x + over.shape[1]] = over[: max(0, out.shape[0] - y), : max(0, out.shape[1] - x)]
    return out


def pad(plane: np.ndarray, left: int, top: int, right: int, bottom: int, value: int = 128) -> np.ndarray:
    return np.pad(plane, ((top, bottom), (left, right)), constant_values=value)


def tile(planes: list[np.ndarray], w: int, h: int, value: int = 128) -> np.ndarray:
    return np.stack([pad(p, 0, 0, w - p.shape[1], h - p.shape[0], value) for p in planes])


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """BT.709, limited range, chroma of half size repeated."""
    up = lambda p: np.repeat(np.repeat(p, 2, 0), 2, 1)[: y.shape[0], : y.shape[1]].astype(float) - 128
    l, cb, cr = (y.astype(float) - 16) * (255 / 219), up(u) * (255 / 224), up(v) * (255 / 224)
    rgb = np.stack([l + 1.5748 * cr, l - 0.187324 * cb - 0.468124 * cr, l + 1.8556 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def to_yuv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    l = 0.2126 * r + 0.7152 * g + 0.0722 * b
    mean = lambda p: p[: p.shape[0] // 2 * 2, : p.shape[1] // 2 * 2].reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3))
    whole = lambda p: np.clip(np.rint(p), 0, 255).astype(np.uint8)
    return whole(16 + l * 219 / 255), whole(128 + mean((b - l) / 1.8556) * 224 / 255), whole(128 + mean((r - l) / 1.5748) * 224 / 255)


def interleave(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([u, v], -1).reshape(u.shape[0], -1)


def deinterleave(uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return uv[:, ::2], uv[:, 1::2]


def affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of least squares from points to points."""
    a = np.concatenate([source, np.ones((len(source), 1))], 1)
    return np.linalg.lstsq(a, target, rcond=None)[0].T


def roi_affine(roi, w: int, h: int) -> np.ndarray:
    """From the pixels of a w x h picture to a region of the unit square."""
    x0, y0, x1, y1 = roi
    return np.array([[(x1 - x0) / w, 0, x0], [0, (y1 - y0) / h, y0]])


def warp(plane: np.ndarray, m: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear samples at m applied to each target pixel, edges repeated."""
    y, x = np.mgrid[:h, :w]
    sx, sy = (m[i, 0] * x + m[i, 1] * y + m[i, 2] for i in (0, 1))
    sx, sy = np.clip(sx, 0, plane.shape[1] - 1), np.clip(sy, 0, plane.shape[0] - 1)
    x0, y0 = sx.astype(int), sy.astype(int)
    x1, y1 = np.minimum(x0 + 1, plane.shape[1] - 1), np.minimum(y0 + 1, plane.shape[0] - 1)
    fx, fy, p = sx - x0, sy - y0, plane.astype(float)
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def aligned_face(plane: np.ndarray, points: np.ndarray, template: np.ndarray, w: int, h: int) -> np.ndarray:
    """The face whose five points (pixels) lie on the template's."""
    return warp(plane, affine(template, points), w, h)


def noise_roi(motion: np.ndarray, erode: bool = True) -> tuple[np.ndarray, float]:
    """Bounding box (unit square) and score of a frame's blocks with motion."""
    m = motion.astype(bool)
    if erode:
        near = np.zeros_like(m)
        near[1:] |= m[:-1]
        near[:-1] |= m[1:]
        near[:, 1:] |= m[:, :-1]
        near[:, :-1] |= m[:, 1:]
        m &= near
    y, x = np.nonzero(m)
    box = np.array([x.min() / m.shape[1], y.min() / m.shape[0], (x.max() + 1) / m.shape[1], (y.max() + 1) / m.shape[0]]) if len(x) else np.zeros(4)
    return box, float(m.sum() / (m.size + 1e-7))


def reference_updated(reference: np.ndarray, image: np.ndarray, roi, even: int = 2) -> np.ndarray:
    """The motion reference after a frame: replaced by it if the region covers all, kept if it is empty, else with the region's even pixels. even: 2 for luma; 1 for chroma planes, of half the size."""
    x0, y0, x1, y1 = roi
    covered = (x1 - x0) * (y1 - y0)
    if covered > 0.99:
        return image
    if covered <= 0:
        return reference
    h, w = image.shape
    full = 2 // even  # luma pixels for one of this plane
    near = lambda x, n: int(np.floor(x * n * full + 0.5))
    a, b = (near(x0, w) & ~1) // full, (near(y0, h) & ~1) // full
    c, d = min(w, ((near(x1, w) + 1) & ~1) // full), min(h, ((near(y1, h) + 1) & ~1) // full)
    return blend(crop(image, a, b, c - a, d - b), reference, a, b)


def on_images(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = "y") -> DataFrame:
    """frames (width, height, a plane as bytes) with the plane and size replaced by what kernel makes of it."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [kernel(np.frombuffer(p, np.uint8).reshape(h, w)) for p, w, h in zip(batch.column(column).to_pylist(), batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True)]
            new = {column: pa.array([np.ascontiguousarray(o).tobytes() for o in out], pa.binary()), "width": pa.array([o.shape[1] for o in out], pa.int32()), "height": pa.array([o.shape[0] for o in out], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names)

    return frames.mapInArrow(run, frames.schema)


#: Cost of the direct conversions between layouts.
CONVERSIONS = {("yuv420", "nv12"): 1, ("nv12", "yuv420"): 1, ("yuv420", "rgb24"): 3, ("rgb24", "yuv420"): 3, ("rgb24", "planar"): 2, ("planar", "rgb24"): 2, ("yuv420", "mono"): 1}


def conversion_path(source: str, target: str) -> list[str]:
    """The cheapest chain of conversions; just the layout if it is the target already."""
    best = {source: (0, [source])}
    while True:
        more = {b: (best[a][0] + c, [*best[a][1], b]) for (a, b), c in CONVERSIONS.items() if a in best and (b not in best or best[a][0] + c < best[b][0])}
        if not more:
            break
        best |= more
    if target not in best:
        raise ValueError(f"no way from {source} to {target}")
    return best[target][1]


def equal_images(a: list[np.ndarray], b: list[np.ndarray], within: int = 0) -> bool:
    return len(a) == len(b) and all(x.shape == y.shape and abs(x.astype(int) - y.astype(int)).max(initial=0) <= within for x, y in zip(a, b, strict=True))
