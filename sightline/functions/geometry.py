"""Boxes, regions of interest and key points.

A box is anything that indexes to columns by x0, y0, x1, y1: a struct column,
or a dict of columns (see box()).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")

# Scales of the key points' spread, face then pose.
FACE_SCALES = [0.025, 0.025, 0.026, 0.025, 0.025]
POSE_SCALES = [0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089]


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2}


def scaled(b, sx, sy, dx=0.0, dy=0.0) -> dict[str, Column]:
    """clip(d + v * s): from the unit square of a region to that of the image."""
    return {s: clip01(F.lit(dx if s[0] == "x" else dy) + b[s] * F.lit(sx if s[0] == "x" else sy)) for s in SIDES}


def unscaled(b, sx, sy, dx=0.0, dy=0.0) -> dict[str, Column]:
    """clip((v - d) * s)"""
    return {s: clip01((b[s] - F.lit(dx if s[0] == "x" else dy)) * F.lit(sx if s[0] == "x" else sy)) for s in SIDES}


def scaled_points(points: Column, sx, sy, dx=0.0, dy=0.0) -> Column:
    return F.transform(points, lambda p: F.struct(clip01(F.lit(dx) + p["x"] * F.lit(sx)).alias("x"), clip01(F.lit(dy) + p["y"] * F.lit(sy)).alias("y"), p["conf"].alias("conf")))


def unmapped(b, roi) -> dict[str, Column]:
    """A box found inside a region, in the image's coordinates."""
    w, h = roi["x1"] - roi["x0"], roi["y1"] - roi["y0"]
    return {s: clip01((roi["x0"] if s[0] == "x" else roi["y0"]) + b[s] * (w if s[0] == "x" else h)) for s in SIDES}


def area(b) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def _overlap(a, b) -> tuple[Column, Column]:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def iou(a, b) -> Column:
    """Intersection over union; 0 for disjoint boxes and empty unions."""
    w, h = _overlap(a, b)
    union = area(a) + area(b) - w * h
    return F.when((w < 0) | (h < 0) | (union <= 0), 0.0).otherwise(w * h / F.nullif(union, F.lit(0.0)))


def iou_suppression(a, b) -> Column:
    """The form that suppression uses: a small term keeps the denominator from 0."""
    w, h = _overlap(a, b)
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return inter / (area(a) + area(b) - inter + F.lit(1e-7))


def iou_pixels(a, b, size: float = 640.0) -> Column:
    """The form that counts pixels, both edges included, at a fixed image size."""
    w, h = _overlap({s: a[s] * size for s in SIDES}, {s: b[s] * size for s in SIDES})
    w, h = w + 1, h + 1
    whole = lambda c: ((c["x1"] - c["x0"]) * size + 1) * ((c["y1"] - c["y0"]) * size + 1)
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / F.nullif(whole(a) + whole(b) - w * h, F.lit(0.0)))


def above(score: Column, least: float) -> Column:
    return F.when(score < least, 0.0).otherwise(score)


def part_overlap(a, b) -> Column:
    """Intersection over the smaller box."""
    w, h = _overlap(a, b)
    smaller = F.greatest(F.least(area(a), area(b)), F.lit(1.1754943508222875e-38))
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / smaller)


def point_similarity(found: Column, truth: Column, scales: list[float], truth_area: Column) -> Column:
    """Mean over labelled true points of a Gaussian of the distance to the point found."""
    pairs = F.zip_with(found, truth, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    labelled = F.filter(F.zip_with(pairs, F.array(*map(F.lit, scales)), lambda p, s: F.struct(p["a"].alias("a"), p["b"].alias("b"), s.alias("s"))), lambda p: p["b"]["conf"] > 0.3)
    spread = truth_area * 0.53

    def term(p: Column) -> Column:
        dx, dy = p["a"]["x"] - p["b"]["x"], p["a"]["y"] - p["b"]["y"]
        return F.exp(-(dx * dx + dy * dy) / (F.lit(2.0) * spread * p["s"] * p["s"] * 4 + F.lit(1e-7)))

    return F.aggregate(labelled, F.lit(0.0), lambda acc, p: acc + term(p)) / (F.size(labelled) + F.lit(1e-7))


def union(a, b) -> dict[str, Column]:
    return {"x0": F.least(a["x0"], b["x0"]), "y0": F.least(a["y0"], b["y0"]), "x1": F.greatest(a["x1"], b["x1"]), "y1": F.greatest(a["y1"], b["y1"])}


def to_aspect(b, aspect: float) -> dict[str, Column]:
    """The least box around b of width = aspect * height, moved into the unit square; all of it if it is too large."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    out = {}
    nw, nh = F.greatest(w, h * aspect), F.greatest(h, w / aspect)
    for lo, hi, n in (("x0", "x1", nw), ("y0", "y1", nh)):
        middle = (b[lo] + b[hi]) * 0.5
        start, end = middle - n * 0.5, middle + n * 0.5
        # moved right first, then left
        end = F.when(start < 0, end - start).otherwise(end)
        start = F.greatest(start, F.lit(0.0))
        start = F.when(end > 1, start - (end - 1)).otherwise(start)
        end = F.least(end, F.lit(1.0))
        whole = (nw > 1) | (nh > 1)
        out |= {lo: F.when(whole, 0.0).otherwise(start), hi: F.when(whole, 1.0).otherwise(end)}
    return out


def crop_pixels(b, width: int, height: int) -> dict[str, Column]:
    """The crop of a region, outward to even pixels and into the image; a region that covers all is the image."""
    out = {}
    whole = (b["x0"] <= 0) & (b["y0"] <= 0) & (b["x1"] >= 1) & (b["y1"] >= 1)
    for lo, hi, size in (("x0", "x1", width), ("y0", "y1", height)):
        start = (b[lo] * size).cast("int")
        end = F.ceil(b[hi] * size).cast("int")
        start = F.greatest(F.lit(0), start - F.pmod(start, F.lit(2)))
        end = F.least(F.lit(size), end + F.pmod(end, F.lit(2)))
        length = F.least(F.greatest(F.lit(0), end - start), F.lit(size) - start)
        out |= {lo: F.when(whole, 0).otherwise(start).cast("int"), hi: F.when(whole, size).otherwise(start + length).cast("int")}
    return out


def fit_size(w: Column, h: Column, max_w: int, max_h: int, stretch: int = 0, round_w: int = 0, round_h: int = 0, upscale: bool = False) -> tuple[Column, Column]:
    """Width and height of an image scaled into max_w x max_h: integer arithmetic, rounding to multiples, and a stretch of so many percent."""
    whole = lambda a, b: F.floor(a / b).cast("int")
    if upscale:
        wide = max_w * h < max_h * w
        rw, rh = F.when(wide, max_w).otherwise(whole(w * max_h, h)), F.when(wide, whole(h * max_w, w)).otherwise(max_h)
    else:
        rw, rh = F.when(w > max_w, max_w).otherwise(w), F.when(w > max_w, whole(h * max_w, w)).otherwise(h)
        rw, rh = F.when(rh > max_h, whole(rw * max_h, rh)).otherwise(rw), F.least(rh, F.lit(max_h))

    def rounded(x: Column, step: int, most: int) -> Column:
        if not step:
            return x
        x = x + (step >> 1)
        x = x - F.pmod(x, F.lit(step))
        return F.when(x > most, x - step).otherwise(x)

    rw, rh = rounded(rw, round_w, max_w), rounded(rh, round_h, max_h)
    if stretch:
        rw = F.when((rw > max_w * (100 - stretch) // 100) & (w >= max_w), max_w).otherwise(rw)
        rh = F.when((rh > max_h * (100 - stretch) // 100) & (h >= max_h), max_h).otherwise(rh)
    return rw.cast("int"), rh.cast("int")


def cell_range(b) -> tuple[Column, Column, Column, Column, Column]:
    """First and last column and row of the 8x8 cells a box touches, and whether it touches any."""
    some = (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]) & (b["x0"] < 1) & (b["y0"] < 1) & (b["x1"] > 0) & (b["y1"] > 0)
    first = lambda c: F.least(F.floor(clip01(c) * 8), F.lit(7)).cast("int")
    last = lambda c: F.greatest(F.ceil(clip01(c) * 8) - 1, F.lit(0)).cast("int")
    c0, c1, r0, r1 = first(b["x0"]), last(b["x1"]), first(b["y0"]), last(b["y1"])
    return c0, c1, r0, r1, some & (c1 >= c0) & (r1 >= r0)


def cells(b) -> Column:
    """Numbers (8 * row + column) of the cells a box touches, to explode for an equi-join."""
    c0, c1, r0, r1, some = cell_range(b)
    grid = F.flatten(F.transform(F.sequence(r0, F.greatest(r0, r1)), lambda r: F.transform(F.sequence(c0, F.greatest(c0, c1)), lambda c: (r * 8 + c).cast("int"))))
    return F.when(some, grid).otherwise(F.array().cast("array<int>"))


def cell_mask(b) -> Column:
    """The same cells as bits of a 64-bit integer."""
    return F.aggregate(cells(b), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))


def pose_box(b, points: Column, least: float = 0.05) -> dict[str, Column]:
    """b grown to cover the key points that are sure enough."""
    sure = F.filter(points, lambda p: p["conf"] > least)
    xs, ys = F.transform(sure, lambda p: p["x"]), F.transform(sure, lambda p: p["y"])
    return {"x0": F.least(b["x0"], F.array_min(xs)), "y0": F.least(b["y0"], F.array_min(ys)), "x1": F.greatest(b["x1"], F.array_max(xs)), "y1": F.greatest(b["y1"], F.array_max(ys))}


def pose_confidence(conf: Column, points: Column, weight: float = 0.004) -> Column:
    return conf + F.aggregate(F.coalesce(points, F.array().cast("array<struct<x: double, y: double, conf: double>>")), F.lit(0.0), lambda a, p: a + p["conf"].cast("double")) * weight


def face_quality(points: Column, subbox_conf: Column) -> Column:
    """Confidence x size x roll x yaw of five face points (eyes, nose, mouth corners); -1 without them."""
    p = [points[i] for i in range(5)]
    eyes, mouth = (p[0]["conf"] + p[1]["conf"]) * 0.5, (p[3]["conf"] + p[4]["conf"]) * 0.5
    overall = (eyes + p[2]["conf"] + mouth) / 3
    sure = overall * F.greatest(F.lit(0.0), (subbox_conf - 0.75) / 0.15)
    dx, dy = p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]
    apart = F.sqrt(dx * dx + dy * dy)
    size = F.least(F.lit(1.0), apart * 1.5) * eyes
    tilt = F.abs(F.atan2(dy, dx)) / (30.0 * 3.141592653589793 / 180.0)
    roll = F.when(tilt >= 1, 0.1).otherwise(1 - tilt)
    off = F.when(apart > 0, F.abs(p[2]["x"] - (p[0]["x"] + p[1]["x"]) * 0.5) / F.nullif(apart, F.lit(0.0))).otherwise(1.0)
    yaw = F.when(off >= 1, 0.1).otherwise(1 - off)
    return F.when(F.coalesce(F.size(points), F.lit(0)) != 5, -1.0).when(overall < 0.1, 0.0).otherwise(clip01(size * roll * yaw * sure))


def best_face(points: Column, sub) -> Column:
    """0.3 confidence + 0.4 frontality + 0.3 symmetry; 0 if a landmark is unsure or the face box is empty."""
    w, h = sub["x1"] - sub["x0"], sub["y1"] - sub["y0"]
    at = lambda i, s: (points[i][s] - sub[s + "0"]) / F.nullif(w if s == "x" else h, F.lit(0.0))
    mean = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["conf"]) / 5
    off = F.sqrt(F.pow(at(2, "x") - 0.5, F.lit(2.0)) + F.pow(at(2, "y") - 0.5, F.lit(2.0)))
    front = F.greatest(F.lit(0.0), 1 - off * 2)
    even = F.greatest(F.lit(0.0), 1 - F.abs((at(0, "x") + at(1, "x")) / 2 - 0.5) * 2)
    bad = (F.coalesce(F.size(points), F.lit(0)) != 5) | F.exists(points, lambda p: p["conf"] < 0.7) | (w <= 0) | (h <= 0)
    return F.when(bad, 0.0).otherwise(clip01(mean * 0.3 + front * 0.4 + even * 0.3))


def clip_quality(b, conf: Column) -> Column:
    return area(b) * conf
