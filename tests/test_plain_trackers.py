"""Trackers, search region and motion stage against plain versions, frame by frame."""

import random

import numpy as np
import pytest
from plain_trackers import Association, Cascade, best_pairs
from pyspark.sql import functions as F

from sightline.functions import pixels
from sightline.operators import motion, trackers
from sightline.plans.queries import QUERIES, det

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    # boxes of the fixture are on a grid, where equal scores abound and rounding decides; each is moved by a little of its own
    own = lambda c, k: F.col(c) + F.pmod(F.col("det_id") * k, F.lit(9973)) / 4e6
    moved = det(spark, TINY).withColumns({"x0": own("x0", 7919), "y0": own("y0", 6007), "x1": own("x1", 5003), "y1": own("y1", 4001), "conf": own("conf", 3001)})
    return trackers.frames_of(moved.withColumn("t", F.col("frame_no") * 0.5)).cache()


@pytest.fixture(scope="module")
def frames(table):
    by_stream = {}
    for r in sorted((r.asDict(recursive=True) for r in table.collect()), key=lambda r: (r["stream_id"], r["t"])):
        by_stream.setdefault(r["stream_id"], []).append(r)
    return by_stream


def scene(seed, n=60, reid=True):
    """Walkers that cross, stop, hide and come back."""
    rng = random.Random(seed)
    people = [[rng.random() * 0.8, rng.random() * 0.7, rng.uniform(-0.03, 0.03), rng.uniform(-0.02, 0.02), rng.uniform(0.05, 0.15)] for _ in range(6)]
    out = []
    for k in range(n):
        dets = []
        for i, p in enumerate(people):
            p[0], p[1] = p[0] + p[2], p[1] + p[3]
            for c in (0, 1):
                if not 0 < p[c] < 0.85:
                    p[c + 2] *= -1
            if rng.random() < 0.8 and (k + 7 * i) % 23 > 4:
                x, y = p[0] + rng.gauss(0, 0.004), p[1] + rng.gauss(0, 0.004)
                d = {"det_id": 100 * k + i, "cl": int(rng.random() < 0.1), "conf": rng.choice([0.2, 0.55, 0.7, 0.95]), "x0": x, "y0": y, "x1": x + p[4], "y1": y + 2 * p[4]}
                if reid:
                    d |= {"reid": [float(i == j) + rng.gauss(0, 0.1) for j in range(4)], "pose_points": [{"x": x + p[4] / 2, "y": y - 0.01, "conf": rng.random()}]}
                dets.append(d)
        out.append({"frame_no": k, "t": k * 0.25 + (3 if k > 40 else 0), "dets": dets})
    return out


def test_cascade_equals_the_plain_one(table, frames):
    got = {}
    for r in trackers.track(table, trackers.CascadeTracker).collect():
        got.setdefault((r.stream_id, r.frame_no), []).append((r.track_id, r.state, r.det_id, r.observations, r.missed))
    n = 0
    for stream, rows in frames.items():
        plain = Cascade()
        for r in rows:
            want = plain.frame(r["t"], r["dets"])
            assert sorted(got.get((stream, r["frame_no"]), []), key=str) == sorted(want, key=str)
            n += len(want)
    assert n == sum(map(len, got.values())) > 100


def test_association_equals_the_plain_one(table, frames):
    got = {}
    for r in trackers.track(table, trackers.AssociationTracker).collect():
        got.setdefault((r.stream_id, r.frame_no), []).append((r.track_id, r.det_id))
    n = 0
    for stream, rows in frames.items():
        plain = Association()
        for r in rows:
            want = plain.frame(r["t"], r["dets"])
            assert sorted(got.get((stream, r["frame_no"]), [])) == sorted(want)
            n += len(want)
    assert n == sum(map(len, got.values())) > 100


@pytest.mark.parametrize("seed", range(6))
def test_walkers(seed):
    a, b = trackers.CascadeTracker(), Cascade()
    lived = 0
    for row in scene(seed):
        roi = (0.4, 0.4, 0.5, 0.5)
        assert np.allclose(a.search(row["t"], np.array(roi[:2]), np.array(roi[2:])), b.searched(row["t"], roi), atol=2e-4)
        got = [(r["track_id"], r["state"], r["det_id"], r["observations"], r["missed"]) for r in a.push(row)]
        assert got == b.frame(row["t"], row["dets"])
        lived += sum(r[3] > 3 for r in got)
    assert lived > 60
    a, b = trackers.AssociationTracker(), Association()
    for row in scene(seed, reid=False):
        assert [(r["track_id"], r["det_id"]) for r in a.push(row)] == b.frame(row["t"], row["dets"])


def test_assignment_is_the_best_of_all_ways():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost, limit = rng.random((n, m)), rng.uniform(0.2, 1.2)
        pairs, rows, columns = trackers.assignment(cost, limit)
        assert sorted(pairs) == sorted(best_pairs(cost.tolist(), limit)[0])
        assert sorted([a for a, _ in pairs] + rows) == list(range(n)) and sorted([b for _, b in pairs] + columns) == list(range(m))


def test_a_score_larger_by_over_one_goes_first():
    score = np.array([[0.1, 0.0], [1.15, 0.3]])
    assert trackers.greedy(score) == [(1, 0)]
    assert trackers.greedy(np.array([[0.1, 0.2], [1.05, 0.3]])) == [(0, 1), (1, 0)]


def test_reset_clears_the_cascade_and_not_the_association(spark):
    black = lambda v: {"width": 64, "height": 64, "y": bytes([v]) * 4096, "u": bytes([128]) * 1024, "v": bytes([128]) * 1024}
    dets = [{"det_id": 1, "cl": 0, "conf": 1.3, "x0": 0.1, "y0": 0.1, "x1": 0.3, "y1": 0.4}]
    rows = [{"frame_no": k, "t": float(k), "dets": dets, "cost": 50.0 if k == 8 else 1.0, **black(250 * (k % 2))} for k in range(14)]
    for make, kept in ((trackers.CascadeTracker, False), (trackers.AssociationTracker, True)):
        stage = motion.Searched(0.0, make)
        out = {r["frame_no"]: r for row in rows for r in stage.push(row)}
        assert [k for k, r in out.items() if r["changed"]] == [8]
        ids = {k: {x["track_id"] for x in r["tracks"]} for k, r in out.items() if r.get("tracks")}
        assert (ids[7] == ids[8]) is kept
        # what was looked at is known, and holds the tracks of the frame before
        assert out[8]["search"] == {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}


class Plain:
    """The motion stage by loops over pixels."""

    def __init__(self):
        self.reference = self.floor = None
        self.n, self.skipped = 0, False

    def frame(self, planes):
        now = []
        for p in planes:
            h, w = len(p), len(p[0])
            at = lambda y, x, p=p, h=h, w=w: int(p[min(h - 1, max(0, y))][min(w - 1, max(0, x))])
            k = (1, 4, 6, 4, 1)
            now.append([[(sum(k[a] * k[b] * at(y + a - 2, x + b - 2) for a in range(5) for b in range(5)) + 128) // 256 for x in range(w)] for y in range(h)])
        h, w = len(now[0]), len(now[0][0])
        if self.reference is None or len(self.reference[0]) != h or len(self.reference[0][0]) != w:
            self.floor, self.n, roi, blocks = [[0.0] * (w // 8) for _ in range(h // 8)], 0, (0, 0, 1, 1), 0
        else:
            up = lambda a, b: (a + b + 1) // 2

            def mad(i, x, y):
                d = lambda a, b: abs(now[i][b][a] - self.reference[i][b][a])
                return (sum(up(up(d(4 * x + k, 4 * y), d(4 * x + k, 4 * y + 1)), up(d(4 * x + k, 4 * y + 2), d(4 * x + k, 4 * y + 3))) for k in range(4)) + 2) // 4

            moving = set()
            for y in range(h // 8):
                for x in range(w // 8):
                    v = max([mad(0, 2 * x + a, 2 * y + b) for a in (0, 1) for b in (0, 1)] + [mad(1, x, y), mad(2, x, y)])
                    k = 0.9 * min(self.n, 16) / 16 if v < self.floor[y][x] else 0.995
                    self.floor[y][x] = self.floor[y][x] * k + v * (1 - k)
                    if v > self.floor[y][x] + 24:
                        moving.add((x, y))
            moving = {(x, y) for x, y in moving if moving & {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)}}
            self.n, blocks = self.n + 1, len(moving)
            roi = (min(x for x, _ in moving) * 8 / w, min(y for _, y in moving) * 8 / h, (max(x for x, _ in moving) + 1) * 8 / w, (max(y for _, y in moving) + 1) * 8 / h) if moving else (0, 0, 0, 0)
        size = (roi[2] - roi[0]) * (roi[3] - roi[1])
        self.skipped = size < (0.01 if self.skipped else 0.05)
        if not self.skipped and (size > 0.99 or self.reference is None):
            self.reference = now
        elif not self.skipped and size > 0:
            for i, half in enumerate((1, 2, 2)):
                hh, ww = len(now[i]), len(now[i][0])
                for y in range(hh):
                    for x in range(ww):
                        if roi[0] * w <= x * half < roi[2] * w and roi[1] * h <= y * half < roi[3] * h:
                            self.reference[i][y][x] = now[i][y][x]
        return blocks, tuple(map(float, roi)), self.skipped


@pytest.mark.parametrize("seed", range(3))
def test_motion_stage_by_pixels(seed):
    rng = np.random.default_rng(seed)
    a, b = motion.MotionStage(), Plain()
    skips = 0
    for k in range(25):
        w, h = (48, 32) if k < 20 else (32, 48)
        planes = [np.full((h, w), 90, np.uint8), np.full((h // 2, w // 2), 120, np.uint8), np.full((h // 2, w // 2), 130, np.uint8)]
        planes = [np.clip(p + rng.integers(-3, 4, p.shape), 0, 255).astype(np.uint8) for p in planes]
        if k % 4 < 2:
            i, x, y = int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.integers(0, 2))
            planes[i][8 * y : 8 * y + 16, 8 * x : 8 * x + 16] = 255
        row = {"frame_no": k, "t": float(k), "width": w, "height": h, "y": planes[0].tobytes(), "u": planes[1].tobytes(), "v": planes[2].tobytes()}
        (r,) = a.push(row)
        blocks, roi, skipped = b.frame([p.tolist() for p in planes])
        assert (r["blocks"], r["skipped"]) == (blocks, skipped) and np.allclose([r["x0"], r["y0"], r["x1"], r["y1"]], roi)
        assert np.allclose(r["floor"], np.ravel(b.floor)) and all((x == np.array(y)).all() for x, y in zip(a.motion.reference, b.reference, strict=True))
        skips += skipped
    assert 3 < skips < 22


def test_regions_are_rounded_to_even_pixels():
    old, new = np.zeros((10, 20), np.uint8), np.ones((10, 20), np.uint8)
    # 0.13 * 20 = 2.6 -> 3 -> 2; 0.43 * 20 = 8.6 -> 9 -> 10; 0.26 * 10 = 2.6 -> 2; 0.62 * 10 = 6.2 -> 6
    got = pixels.reference_updated(old, new, (0.13, 0.26, 0.43, 0.62))
    assert got[2:6, 2:10].all() and got.sum() == 4 * 8


def test_searched_tracks_see_all_frames(spark):
    out = QUERIES["searched_tracks"](spark, TINY)
    kinds = {r.result_type: r["count"] for r in out.groupBy("result_type").count().collect()}
    assert kinds["TRACK_FRAME_TRACKED_ROI"] > 5 and kinds["TRACK_FRAME_SKIP_NO_MOTION"] > 5 and out.where("n_tracks > 0").count() > 5
