"""Multi-object trackers. A tracker is the state of one stream; it takes a frame's detections and returns the frame's tracks.

Arithmetic of the filters is in 32-bit floats. Both trackers run per stream by
ordered_scan; a frame is one row with an array of its detections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from math import ceil, nan

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.fold import Step, ordered_scan

f32 = np.float32


class Kalman:
    """Constant-velocity filter over centre, aspect and height."""

    POSITION, VELOCITY = f32(1 / 20), f32(1 / 160)

    def __init__(self, measured: np.ndarray):
        self.mean = np.concatenate([measured, np.zeros(4)]).astype(f32)
        self.cov = np.diag(self._spread(measured[3], 2, 1e-2, 10, 1e-5) ** 2).astype(f32)

    def _spread(self, h, position: float, aspect: float, velocity: float, aspect_velocity: float) -> np.ndarray:
        p, v = position * self.POSITION * h, velocity * self.VELOCITY * h
        return np.array([p, p, aspect, p, v, v, aspect_velocity, v], f32)

    def ahead(self, dt: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance after dt."""
        move = np.eye(8, dtype=f32)
        move[range(4), range(4, 8)] = f32(dt)
        noise = np.diag(self._spread(abs(self.mean[3]), 1, 1e-2, 1, 1e-5) ** 2).astype(f32)
        return move @ self.mean, move @ self.cov @ move.T + noise

    def corrected(self, mean: np.ndarray, cov: np.ndarray, measured: np.ndarray) -> None:
        seen = cov[:4, :4] + np.diag(self._spread(abs(mean[3]), 1, 1e-1, 1, 0)[:4] ** 2).astype(f32)
        gain = np.linalg.solve(seen, cov[:4, :]).T.astype(f32)
        self.mean = (mean + gain @ (measured.astype(f32) - mean[:4])).astype(f32)
        self.cov = (cov - gain @ seen @ gain.T).astype(f32)


def to_measure(b) -> np.ndarray:
    w, h = b[2] - b[0], b[3] - b[1]
    return np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, w / h, h], f32)


def to_box(m: np.ndarray) -> np.ndarray:
    w = m[2] * m[3]
    return np.array([m[0] - w / 2, m[1] - m[3] / 2, m[0] + w / 2, m[1] + m[3] / 2], f32)


class BoxFilter:
    """A box's filter on the clock of the stream. predict() moves the state but not the time of the last update, so a later update moves it again (kept for equal results)."""

    RATE = 7.5

    def __init__(self, box, t: float):
        self.filter, self.t = Kalman(to_measure(box)), t

    def predict(self, t: float) -> np.ndarray:
        self.filter.mean, self.filter.cov = self.filter.ahead((t - self.t) * self.RATE)
        return to_box(self.filter.mean)

    def update(self, box, t: float) -> None:
        self.filter.corrected(*self.filter.ahead((t - self.t) * self.RATE), to_measure(box))
        self.t = t


class Filters:
    """Many box filters at once, a row of 24 numbers each: the mean, then for each measure the covariances position-position, position-velocity, velocity-position and velocity-velocity. Measures do not depend on each other, so the other entries of Kalman's matrix are zeros; all numbers are the same as there."""

    @staticmethod
    def _spread(h: np.ndarray, position: float, aspect: float) -> np.ndarray:
        out = np.empty((len(h), 4), f32)
        out[:] = (position * h)[:, None]
        out[:, 2] = aspect
        return out * out

    @staticmethod
    def measured(boxes: list) -> np.ndarray:
        b = np.array(boxes, np.float64)
        side = b[:, 2:] - b[:, :2]
        with np.errstate(all="ignore"):
            return np.concatenate([(b[:, :2] + b[:, 2:]) / 2, side[:, :1] / side[:, 1:], side[:, 1:]], 1).astype(f32)

    @classmethod
    def started(cls, boxes: list) -> np.ndarray:
        z = cls.measured(boxes)
        out = np.zeros((len(z), 24), f32)
        out[:, :4] = z
        out[:, 8:12], out[:, 20:] = cls._spread(z[:, 3], 2 * Kalman.POSITION, 1e-2), cls._spread(z[:, 3], 10 * Kalman.VELOCITY, 1e-5)
        return out

    @classmethod
    def ahead(cls, rows: np.ndarray, dt: list[float]) -> np.ndarray:
        """After dt seconds times the rate, for each row."""
        move, out = np.array(dt, f32)[:, None], np.empty_like(rows)
        wide, c = move.astype(np.float64), rows[:, 8:].astype(np.float64)
        h = abs(rows[:, 3])
        out[:, :4] = rows[:, :4] + move * rows[:, 4:8]
        out[:, 4:8] = rows[:, 4:8]
        half = (wide * np.concatenate([c[:, 8:], c[:, 12:]], 1) + c[:, :12]).astype(f32)
        out[:, 8:12] = (wide * half[:, 4:8] + half[:, :4]).astype(f32) + cls._spread(h, Kalman.POSITION, 1e-2)
        out[:, 12:20] = half[:, 4:]
        out[:, 20:] = rows[:, 20:] + cls._spread(h, Kalman.VELOCITY, 1e-5)
        if not np.isfinite(out[:, :4]).all():
            # a box without height has no aspect: its filter knows nothing, as a product of matrices has it
            out[~np.isfinite(out[:, :4]).all(1)] = np.nan
        return out

    @classmethod
    def corrected(cls, rows: np.ndarray, boxes: list) -> np.ndarray:
        n = len(rows)
        mean, cov = rows[:, :8].reshape(n, 2, 4), rows[:, 8:].reshape(n, 2, 2, 4)
        seen = (rows[:, 8:12] + cls._spread(abs(rows[:, 3]), Kalman.POSITION, 1e-1))[:, None]
        gain = rows[:, 8:16].reshape(n, 2, 4) / seen
        out = np.empty_like(rows)
        out[:, :8] = (mean + gain * (cls.measured(boxes) - rows[:, :4])[:, None]).reshape(n, 8)
        out[:, 8:] = (cov - (gain * seen)[:, :, None] * gain[:, None]).reshape(n, 16)
        return out

    @staticmethod
    def boxes(rows: np.ndarray) -> np.ndarray:
        side = rows[:, 2:4].copy()
        side[:, 0] *= rows[:, 3]
        side /= 2
        return np.concatenate([rows[:, :2] - side, rows[:, :2] + side], 1)

    @staticmethod
    def matrix(row: np.ndarray) -> np.ndarray:
        """The covariance of one filter, 8 x 8."""
        out, k = np.zeros((8, 8), f32), np.arange(4)
        for i, (a, b) in enumerate(((0, 0), (0, 4), (4, 0), (4, 4))):
            out[k + a, k + b] = row[8 + 4 * i : 12 + 4 * i]
        return out

    @staticmethod
    def of(mean, cov) -> np.ndarray:
        """A filter's row from its mean and covariance (matrix() takes it back)."""
        c, k = np.array(cov, f32).reshape(8, 8), np.arange(4)
        return np.concatenate([np.array(mean, f32), *(c[k + a, k + b] for a, b in ((0, 0), (0, 4), (4, 0), (4, 4)))])


_COLUMNS = [[sum(1 << c for c in range(a, b + 1)) for b in range(8)] for a in range(8)]
_ROWS = [[sum(1 << 8 * r for r in range(a, b + 1)) for b in range(8)] for a in range(8)]


def cells(b) -> int:
    """The cells of an 8 x 8 grid over the unit square that a box touches, as bits."""
    x0, y0, x1, y1 = b
    if not (x1 > x0 and y1 > y0 and x0 < 1 and y0 < 1 and x1 > 0 and y1 > 0):
        return 0
    columns = _COLUMNS[int(x0 * 8) if x0 > 0 else 0][ceil(x1 * 8) - 1 if x1 < 1 else 7]
    return columns * _ROWS[int(y0 * 8) if y0 > 0 else 0][ceil(y1 * 8) - 1 if y1 < 1 else 7]


def overlap(a, b, area_a: float, area_b: float) -> float:
    """overlaps() of two boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w >= 0 and h >= 0:
        union = area_a + area_b - w * h
        if union > 0:
            return w * h / union
    return 0.0


def box_area(b) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def common(a: np.ndarray, b: np.ndarray, more: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Width and height that each box of a (n x 4) shares with each of b (m x 4); below 0 where they are apart."""
    return tuple(np.minimum(a[:, None, i + 2], b[:, i + 2]) - np.maximum(a[:, None, i], b[:, i]) + more for i in (0, 1))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap over union of each box of a (n x 4) with each of b (m x 4)."""
    w, h = common(a, b)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b) - w * h
    return np.where((w >= 0) & (h >= 0) & (union > 0), w * h / np.where(union > 0, union, 1), 0.0)


def greedy(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with a score above 0, by score less the row's number from the largest on (the smaller row, then column of equals), each taken if row and column are free. So rows come in order, unless a score is larger by over 1."""
    if not score.size:
        return []
    a, b = np.nonzero(score > 0)
    return taken(zip((a - score[a, b]).tolist(), a.tolist(), b.tolist(), strict=True))


def taken(pairs: Iterable[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """greedy() of (row less score, row, column)."""
    out, rows, columns = [], set(), set()
    for _, a, b in sorted(pairs):
        if a not in rows and b not in columns:
            rows.add(a)
            columns.add(b)
            out.append((a, b))
    return out


def assignment(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pairs of least total cost where an unmatched row or column costs half the limit, and the rows and columns left over. Shortest augmenting paths over the extended square."""
    n, m = cost.shape
    if not n or not m:
        return [], list(range(n)), list(range(m))
    size = n + m
    c = np.full((size, size), limit / 2)
    c[n:, m:] = 0
    c[:n, :m] = cost
    u, v = np.zeros(size), np.zeros(size)
    row_of = np.full(size, -1)
    for i in range(size):
        dist, before, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, bool)
        row, col, total = i, -1, 0.0
        while True:
            through = total + c[row] - u[row] - v
            closer = ~done & (through < dist)
            dist[closer], before[closer] = through[closer], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            total = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        u[i] += total
        for j in np.flatnonzero(done).tolist():
            if j != col:
                u[row_of[j]] += total - dist[j]
            v[j] -= total - dist[j]
        while col >= 0:
            back = int(before[col])
            row_of[col] = i if back < 0 else row_of[back]
            col = back
    pairs = sorted((int(row_of[j]), j) for j in range(m) if row_of[j] < n)
    return pairs, sorted(set(range(n)) - {a for a, _ in pairs}), sorted(set(range(m)) - {b for _, b in pairs})


NEW, TRACKED, LOST = "new", "tracked", "lost"


#: The appearance of what has none.
NO_REID = np.zeros(1)


@dataclass(slots=True, eq=False)
class _Object:
    box: tuple[float, float, float, float]
    conf: float
    sure: float
    det_id: int | None
    reid: np.ndarray
    cells: int = 0
    area: float = 0.0
    filter: np.ndarray | None = None  # a row of Filters
    filter_t: float = 0.0
    id: int = 0
    state: str = NEW
    observations: int = 1
    missed: int = 0
    seen: float = 0.0
    predicted: tuple | list | None = None
    predicted_area: float = 0.0
    flow: tuple | None = None
    flow_area: float = 0.0
    span: tuple | None = None  # of the last, moved and predicted box
    reach: tuple | None = None
    weight: float = 0.0
    power: float = 0.0
    unit: np.ndarray | None = None
    points: list[np.ndarray] | tuple = ()  # pose points that are sure enough
    fiqa: float = 0.0


@dataclass
class CascadeParams:
    """Defaults of the three-pass tracker."""

    immediate_confirm: float = 1.18
    track: tuple[float, float, float] = (0.495, 0.9, 0.115)
    match: tuple[float, float, float] = (0.66, 0.225, 0.022)
    new_track: float = 0.57
    single_frame: float = 0.05
    reach: float = 0.1
    search: float = 0.05
    filter_weight: float = 1.0
    warm_up: float = 0.7
    likeness: float = 0.2
    duplicate: float = 0.82
    keep_s: float = 2.0
    confidence_power: float = 0.94
    pose_weight: float = 0.004
    most: int = 350
    first_id: int = 0xBEEF0000


@dataclass
class CascadeTracker(Step):
    """Three greedy passes of falling confidence over predicted boxes and mean-centred appearance vectors."""

    p: CascadeParams = field(default_factory=CascadeParams)
    single: bool = False
    move: Callable[[np.ndarray], np.ndarray] | None = None  # a box by optical flow
    move_point: Callable[[np.ndarray], np.ndarray] | None = None  # a point by optical flow
    tracks: list[_Object] = field(default_factory=list)
    next_id: int = 0
    predicted_at: float | None = None  # the time of a search whose frame has not come yet
    alike: bool = False  # whether anything of the frame has an appearance

    #: Pairs of a frame up to which they are looked at one by one.
    FEW = 256

    def __post_init__(self):
        self.next_id = self.p.first_id

    def reset(self) -> None:
        """Forgets all tracks; ids go on."""
        self.tracks, self.predicted_at = [], None

    def search(self, t: float, lo: np.ndarray, hi: np.ndarray) -> tuple[float, float, float, float]:
        """Where to look for what is tracked at time t, before its frame is seen: a region (lo, hi), each track's last, predicted and moved box, and its moved points; grown and clipped."""
        self._predict(t)
        self.predicted_at = t
        if self.tracks:
            spans = np.array([k.span for k in self.tracks])
            lo, hi = np.minimum(lo, spans[:, :2].min(0)), np.maximum(hi, spans[:, 2:].max(0))
        grow = self.p.search * 0.5 * np.maximum(0.05, hi - lo)
        return tuple(np.clip([*(lo - grow), *(hi + grow)], 0.0, 1.0).tolist())

    def _predict(self, t: float) -> None:
        """Filters of all tracks go ahead at once. This moves their state but not the time of their last update, so a later update moves it again (kept for equal results)."""
        if not self.tracks:
            return
        rows = Filters.ahead(np.array([k.filter for k in self.tracks]), [(t - k.filter_t) * BoxFilter.RATE for k in self.tracks])
        boxes = Filters.boxes(rows)
        areas = ((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).tolist()
        for k, row, predicted, area in zip(self.tracks, rows, boxes.tolist(), areas, strict=True):
            k.filter, k.predicted, k.predicted_area = row, predicted, area
            k.flow, k.flow_area = (k.box, k.area) if not (self.move or k.points) else self._moved(k)
            a0, a1, a2, a3 = k.box
            b0, b1, b2, b3 = k.flow
            c0, c1, c2, c3 = predicted
            total = a0 + a1 + a2 + a3 + b0 + b1 + b2 + b3 + c0 + c1 + c2 + c3
            x0, y0, x1, y1 = k.span = (min(a0, b0, c0), min(a1, b1, c1), max(a2, b2, c2), max(a3, b3, c3)) if total == total else (nan,) * 4
            w, h = (x1 - x0) * self.p.reach / 2, (y1 - y0) * self.p.reach / 2
            k.reach = x0 - w, y0 - h, x1 + w, y1 + h
            k.cells = cells(k.reach)
            k.weight = 0.0 if k.observations < 2 else self.p.filter_weight * (1 - max(0.1, 1 / k.observations) ** self.p.warm_up)

    def _moved(self, k: _Object) -> tuple[tuple, float]:
        """A track's box by optical flow, with its moved points, and its area."""
        flow = np.array(self.move(np.array(k.box)) if self.move else k.box, np.float64)
        for q in map(self.move_point, k.points) if self.move_point else k.points:
            flow = np.concatenate([np.minimum(flow[:2], q), np.maximum(flow[2:], q)])
        flow = tuple(flow.tolist())
        return flow, box_area(flow)

    def push(self, row):
        p, t, dets = self.p, row["t"], [self._object(d) for d in row["dets"] or () if d["cl"] == 0]
        dets.sort(key=lambda d: (-d.sure, d.det_id))
        if self.single:
            self.tracks = []
        if self.predicted_at != t:
            self._predict(t)
        self.predicted_at = None
        self._centre(dets)
        out, used, old = [], set(), self.tracks
        if dets and old:
            for d, power in zip(dets, (np.array([d.conf for d in dets]) ** p.confidence_power).tolist(), strict=True):
                d.power = power
        pairs = []
        for n in range(0 if self.single else 3):
            free = [d for d in dets if not d.id and d.sure > p.track[n]]
            live = [k for k in old if k.id not in used and (n or k.state != LOST)]
            if free and live:
                for a, b in self._pairs(free, live, p.match[n]):
                    self._take(free[a], live[b], t, n)
                    used.add(live[b].id)
                    pairs.append((free[a], live[b]))
        if pairs:
            rows = Filters.ahead(np.array([k.filter for _, k in pairs]), [(t - k.filter_t) * BoxFilter.RATE for _, k in pairs])
            for (d, _), own in zip(pairs, Filters.corrected(rows, [d.box for d, _ in pairs]), strict=True):
                d.filter, d.filter_t = own, t
                out.append(d)
        fresh = [d for d in dets if not d.id and d.sure > (p.single_frame if self.single else p.new_track)]
        if fresh:
            for d, own in zip(fresh, Filters.started([d.box for d in fresh]), strict=True):
                d.id, self.next_id = self.next_id, self.next_id + 1
                d.filter, d.filter_t, d.seen = own, t, t
                if d.sure > p.immediate_confirm or self.single:
                    d.state = TRACKED
                out.append(d)
        for k in old:
            if k.id not in used:
                k.missed += 1
                if (t - k.seen < p.keep_s and k.missed < 10 or k.state == TRACKED) and len(out) < p.most:
                    out.append(k)
        for k in out:
            if k.state == TRACKED and k.missed >= 2:
                k.state = LOST
        sure, lost = ([k for k in out if k.state == s] for s in (TRACKED, LOST))
        gone = set()
        if sure and lost:
            gone = {lost[b].id for _, b in self._duplicates(sure, lost)}
        self.tracks = [k for k in out if k.id not in gone] if gone else out
        for k in self.tracks:
            x0, y0, x1, y1 = k.box
            yield {"frame_no": row["frame_no"], "t": t, "track_id": k.id, "state": k.state, "det_id": k.det_id if k.seen == t else None, "conf": k.conf, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "observations": k.observations, "missed": k.missed}

    def _duplicates(self, sure: list[_Object], lost: list[_Object]) -> list[tuple[int, int]]:
        if len(sure) * len(lost) > self.FEW:
            alike = overlaps(np.array([k.box for k in sure]), np.array([k.box for k in lost]))
            return greedy(np.where(alike >= self.p.duplicate, alike, 0.0))
        pairs = ((a, b, overlap(k.box, o.box, k.area, o.area)) for a, k in enumerate(sure) for b, o in enumerate(lost))
        return taken([(a - s, a, b) for a, b, s in pairs if s >= self.p.duplicate and s > 0])

    #: What of a track goes from frame to frame.
    SAVED = "track_id long, state string, conf double, sure double, det_id long, observations int, missed int, seen double, fiqa double, filter_t double, box array<double>, reid array<double>, mean array<double>, cov array<double>, points array<double>"

    def saved(self) -> list[tuple]:
        """The tracks as rows of SAVED."""
        flat = lambda x: [float(v) for v in np.ravel(x)]
        return [(k.id, k.state, float(k.conf), float(k.sure), k.det_id, k.observations, k.missed, float(k.seen), float(k.fiqa), float(k.filter_t), flat(k.box), flat(k.reid), flat(k.filter[:8]), flat(Filters.matrix(k.filter)), flat(k.points) if k.points else []) for k in self.tracks]

    def restore(self, next_id: int, rows: list[tuple]) -> None:
        self.next_id, self.tracks = next_id, []
        for track_id, state, conf, sure, det_id, observations, missed, seen, fiqa, t, box, reid, mean, cov, points in rows:
            box, vector = tuple(map(float, box)), np.array(reid, np.float64)
            own = vector if vector.any() or len(vector) > 1 else NO_REID
            self.tracks.append(_Object(box, conf, sure, det_id, own, area=box_area(box), filter=Filters.of(mean, cov), filter_t=t, id=track_id, state=state, observations=observations, missed=missed, seen=seen, points=list(np.array(points, np.float64).reshape(-1, 2)), fiqa=fiqa))

    def _object(self, d: dict) -> _Object:
        box = d["x0"], d["y0"], d["x1"], d["y1"]
        box = tuple([nan if v is None else float(v) for v in box])
        points = d.get("pose_points") or ()
        sure = [np.array([q["x"], q["y"]]) for q in points if q["conf"] > 0.05]
        for q in sure:
            box = tuple(np.concatenate([np.minimum(box[:2], q), np.maximum(box[2:], q)]).tolist())
        reid = np.array(d["reid"], np.float64) if d.get("reid") else NO_REID
        return _Object(box, d["conf"], d["conf"] + self.p.pose_weight * sum(q["conf"] for q in points), d["det_id"], reid, cells(box), box_area(box), points=sure, fiqa=d.get("fiqa") or 0.0)

    def _centre(self, dets: list[_Object]) -> None:
        all_ = [*dets, *self.tracks]
        self.alike = any(k.reid is not NO_REID for k in all_)
        if not self.alike:
            return
        mean = sum(k.reid for k in all_) / (len(all_) + 1e-7)
        for k in all_:
            v = k.reid - mean
            n = float(np.sqrt(v @ v))
            k.unit = v / n if n > 0 else v

    def _pairs(self, dets: list[_Object], tracks: list[_Object], least: float) -> list[tuple[int, int]]:
        """The greedy choice by _scores(): for few objects pair by pair, where arrays would cost more than they save."""
        if len(dets) * len(tracks) > self.FEW:
            return greedy(self._scores(dets, tracks, least))
        like = self._likeness(dets, tracks)
        found = []
        for a, d in enumerate(dets):
            box, own = d.box, d.cells
            for b, k in enumerate(tracks):
                if own & k.cells:
                    r = k.reach
                    if (min(box[2], r[2]) - max(box[0], r[0])) * (min(box[3], r[3]) - max(box[1], r[1])) > 0:
                        score = overlap(box, k.flow, d.area, k.flow_area)
                        if k.weight:
                            score = (score + k.weight * overlap(box, k.predicted, d.area, k.predicted_area)) / (1 + k.weight)
                        if like is not None:
                            score += self.p.likeness * like[a][b]
                        if score >= least and score * d.power > 0:
                            found.append((a - score * d.power, a, b))
        return taken(found)

    def _likeness(self, dets: list[_Object], tracks: list[_Object]) -> list[list[float]] | None:
        return (np.array([d.unit for d in dets]) @ np.array([k.unit for k in tracks]).T).tolist() if self.alike else None

    def _scores(self, dets: list[_Object], tracks: list[_Object], least: float) -> np.ndarray:
        """Score of each detection with each track, 0 where they are no candidates or it is below `least`."""
        column = lambda rows, name, kind=np.float64: np.array([getattr(k, name) for k in rows], kind)
        box, weight = column(dets, "box"), column(tracks, "weight")
        w, h = common(box, column(tracks, "reach"))
        candidates = (column(dets, "cells", np.uint64)[:, None] & column(tracks, "cells", np.uint64) != 0) & (w * h > 0)  # only what shares a cell is a candidate
        score = (overlaps(box, column(tracks, "flow")) + weight * overlaps(box, column(tracks, "predicted", f32))) / (1 + weight)
        like = self._likeness(dets, tracks)
        if like is not None:
            score += self.p.likeness * np.array(like)
        return np.where(candidates & (score >= least), score * column(dets, "power")[:, None], 0.0)

    def _take(self, d: _Object, k: _Object, t: float, n: int) -> None:
        d.id, d.observations, d.seen = k.id, k.observations + 1, t
        if d.reid is not NO_REID or k.reid is not NO_REID:
            d.reid = (d.reid + k.reid) / 2
        d.fiqa = (d.fiqa + k.fiqa) / 2
        d.state = TRACKED if n < 2 or k.state == LOST else k.state


@dataclass
class _Strack:
    box: np.ndarray  # pixels
    score: float
    det_id: int | None = None
    filter: Kalman | None = None
    id: int = 0
    state: str = NEW
    active: bool = False
    start: int = 0
    frame: int = 0
    time: float = 0.0

    def measured(self) -> np.ndarray:
        return to_measure(self.box)


def _near(a: list[_Strack], b: list[_Strack]) -> np.ndarray:
    """1 - IoU with both edge pixels counted."""
    if not a or not b:
        return np.ones((len(a), len(b)))
    x, y = (np.array([s.box for s in rows], np.float64) for rows in (a, b))
    w, h = common(x, y, 1.0)
    area = lambda z: (z[:, 2] - z[:, 0] + 1) * (z[:, 3] - z[:, 1] + 1)
    meet = (w > 0) & (h > 0)
    return np.where(meet, 1 - w * h / np.where(meet, area(x)[:, None] + area(y) - w * h, 1), 1.0)


@dataclass
class AssociationParams:
    """The two-threshold tracker has no defaults of its own; these are usual ones."""

    high: float = 0.5
    low: float = 0.1
    new_track: float = 0.6
    match: tuple[float, float, float] = (0.8, 0.5, 0.7)
    duplicate: float = 0.15
    keep_s: float = 2.0
    size: float = 640.0


@dataclass
class AssociationTracker(Step):
    """Optimal assignment of sure detections, then of unsure ones to what is left, then of sure ones to unconfirmed tracks."""

    p: AssociationParams = field(default_factory=AssociationParams)
    tracked: list[_Strack] = field(default_factory=list)
    lost: list[_Strack] = field(default_factory=list)
    removed: set[int] = field(default_factory=set)
    frame: int = 0
    last: float = 0.0
    next_id: int = 0

    def push(self, row):
        t = row["t"]
        dt = t - self.last
        dt = 0.2 if dt < 0 or dt > 2 or not self.frame else dt
        self.last, self.frame = t, self.frame + 1
        seen = [_Strack(np.array([d["x0"], d["y0"], d["x1"], d["y1"]], np.float64) * self.p.size, d["conf"], d["det_id"]) for d in row["dets"] or () if d["cl"] == 0 and d["conf"] >= self.p.low]
        high, low = [s for s in seen if s.score >= self.p.high], [s for s in seen if s.score < self.p.high]
        unconfirmed, known = [s for s in self.tracked if not s.active], [s for s in self.tracked if s.active]
        pool = known + [s for s in self.lost if s.id not in {k.id for k in known}]
        for s in pool:
            if s.state != TRACKED:
                s.filter.mean[7] = 0
            s.filter.mean, s.filter.cov = s.filter.ahead(dt * 5)
            s.box = to_box(s.filter.mean)
        fresh: list[_Strack] = []
        pairs, rest, left = assignment(_near(pool, high), self.p.match[0])
        for a, b in pairs:
            fresh.append(self._renew(pool[a], high[b], t))
        rest = [pool[i] for i in rest if pool[i].state == TRACKED]
        pairs, gone, _ = assignment(_near(rest, low), self.p.match[1])
        for a, b in pairs:
            fresh.append(self._renew(rest[a], low[b], t))
        newly_lost = [rest[i] for i in gone]
        for s in newly_lost:
            s.state = LOST
        high = [high[i] for i in left]
        pairs, gone, left = assignment(_near(unconfirmed, high), self.p.match[2])
        for a, b in pairs:
            fresh.append(self._renew(unconfirmed[a], high[b], t))
        for i in gone:
            unconfirmed[i].state = "removed"
            self.removed.add(unconfirmed[i].id)
        for i in left:
            s = high[i]
            if s.score >= self.p.new_track:
                self.next_id += 1
                s.id, s.state, s.filter, s.active = self.next_id, TRACKED, Kalman(s.measured()), self.frame == 1
                s.start = s.frame = self.frame
                s.time = t
                fresh.append(s)
        self.removed |= {s.id for s in self.lost if s.state == LOST and t - s.time > self.p.keep_s}
        self.tracked = self._joined([s for s in self.tracked if s.state == TRACKED], fresh)
        now = {s.id for s in self.tracked}
        self.lost = sorted([s for s in [*self.lost, *newly_lost] if s.id not in now and s.id not in self.removed], key=lambda s: s.id)
        self.removed &= {s.id for s in [*self.tracked, *self.lost]}
        near = np.argwhere(_near(self.tracked, self.lost) < self.p.duplicate).tolist()
        drop_a, drop_b = set(), set()
        for a, b in near:
            age = self.tracked[a].frame - self.tracked[a].start, self.lost[b].frame - self.lost[b].start
            (drop_b.add(b) if age[0] > age[1] else drop_a.add(a))
        self.tracked, self.lost = [s for i, s in enumerate(self.tracked) if i not in drop_a], [s for i, s in enumerate(self.lost) if i not in drop_b]
        for s in self.tracked:
            x0, y0, x1, y1 = (float(v) / self.p.size for v in s.box)
            yield {"frame_no": row["frame_no"], "t": t, "track_id": s.id, "state": s.state, "det_id": s.det_id, "conf": 1.0, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "observations": self.frame - s.start + 1, "missed": 0}

    def _renew(self, s: _Strack, d: _Strack, t: float) -> _Strack:
        s.filter.corrected(s.filter.mean, s.filter.cov, d.measured())
        s.box, s.score, s.det_id = to_box(s.filter.mean), d.score, d.det_id
        s.state, s.active, s.frame, s.time = TRACKED, True, self.frame, t
        return s

    @staticmethod
    def _joined(a: list[_Strack], b: list[_Strack]) -> list[_Strack]:
        ids = {s.id for s in a}
        return a + [s for s in b if s.id not in ids and not ids.add(s.id)]


TRACK_COLUMNS = "stream_id long, frame_no long, t double, track_id long, state string, det_id long, conf double, x0 double, y0 double, x1 double, y1 double, observations int, missed int"


def frames_of(det: DataFrame, more: list[str] = []) -> DataFrame:
    """stream_id, frame_no, t and the array of detections of each frame."""
    item = F.struct("det_id", "cl", "conf", "x0", "y0", "x1", "y1", *more)
    return det.groupBy("stream_id", "frame_no").agg(F.min("t").alias("t"), F.sort_array(F.collect_list(item)).alias("dets"))


def track(frames: DataFrame, make: Callable[[], Step] = CascadeTracker) -> DataFrame:
    """The tracks of every frame, streams side by side."""
    return ordered_scan(frames.select("stream_id", "frame_no", "t", "dets"), ["stream_id"], ["t", "frame_no"], make, TRACK_COLUMNS, few=True)
