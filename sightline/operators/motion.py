"""The motion stage of a stream as one operator over pictures, and the search region of its tracker.

State goes along a stream: the reference picture, a noise floor for each block of
8 x 8 pixels, and what the last frame was. It feeds back: the region that was
looked at, which a tracker's predictions may have grown, is what of the
reference becomes the new picture, so a frame depends on what was decided for
the one before.

One frame (planes y, u, v of a size that 8 divides):

1. blur; the first picture, one of another size, or the one after a reset is the
   new reference and its region is everything;
2. mean absolute differences of 4 x 4 pixels from the reference, the largest of a
   block's four luma and two chroma values;
3. floors fall fast and rise slowly towards them; a block moves if it is far over
   its floor; a moving block without a moving neighbour is none;
4. region (bounding box of moving blocks) and score (their share);
5. a region below a threshold is skipped: the reference stays. Else the region
   looked at is blended into it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from sightline.functions import pixels
from sightline.operators.fold import Step, ordered_scan
from sightline.operators.pipeline import TRACK
from sightline.operators.steps import BestShot, MotionSkip, Throttle
from sightline.operators.trackers import CascadeTracker

ALL, NOTHING = (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)
PICTURE = "stream_id long, frame_no long, t double, width int, height int, y binary, u binary, v binary"
REGION = "x0 double, y0 double, x1 double, y1 double"


def area(roi) -> float:
    return (roi[2] - roi[0]) * (roi[3] - roi[1])


@dataclass
class Motion:
    """The state of the motion stage of one stream."""

    over: float = 24.0
    alpha: float = 0.9
    beta: float = 0.995
    ramp: int = 16
    erode: bool = True
    blur: bool = True
    sensitivity: float = 0.5
    reference: list[np.ndarray] | None = None
    picture: list[np.ndarray] | None = None
    floor: np.ndarray | None = None
    frames: int = 0  # since the last reset
    roi: tuple = ALL
    score: float = 0.0
    blocks: int = 0

    def add(self, planes: list[np.ndarray], cost: float | None = None) -> bool:
        """Takes a picture; whether its flow cost (mean over 5 of all cells, if known) tells of a new scene."""
        now = [pixels.blur(planes[0]), *pixels.blur(np.stack(planes[1:]))] if self.blur else planes
        self.picture = now
        if self.reference is None or self.reference[0].shape != now[0].shape:
            self.reference, self.frames, self.roi, self.blocks = None, 0, ALL, 0
            self.floor = np.zeros((now[0].shape[0] // 8, now[0].shape[1] // 8))
            return False
        y, (u, v) = pixels.mad_4x4(now[0], self.reference[0]), pixels.mad_4x4(np.stack(now[1:]), np.stack(self.reference[1:]))
        value = np.maximum.reduce([y[::2, ::2], y[1::2, ::2], y[::2, 1::2], y[1::2, 1::2], u, v]).astype(float)
        k = np.where(value < self.floor, self.alpha * min(self.frames, self.ramp) / self.ramp, self.beta)
        self.floor = self.floor * k + value * (1 - k)
        box, self.score = pixels.noise_roi(value > self.floor + self.over, self.erode)
        self.roi, self.blocks = tuple(box.tolist()), round(self.score * (value.size + 1e-7))
        # flow is looked at only where there is some motion
        new = cost is not None and self.sensitivity != 0 and area(self.roi) > 0.01 and cost > 16.0 * (1 - self.sensitivity) and self.frames > 2
        self.frames += 1
        return bool(new)

    def reset(self) -> None:
        """After a change of scene: everything is looked at, and floors ramp up again."""
        self.reference, self.roi, self.frames = None, ALL, 0

    def looked(self, roi) -> None:
        """The region that was looked at becomes part of the reference."""
        if area(roi) > 0.99:
            self.reference = self.picture
        elif area(roi) > 0 and self.reference is not None:
            self.reference = [pixels.reference_updated(old, new, roi, 2 if i == 0 else 1) for i, (old, new) in enumerate(zip(self.reference, self.picture, strict=True))]


def planes_of(row: dict) -> list[np.ndarray]:
    w, h = row["width"], row["height"]
    return [np.frombuffer(row[c], np.uint8).reshape(shape) for c, shape in (("y", (h, w)), ("u", (h // 2, w // 2)), ("v", (h // 2, w // 2)))]


@dataclass
class MotionStage(Step):
    """Frames (PICTURE, cost or null) in time order: region, score, blocks with motion, and whether the frame is skipped. What isn't skipped is looked at where it moves."""

    motion: Motion = field(default_factory=Motion)
    gate: MotionSkip = field(default_factory=MotionSkip)

    def push(self, row):
        changed = self.motion.add(planes_of(row), row.get("cost"))
        if changed:
            self.motion.reset()
        roi = self.motion.roi
        skipped = next(iter(self.gate.push({"area": area(roi)})))["skipped"]
        self.motion.looked(NOTHING if skipped else roi)
        yield {"frame_no": row["frame_no"], "blocks": self.motion.blocks, "score": self.motion.score, **dict(zip(("x0", "y0", "x1", "y1"), roi, strict=True)), "skipped": skipped, "changed": changed, "floor": self.motion.floor.ravel().tolist()}


STAGE = f"stream_id long, frame_no long, blocks int, score double, {REGION}, skipped boolean, changed boolean, floor array<double>"


def motion(pictures: DataFrame, make: Callable[[], Motion] = Motion) -> DataFrame:
    """The motion stage of every stream; a task holds a picture and the reference of one stream."""
    return ordered_scan(pictures, ["stream_id"], ["t", "frame_no"], lambda: MotionStage(make()), STAGE)


RESULT = f"stream_id long, frame_no long, t double, result_type string, motion struct<{REGION.replace(' double', ': double')}>, score double, search struct<{REGION.replace(' double', ': double')}>, changed boolean, tracks array<{TRACK}>"


@dataclass
class Searched(Step):
    """A stream from pictures to tracks: rate limit, motion stage, change of scene, skip, search region, tracker, best shots.

    The search region is known before the frame's detections are looked at: the
    region of motion, of the tracks of the frame before, and for each track its
    filter's, last and flow boxes and its moved points; grown and clipped. A
    detector would be run there (see `look`); rows that come with detections are
    taken as they are. A change of scene clears the motion stage and the cascade,
    not a tracker without reset().
    """

    min_dt: float = 0.0
    tracker: Callable[[], Step] = CascadeTracker
    look: Callable[[dict, tuple], list[dict]] | None = None  # detections of a row within a region

    def __post_init__(self):
        self.rate, self.gate, self.motion, self.track = Throttle(self.min_dt), MotionSkip(), Motion(), self.tracker()
        self.corner: np.ndarray | None = None
        self.shots: dict[int, BestShot] = {}

    def push(self, row):
        box = lambda roi: dict(zip(("x0", "y0", "x1", "y1"), map(float, roi), strict=True))
        out = {"frame_no": row["frame_no"], "t": row["t"], "changed": False}
        if row["y"] is None:
            yield out | {"result_type": "TRACK_FRAME_SKIP_NO_IMG"}
            return
        if not next(iter(self.rate.push({"t": row["t"], "has_image": True})))["kept"]:
            yield out | {"result_type": "TRACK_FRAME_SKIP_FRAMERATE"}
            return
        if self.motion.add(planes_of(row), row.get("cost")):
            self.motion.reset()
            out["changed"] = True
            if hasattr(self.track, "reset"):
                self.track.reset()
        roi = self.motion.roi
        out |= {"motion": box(roi), "score": self.motion.score}
        if next(iter(self.gate.push({"area": area(roi)})))["skipped"]:
            self.motion.looked(NOTHING)
            yield out | {"result_type": "TRACK_FRAME_SKIP_NO_MOTION", "search": box(NOTHING)}
            return
        lo, hi = np.array(roi[:2]), np.array(roi[2:])
        if self.corner is not None and self.corner.prod() > 0:
            lo = np.minimum(lo, self.corner)
        search = self.track.search(row["t"], lo, hi) if hasattr(self.track, "search") else tuple([*lo.tolist(), *hi.tolist()])
        dets = self.look(row, search) if self.look else row["dets"]
        self.motion.looked(search)
        tracks = []
        for k in self.track.push({**row, "dets": dets}):
            shot = self.shots.setdefault(k["track_id"], BestShot())
            if k["det_id"] is not None:
                list(shot.push({"q": (k["x1"] - k["x0"]) * (k["y1"] - k["y0"]) * k["conf"], "frame_no": row["frame_no"]}))
            tracks.append({**k, "best": shot.best, "best_frame": shot.best_frame})
        live = {k["track_id"] for k in tracks}
        self.shots = {i: s for i, s in self.shots.items() if i in live}
        if tracks:
            # of the tracks' region only the upper left corner is kept, as in the original rule
            self.corner = np.array([min(1.0, *(k[c] for k in tracks)) for c in ("x0", "y0")])
        yield out | {"result_type": "TRACK_FRAME_TRACKED_ROI", "search": box(search), "tracks": tracks}


def searched(frames: DataFrame, min_dt: float = 0.0, tracker: Callable[[], Step] = CascadeTracker) -> DataFrame:
    """Results of frames (PICTURE, dets, cost or null) of every stream."""
    return ordered_scan(frames, ["stream_id"], ["t", "frame_no"], lambda: Searched(min_dt, tracker), RESULT)
