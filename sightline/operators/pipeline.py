"""The per-stream pipeline from frames with detections to results: rate limit, motion gate, tracking, best shots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sightline.operators.fold import Step, ordered_scan
from sightline.operators.steps import BestShot, MotionSkip, Throttle
from sightline.operators.trackers import CascadeTracker

TRACK = "struct<track_id: long, state: string, det_id: long, conf: double, x0: double, y0: double, x1: double, y1: double, best: double, best_frame: long>"
RESULTS = f"stream_id long, frame_no long, t double, result_type string, tracks array<{TRACK}>"


@dataclass
class StreamPipeline(Step):
    """Frames in time order (frame_no, t, area of motion or null, dets): frames that are skipped have null tracks. Enrichment state of a track goes with the track."""

    min_dt: float = 0.0
    tracker: Callable[[], Step] = CascadeTracker
    shots: dict[int, BestShot] = field(default_factory=dict)

    def __post_init__(self):
        self.rate, self.gate, self.track = Throttle(self.min_dt), MotionSkip(), self.tracker()

    def push(self, row):
        out = {"frame_no": row["frame_no"], "t": row["t"], "tracks": None}
        if row.get("has_image") is False:
            yield out | {"result_type": "TRACK_FRAME_SKIP_NO_IMG"}
            return
        if not next(iter(self.rate.push({"t": row["t"], "has_image": True})))["kept"]:
            yield out | {"result_type": "TRACK_FRAME_SKIP_FRAMERATE"}
            return
        area = row.get("area")
        if area is not None and next(iter(self.gate.push({"area": area})))["skipped"]:
            yield out | {"result_type": "TRACK_FRAME_SKIP_NO_MOTION"}
            return
        tracks = []
        for k in self.track.push(row):
            shot = self.shots.get(k["track_id"])
            if shot is None:
                shot = self.shots[k["track_id"]] = BestShot()
            if k["det_id"] is not None:
                list(shot.push({"q": (k["x1"] - k["x0"]) * (k["y1"] - k["y0"]) * k["conf"], "frame_no": row["frame_no"]}))
            tracks.append({**k, "best": shot.best, "best_frame": shot.best_frame})
        live = {k["track_id"] for k in tracks}
        self.shots = {i: s for i, s in self.shots.items() if i in live}
        yield out | {"result_type": "TRACK_FRAME_TRACKED_ROI", "tracks": tracks}


def track_streams(frames: DataFrame, min_dt: float = 0.0, tracker: Callable[[], Step] = CascadeTracker) -> DataFrame:
    """The results of every frame of every stream."""
    return ordered_scan(frames, ["stream_id"], ["t", "frame_no"], lambda: StreamPipeline(min_dt, tracker), RESULTS, few=True)


def stats(results: DataFrame) -> DataFrame:
    """Frames of each result type and mean tracks of each stream (K8)."""
    from pyspark.sql import functions as F

    return results.groupBy("stream_id", "result_type").agg(F.count("*").alias("frames"), F.avg(F.size("tracks")).alias("mean_tracks"))
