"""The objects a user of detections and frames works with: lists of dicts in, lists of dicts out.

They are thin: each builds DataFrames and runs the same operators that
sightline.operators offers for tables. A detection is a dict with box (x0, y0,
x1, y1), confidence and class, and optionally track_id, face_points (15 numbers)
and pose_points (51 numbers).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.config import InferConfig, get, merged
from sightline.functions import geometry as g
from sightline.functions import pixels
from sightline.operators import detector, matching
from sightline.operators.pipeline import stats, track_streams
from sightline.operators.steps import NoiseFloor, RtpReceiver
from sightline.operators.trackers import AssociationTracker, BoxFilter, CascadeTracker, frames_of
from sightline.sources import media

VERSION = "0.1.0"
BOX, FACE_POINTS, POSE_POINTS, FACE_OF_PERSON = range(4)
POINT = "array<struct<x: double, y: double, conf: double>>"
PARSED = f"stream_id long, frame_no long, det_id long, cl int, conf double, x0 double, y0 double, x1 double, y1 double, track_id long, face_points {POINT}, pose_points {POINT}"


def get_version() -> str:
    return VERSION


def log_set_level(level: str) -> None:
    logging.getLogger("sightline").setLevel(level.upper())


def _points(values, n: int):
    if values is None:
        return None
    if len(values) != 3 * n:
        raise ValueError(f"{len(values)} numbers for {n} points")
    return [(float(values[k]), float(values[k + 1]), float(values[k + 2])) for k in range(0, 3 * n, 3)]


def parse_detection(d: dict, frame_no: int = 0, det_id: int = 0, stream_id: int = 0) -> tuple:
    """A detection dict as a row; box, confidence and class are needed, and points must be whole."""
    x0, y0, x1, y1 = map(float, d["box"])
    return (stream_id, frame_no, det_id, int(d["class"]), float(d["confidence"]), x0, y0, x1, y1, d.get("track_id"), _points(d.get("face_points"), 5), _points(d.get("pose_points"), 17))


def detections(spark: SparkSession, frames: Iterable[list[dict]], stream_id: int = 0) -> DataFrame:
    rows = [parse_detection(d, f, k, stream_id) for f, dets in enumerate(frames) for k, d in enumerate(dets)]
    return spark.createDataFrame(rows, PARSED)


def match_score(match_type: int, least: float) -> Column:
    """Over a_ and b_ columns: overlap of boxes, or similarity of key points where boxes overlap enough."""
    near = g.above(g.iou(g.box("a_"), g.box("b_")), least)
    if match_type == BOX:
        return near
    name, scales = ("pose_points", g.POSE_SCALES) if match_type == POSE_POINTS else ("face_points", g.FACE_SCALES)
    return F.when(near > 0, g.point_similarity(F.col(f"a_{name}"), F.col(f"b_{name}"), scales, g.area(g.box("b_")))).otherwise(0.0)


def match_boxes(a: DataFrame, b: DataFrame, iou_thr: float, match_type: int = BOX) -> DataFrame:
    """stream_id, frame_no, a_id, b_id, score; a and b of one class."""
    more = ["cl"] + {BOX: [], POSE_POINTS: ["pose_points"]}.get(match_type, ["face_points"])
    score = F.when(F.col("a_cl") == F.col("b_cl"), match_score(match_type, iou_thr)).otherwise(0.0)
    return matching.match_boxes(a, b, "det_id", "det_id", iou_thr, score, more)


def match_box_iou(spark: SparkSession, dets_a: list[dict], dets_b: list[dict], iou_thr: float, match_type: int = BOX) -> tuple[list[int], list[int]]:
    """Indices of matched pairs."""
    rows = match_boxes(detections(spark, [dets_a]), detections(spark, [dets_b]), iou_thr, match_type).orderBy("a_id").collect()
    return [r.a_id for r in rows], [r.b_id for r in rows]


@dataclass
class MotaMetrics:
    """Frames of tracked and true objects; the metrics of all frames so far."""

    spark: SparkSession
    hyp: list = field(default_factory=list)
    gt: list = field(default_factory=list)
    frames: int = 0

    def add_frame(self, dets: list[dict], truths: list[dict]) -> None:
        for rows, source in ((self.hyp, dets), (self.gt, truths)):
            rows += [(0, self.frames, int(d["track_id"]), *map(float, d["box"])) for d in source]
        self.frames += 1

    def get_results(self) -> dict:
        kind = "stream_id long, frame_no long, {} long, x0 double, y0 double, x1 double, y1 double"
        hyp, gt = self.spark.createDataFrame(self.hyp, kind.format("track_id")), self.spark.createDataFrame(self.gt, kind.format("gt_id"))
        return matching.mota_summary(hyp, gt, by=[]).first().asDict()


class KalmanBoxTracker(BoxFilter):
    """A box's filter: predict(t) and update(box, t)."""


@dataclass
class MotionTracker:
    """Motion of a stream of images (planes of one size): floors of blocks, region of motion, reference picture."""

    over: float = 24.0
    reference: np.ndarray | None = None
    roi: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 1, 1]))
    score: float = 0.0
    floor: np.ndarray | None = None
    n: int = 0

    def add_frame(self, plane: np.ndarray) -> None:
        plane = pixels.blur(plane)
        if self.reference is None or self.reference.shape != plane.shape:
            self.reference, self.floor, self.n, self.roi = plane, None, 0, np.array([0.0, 0, 1, 1])
            return
        mad = pixels.mad_4x4(plane, self.reference)
        v = np.maximum.reduce([mad[::2, ::2], mad[1::2, ::2], mad[::2, 1::2], mad[1::2, 1::2]]).astype(float)
        rule = NoiseFloor()
        floor = np.zeros_like(v) if self.floor is None else self.floor
        k = np.where(v < floor, rule.alpha * min(self.n, rule.ramp) / rule.ramp, rule.beta)
        self.floor, self.n = floor * k + v * (1 - k), self.n + 1
        self.roi, self.score = pixels.noise_roi(v > self.floor + self.over)
        self._last = plane

    def get_roi(self) -> np.ndarray:
        return self.roi

    def set_roi(self, roi) -> None:
        """The region that was looked at becomes part of the reference."""
        if self.reference is not None and hasattr(self, "_last"):
            self.reference = pixels.reference_updated(self.reference, self._last, roi)


class PcapDecoder:
    """Access units of a capture, one at a time, by way of the receiver: late and repeated packets, lost ones and times that wrap are dealt with as in streams. Pictures need a decoder, which does not come with the library."""

    def __init__(self, data: bytes):
        sdp = media.pcap_sdp(data)
        codec = media.H265 if sdp and "H265" in sdp else media.H264
        want = media.receiver_config([m for m in media.parse_sdp(sdp) if m["kind"] == "video"]) if sdp else None
        receiver = RtpReceiver(codec)
        packets = (h for p in media.pcap_rtp(data) if (h := media.rtp_header(p["data"])) and (want is None or h["pt"] == want["pt"]))
        units = chain(chain.from_iterable(map(receiver.push, packets)), receiver.end())
        self._units = ({"ts90k": u["ts64"], "nals": media.split_annexb(u["data"]), "complete": u["complete"]} for u in units if u["n_nals"])

    def get_frame(self) -> dict | None:
        return next(self._units, None)


class TrackSharedState:
    """Settings that streams share."""

    def __init__(self, settings: dict | None = None):
        self.settings = settings or {}

    def get(self, path: str, default=None):
        return get(self.settings, path, default)


class TrackStream:
    """A stream's pipeline over tables of frames (stream_id, frame_no, t, dets, and area of motion or null)."""

    def __init__(self, shared: TrackSharedState, settings: dict | None = None, name: str = ""):
        self.settings, self.name = merged(shared.settings, settings or {}), name
        self.min_dt, self._results = get(self.settings, "min_interval", 0.0), []
        self.codec, self.pt = media.H264, None

    def set_sdp(self, text: str) -> None:
        """The description of the stream: packets of its video's payload type are received, as that codec."""
        found = media.receiver_config([m for m in media.parse_sdp(text) if m["kind"] == "video"])
        if found is None:
            raise ValueError("the description names no video")
        self.codec, self.pt = media.H265 if found["codec"].upper() == "H265" else media.H264, found["pt"]

    def add_rtp_packets(self, packets: DataFrame) -> DataFrame:
        """Access units of packets (stream_id, arrival_no, data). A decoder, which does not come with the library, makes pictures of them for run_on_images."""
        return media.received_units(packets, "stream_id", self.codec, self.pt)

    def run_on_images(self, images: DataFrame, load: Callable, md: ModelDescription, cfg: InferConfig, width: float, height: float) -> DataFrame:
        """The pipeline from pictures (stream_id, frame_no, t and what the model reads) by a user's detector (see detector.infer); frames without detections are frames too."""
        found = detector.infer(images, load, md, cfg, width, height).join(images.select("stream_id", "frame_no", "t"), ["stream_id", "frame_no"])
        frames = images.select("stream_id", "frame_no", "t").join(frames_of(found, ["reid", "pose_points"]).drop("t"), ["stream_id", "frame_no"], "left")
        return self.run(frames.withColumn("area", F.lit(None).cast("double")))

    def run_on_individual_images(self, images: DataFrame, load: Callable, md: ModelDescription, cfg: InferConfig, width: float, height: float) -> DataFrame:
        """The pipeline in single-frame mode: every picture on its own, with no limit of rate, no gate and no memory of others."""
        found = detector.infer(images, load, md, cfg, width, height).join(images.select("stream_id", "frame_no", "t"), ["stream_id", "frame_no"])
        frames = images.select("stream_id", "frame_no", "t").join(frames_of(found, ["reid", "pose_points"]).drop("t"), ["stream_id", "frame_no"], "left")
        out = track_streams(frames.withColumn("area", F.lit(None).cast("double")), 0.0, lambda: CascadeTracker(single=True))
        self._results.append(out)
        return out

    def run_on_video_file(self, spark: SparkSession, path: str, decode: Callable, load: Callable, md: ModelDescription, cfg: InferConfig, width: float, height: float, fps: float | None = None) -> DataFrame:
        """The pipeline over files (captures by the receiver, any other as Annex-B). decode: a user's decoder, units (path, au_no, ts90k, key, data) to pictures (path, frame_no, t and what the model reads). A file is a stream, numbered by its path."""
        units = media.read_media(spark, path)
        pictures = decode(units)
        names = pictures.select("path").distinct().withColumn("stream_id", F.xxhash64("path"))
        images = pictures.join(names, "path")
        if fps:
            images = images.withColumn("t", F.col("frame_no") / fps)
        return self.run_on_images(images, load, md, cfg, width, height)

    def set_frame_intervals(self, min_interval: float) -> None:
        self.min_dt = min_interval

    def set_name(self, name: str) -> None:
        self.name = name

    def run(self, frames: DataFrame) -> DataFrame:
        tracker = AssociationTracker if get(self.settings, "tracker", "cascade") == "association" else CascadeTracker
        out = track_streams(frames, self.min_dt, tracker)
        self._results.append(out)
        return out

    def get_results(self) -> list[DataFrame]:
        out, self._results = self._results, []
        return out

    def get_stats(self) -> list[DataFrame]:
        return [stats(r) for r in self._results]


def configure(now: InferConfig, changes: dict) -> InferConfig:
    """Settings with some changed; unknown names are an error."""
    return InferConfig.of(changes).over(now)
