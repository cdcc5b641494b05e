"""From a detector's raw output to detections, and the place where a user's model plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.config import InferConfig, ModelDescription
from sightline.operators import matching

POINTS = "array<struct<x: double, y: double, conf: double>>"
#: Detections that leave decoded() at a time.
MOST_ROWS = 512
DECODED = f"stream_id long, frame_no long, det_id long, cl int, conf double, x0 double, y0 double, x1 double, y1 double, subbox struct<x0: double, y0: double, x1: double, y1: double, conf: double>, face_points {POINTS}, pose_points {POINTS}, attrs array<double>, reid array<double>"


def decode(tensor: np.ndarray, md: ModelDescription, det_thr: float, width: float, height: float) -> list[dict]:
    """Detections of an attribute-major tensor: box (centre, size, pixels), class scores, attributes, key points, appearance vector.

    A column gives a detection for each class whose score is over the threshold.
    Faces get face points; persons get pose points, attributes and appearance.
    """
    n_cl, n_at = len(md.classes), len(md.attributes)
    person, face = md.index("person"), md.index("face")
    points_at, out = 4 + n_cl + n_at, []
    for cl, i in np.argwhere(tensor[4 : 4 + n_cl] > det_thr).tolist():
        t = tensor[:, i].astype(float)
        cx, cy, w, h = t[0] / width, t[1] / height, t[2] / width, t[3] / height
        row = {"det_id": i, "cl": cl, "conf": float(t[4 + cl]), "x0": cx - w / 2, "y0": cy - h / 2, "x1": cx + w / 2, "y1": cy + h / 2}
        at = points_at + 3 * md.key_points
        points = [{"x": x / width, "y": y / height, "conf": c} for x, y, c in t[points_at:at].reshape(-1, 3).tolist()]
        if cl == face and md.key_points == 22:
            row["face_points"] = points[:5]
        if cl == person:
            row["attrs"] = t[4 + n_cl : points_at].tolist() or None
            row["reid"] = t[at : at + md.reid].tolist() if md.reid else None
            if md.key_points >= 17:
                row["pose_points"] = points[-17:] if md.key_points == 22 else points[:17]
            if md.key_points == 19:
                # eyes, nose and mouth corners stand among the pose's points and after them
                row["face_points"] = [points[k] for k in (2, 1, 0, 18, 17)]
                row["subbox"] = _grown(row["face_points"])
        out.append(row)
    return out


def _grown(points: list[dict]) -> dict:
    """A box around points that is widened again after each of them; its confidence is their sum."""
    x0 = x1 = points[0]["x"]
    y0 = y1 = points[0]["y"]
    for p in points[1:]:
        x0, x1, y0, y1 = min(x0, p["x"]), max(x1, p["x"]), min(y0, p["y"]), max(y1, p["y"])
        w, h = x1 - x0, y1 - y0
        x0, x1, y0, y1 = x0 - 0.15 * w, x1 + 0.15 * w, y0 - 0.2 * h, y1 + 0.2 * h
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "conf": sum(p["conf"] for p in points)}


def decoded(tensors: DataFrame, md: ModelDescription, det_thr: float, width: float, height: float) -> DataFrame:
    """Detections (DECODED) of stored model output: stream_id, frame_no, tensor (rows of an attribute-major tensor)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(DECODED)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # tensors are arrays, one frame at a time, and rows leave in small batches
            rows = []
            for s, f, tensor in zip(batch.column("stream_id").to_pylist(), batch.column("frame_no").to_pylist(), batch.column("tensor"), strict=True):
                array = np.stack([row.values.to_numpy(zero_copy_only=False) for row in tensor]).astype(np.float64) if tensor.is_valid and len(tensor) else np.array(tensor.as_py(), np.float64)
                rows += [{"stream_id": s, "frame_no": f, **d} for d in decode(array, md, det_thr, width, height)]
                if len(rows) >= MOST_ROWS:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)

    return tensors.select("stream_id", "frame_no", "tensor").mapInArrow(run, kind)


def batch_size(sizes: list[tuple[int, int]], cfg: InferConfig, step: int = 32) -> tuple[int, int]:
    """The common padded width and height of a batch: multiples of a step, within the limits."""
    up = lambda v, lo, hi: min(max(-(-v // step) * step, lo or step), hi or 1 << 30)
    return up(max(w for w, _ in sizes), cfg.limit_min_width, cfg.limit_max_width), up(max(h for _, h in sizes), cfg.limit_min_height, cfg.limit_max_height)


def batches(frames: DataFrame, cfg: InferConfig, model_batch: int = 16, step: int = 32) -> DataFrame:
    """frames (stream_id, frame_no, width, height) with their batch of a stream's consecutive frames: batch_no, batch_frames and the common padded size (as batch_size)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    most = min(model_batch, cfg.limit_max_batch or model_batch)
    numbered = frames.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_no")) - 1) / most))
    up = lambda c, lo, hi: F.least(F.greatest(F.ceil(c / step) * step, F.lit(lo or step)), F.lit(hi or 1 << 30)).cast("int")
    each = numbered.groupBy("stream_id", "batch_no").agg(
        F.count(F.lit(1)).alias("batch_frames"),
        up(F.max("width"), cfg.limit_min_width, cfg.limit_max_width).alias("batch_width"),
        up(F.max("height"), cfg.limit_min_height, cfg.limit_max_height).alias("batch_height"),
    )
    return numbered.join(each, ["stream_id", "batch_no"])


def batch_stats(batched: DataFrame) -> DataFrame:
    """Batches and frames of each batch size, and the mean area of their frames' regions (of rows that batches() gave, with area)."""
    from pyspark.sql import functions as F

    each = batched.groupBy("stream_id", "batch_no").agg(F.first("batch_frames").alias("batch_size"), F.sum("area").alias("area"))
    out = each.groupBy("batch_size").agg(F.count(F.lit(1)).alias("batches"), F.sum("batch_size").alias("frames"), F.sum("area").alias("area"))
    return out.select("batch_size", "batches", "frames", (F.col("area") / F.col("frames")).alias("mean_area"))


def infer(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list[np.ndarray]]], md: ModelDescription, cfg: InferConfig, width: float, height: float) -> DataFrame:
    """Detections of frames by a user's model.

    load() runs once a worker and returns a function from a batch of frame rows
    to one tensor a row; the size of batches is
    spark.sql.execution.arrow.maxRecordsPerBatch. Suppression and fusion follow
    in the plan. No model comes with the library.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(DECODED)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            rows = []
            for s, f, tensor in zip(batch.column("stream_id").to_pylist(), batch.column("frame_no").to_pylist(), model(batch.to_pandas()), strict=True):
                rows += [{"stream_id": s, "frame_no": f, **d} for d in decode(tensor, md, cfg.det_thr or 0.0, width, height)]
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)

    found = frames.mapInArrow(run, kind)
    narrow = matching.suppress(found.select("stream_id", "frame_no", "det_id", "cl", "conf", "x0", "y0", "x1", "y1"), cfg.nms_thr or 0.45, cfg.max_detections)
    kept = found.join(narrow.select("stream_id", "frame_no", "cl", "det_id"), ["stream_id", "frame_no", "cl", "det_id"], "left_semi")
    person, face = md.index("person"), md.index("face")
    return matching.fuse(kept, person=person, face=face) if cfg.fuse_face_person and person is not None and face is not None else kept


def embed(crops: DataFrame, load: Callable[[], Callable[[pd.DataFrame], np.ndarray]], dim: int, normalize: bool = True) -> DataFrame:
    """crops with an embedding by a user's model (as infer): load() once a worker; a batch of rows to a row of numbers each."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([*crops.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            x = np.asarray(model(batch.to_pandas()), np.float32).reshape(batch.num_rows, dim)
            if normalize:
                n = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.where(n > 0, x / np.where(n > 0, n, 1), x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float32()))], schema=schema)

    return crops.mapInArrow(run, kind)
