"""Detection labels, ground-truth tracks, prompt tables, raw images and MP4 fragments."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of track files, and how many of them a batch has before it goes on.
FRAME_SCHEMA = pa.schema([("path", pa.string()), ("frame_no", pa.int64()), ("t", pa.float64()), ("gt_id", pa.int64()), ("cl", pa.string()), *((c, pa.float64()) for c in ("conf", "x0", "y0", "x1", "y1"))])
MOST_OBJECTS = 4096
#: Most rows that a label file gives.
MOST_LABELS = 300


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Rows of text label files: class, centre and size, then five face points and seventeen pose points where a line has 20, 71 or 56 numbers. A line counts as far as its numbers go, and from five numbers on; a file gives its first MOST_LABELS rows."""
    number = lambda x: x.try_cast("double")
    words = lambda line: F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    # how many numbers come before what is none; a list of one binds it, so that a line is parsed once
    numbers = lambda p: (F.array_position(F.array_append(F.transform(p, lambda x: x.isNull()), F.lit(True)), True) - 1).cast("int")
    parsed = lambda line: F.transform(F.array(F.transform(words(line), number)), lambda p: F.slice(p, F.lit(1), numbers(p)))[0]
    # rows of a file are numbered and capped within it: a file is one row here, so that needs no shuffle
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.transform(F.split("value", "\n"), lambda line, i: F.struct(i.alias("line_no"), parsed(line).alias("v"))).alias("lines"))
    capped = F.slice(F.filter("lines", lambda x: F.size(x["v"]) >= 5), 1, MOST_LABELS)
    rows = files.select("path", F.explode(capped).alias("l")).select("path", "l.*")
    v = lambda i: F.col("v")[i]
    group = lambda at, k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.col("v")[at + i * 3].alias("x"), F.col("v")[at + i * 3 + 1].alias("y"), F.col("v")[at + i * 3 + 2].alias("conf")))
    size = F.size("v")
    return rows.select(
        "path", "line_no", v(0).cast("int").alias("cl"), F.lit(1.0).alias("conf"),
        (v(1) - v(3) / 2).alias("x0"), (v(2) - v(4) / 2).alias("y0"), (v(1) + v(3) / 2).alias("x1"), (v(2) + v(4) / 2).alias("y1"),
        F.when(size.isin(20, 71), group(5, 5)).alias("face_points"), F.when(size == 56, group(5, 17)).when(size == 71, group(20, 17)).alias("pose_points"),
    )


def read_trackset(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Long rows of ground-truth track files (JSON: metadata, frames with a time and objects by id). With range_bytes, in ranges, a frame at a time, for files whose frames begin with their time; their path comes first."""
    if range_bytes:
        from sightline.sources import ranged
        from sightline.sources.json_tracks import JsonTracks, parsed

        return _frames(ranged.loaded(spark, JsonTracks, path, range_bytes), parsed)
    schema = "metadata struct<classes: array<string>, frame_rate: double, width: int, height: int, original_video: string>, frames array<struct<frame_time: double, objects: map<string, struct<box: array<double>, class: string, conf: double>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    frames = raw.select("metadata", F.posexplode("frames").alias("frame_no", "f"))
    each = frames.select("metadata.frame_rate", F.col("frame_no").cast("long").alias("frame_no"), F.col("f.frame_time").alias("t"), F.explode("f.objects").alias("id", "o"))
    box = [F.col("o.box")[i].alias(s) for i, s in enumerate(("x0", "y0", "x1", "y1"))]
    return each.select("frame_no", "t", F.col("id").cast("long").alias("gt_id"), F.col("o.class").alias("cl"), F.coalesce("o.conf", F.lit(1.0)).alias("conf"), *box)


def read_yaml_trackset(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """The same rows from track files in block-style YAML, and their path: read in byte ranges, a frame at a time, so that a stream's file is no row. Frames are numbered along the file."""
    from sightline.sources import ranged
    from sightline.sources.yaml_tracks import YamlTracks, parsed

    return _frames(ranged.loaded(spark, YamlTracks, path, range_bytes or ranged.RANGE_BYTES), parsed)


def _frames(texts: DataFrame, parsed: Callable[[bytes], tuple[float, list[dict]]]) -> DataFrame:
    """Long rows of the frames (path, range_no, place, frame as text) of track files. Frames are counted before they are parsed, so that each is parsed once."""
    from sightline.sources import ranged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, n, text in zip(*(batch.column(c).to_pylist() for c in ("path", "_n", "frame")), strict=True):
                t, objects = parsed(text)
                rows += [{"path": path, "frame_no": n - 1, "t": t, **o} for o in objects]
                if len(rows) >= MOST_OBJECTS:
                    yield pa.RecordBatch.from_pylist(rows, FRAME_SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, FRAME_SCHEMA)

    return ranged.placed(texts, "_n").select("path", "_n", "frame").mapInArrow(run, "path string, frame_no long, t double, gt_id long, cl string, conf double, x0 double, y0 double, x1 double, y1 double")


def read_prompts(spark: SparkSession, path: str, dim: int = 1024) -> DataFrame:
    return prompt_rows(spark.read.format("binaryFile").load(path), dim)


def prompt_rows(files: DataFrame, dim: int = 1024) -> DataFrame:
    """prompt_id, text and unit vector of fixed records: 128 bytes of text, then float32 numbers."""
    record = 128 + 4 * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                n = len(data) // record
                rows = [data[k * record : (k + 1) * record] for k in range(n)]
                x = np.array([np.frombuffer(r[128:], "<f4") for r in rows], np.float64).reshape(n, dim)
                x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([r[:128].split(b"\0")[0].decode("utf-8", "replace") for r in rows]), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], ["prompt_id", "text", "embedding"])

    return files.select("content").mapInArrow(run, "prompt_id long, text string, embedding array<float>")


RAW = struct.Struct("<III")
MARK = 0xBEEF1234


def raw_image(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> bytes:
    """A planar image dump: mark, width, height, planes."""
    return RAW.pack(MARK, y.shape[1], y.shape[0]) + y.tobytes() + u.tobytes() + v.tobytes()


def parse_raw_image(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mark, w, h = RAW.unpack_from(data)
    if mark != MARK:
        raise ValueError("not an image dump")
    x = np.frombuffer(data, np.uint8, offset=RAW.size)
    n, c = w * h, (w // 2) * (h // 2)
    return x[:n].reshape(h, w), x[n : n + c].reshape(h // 2, w // 2), x[n + c : n + 2 * c].reshape(h // 2, w // 2)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4_fragment(number: int, decode_time: int, samples: list[tuple[bytes, int, bool]]) -> bytes:
    """A movie fragment of (data, duration, key) samples: moof and mdat."""

    def moof(offset: int) -> bytes:
        run = struct.pack(">IIi", 0x000701, len(samples), offset) + b"".join(struct.pack(">III", d, len(x), 0x02000000 if key else 0x00010000) for x, d, key in samples)
        track = _box(b"tfhd", struct.pack(">II", 0x020000, 1)) + _box(b"tfdt", struct.pack(">IQ", 0x01000000, decode_time)) + _box(b"trun", run)
        return _box(b"moof", _box(b"mfhd", struct.pack(">II", 0, number)), _box(b"traf", track))

    return moof(len(moof(0)) + 8) + _box(b"mdat", *(x for x, _, _ in samples))


def mp4_fragments(units: DataFrame) -> DataFrame:
    """stream_id, fragment_no, decode_time, data: fragments that start at key units (stream_id, au_no, duration, key, data), from the first key on. Only a fragment's units meet."""
    from pyspark.sql import Window

    own = Window.partitionBy("stream_id").orderBy("au_no")
    timed = units.withColumn("fragment_no", F.sum(F.col("key").cast("long")).over(own)).withColumn("at", F.sum("duration").over(own) - F.col("duration")).where("fragment_no > 0")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("au_no").to_pylist()
        data = mp4_fragment(key[1].as_py(), rows[0]["at"], [(r["data"], r["duration"], r["key"]) for r in rows])
        return pa.table({"stream_id": [key[0].as_py()], "fragment_no": [key[1].as_py()], "decode_time": [rows[0]["at"]], "data": pa.array([data], pa.binary())})

    return timed.groupBy("stream_id", "fragment_no").applyInArrow(run, "stream_id long, fragment_no long, decode_time long, data binary")




def mp4_init(codec: str, sets: list[bytes], timescale: int = 90_000) -> bytes:
    """The start of a fragmented file: ftyp and moov with one video track, sized by its parameter sets (vps, sps, pps in order)."""
    from sightline.sources.media import H264, sps_size

    sps = sets[0] if codec == H264 else sets[1]
    w, h = sps_size(codec, sps)
    number = lambda x: struct.pack(">H", len(x)) + x
    if codec == H264:
        name, settings = b"avc1", _box(b"avcC", b"\1" + sps[1:4] + b"\xff\xe1" + number(sps) + b"\1" + number(sets[1]))
    else:
        arrays = b"".join(bytes([0x80 | kind]) + b"\0\1" + number(x) for kind, x in zip((32, 33, 34), sets, strict=True))
        name, settings = b"hvc1", _box(b"hvcC", b"\1" + sps[3:15].ljust(12, b"\0") + b"\xf0\0\xfc\xfd\xf8\xf8\0\0\x0f\3" + arrays)
    unit = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(name, bytes(6), b"\0\1", bytes(16), struct.pack(">HHIIIH", w, h, 0x480000, 0x480000, 0, 1), bytes(32), b"\0\x18\xff\xff", settings)
    empty = lambda kind, n=8: _box(kind, bytes(n))
    table = _box(b"stbl", _box(b"stsd", struct.pack(">II", 0, 1), entry), empty(b"stts"), empty(b"stsc"), empty(b"stsz", 12), empty(b"stco"))
    media = _box(b"minf", _box(b"vmhd", struct.pack(">I", 1), bytes(8)), _box(b"dinf", _box(b"dref", struct.pack(">II", 0, 1), _box(b"url ", struct.pack(">I", 1)))), table)
    mdia = _box(b"mdia", _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, timescale, 0, 0x55C4, 0)), _box(b"hdlr", bytes(8), b"vide", bytes(12), b"video\0"), media)
    track = _box(b"trak", _box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, 0), bytes(16), unit, struct.pack(">II", w << 16, h << 16)), mdia)
    head = _box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, timescale, 0), struct.pack(">IH", 0x10000, 0x100), bytes(10), unit, bytes(24), struct.pack(">I", 2))
    extends = _box(b"mvex", _box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 0, 0, 0)))
    return _box(b"ftyp", b"iso5", struct.pack(">I", 512), b"iso5iso6mp41") + _box(b"moov", head, track, extends)
