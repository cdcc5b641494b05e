"""Fragmented MP4 files: written from access units as they come, and read back in byte ranges.

A file is a start (ftyp, moov), written once the parameter sets are known, and
fragments (moof, mdat). A fragment ends before each key unit; a unit's duration
is known when the next comes, the last one's is the mean of the others. The
same Step writes in batch (parts of a file, in order, to the sink for binary
files) and on streams, where its state is the units of the open fragment and
each part is a segment file of its own, committed with its micro-batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter

from sightline.operators.fold import Step, ordered_scan
from sightline.sources import media, ranged, sinks
from sightline.sources.labels import mp4_fragment, mp4_init

PARTS = "part long, kind string, decode_time long, n_samples int, data binary"


def length_prefixed(annexb: bytes) -> bytes:
    """The NAL units of an Annex-B unit, after their lengths."""
    return b"".join(struct.pack(">I", len(x)) + x for x in media.split_annexb(annexb))


@dataclass
class Mp4Writer(Step):
    """Units (ts64, data as Annex-B) in order to the parts of a file."""

    codec: str = media.H264
    sets: list = field(default_factory=lambda: [None, None, None])  # vps, sps, pps
    started: bool = False
    part: int = 0
    number: int = 1
    base: int = 0  # durations of all fragments written
    total: int = 0
    count: int = 0
    last_ts: int | None = None
    last_key: bool = False
    last: bytes = b""
    pending: list = field(default_factory=list)  # (data, duration, key)

    def push(self, row):
        data, key = length_prefixed(bytes(row["data"])), False
        for nal in media.split_lengths(data):
            kind = media.nal_class(self.codec, media.nal_type(self.codec, nal))
            key |= kind == "key"
            if kind in ("vps", "sps", "pps") and self.sets[i := ("vps", "sps", "pps").index(kind)] is None:
                self.sets[i] = nal
        yield from self._start()
        if self.last_ts is not None:
            step = max(1, row["ts64"] - self.last_ts)
            self.pending.append((self.last, min(step, 0xFFFFFFFF), self.last_key))
            self.total, self.count = self.total + step, self.count + 1
            if key:
                yield from self._flush()
        self.last_ts, self.last, self.last_key = row["ts64"], data, key

    def _start(self):
        needed = self.sets[1:] if self.codec == media.H264 else self.sets
        if not self.started and all(needed):
            self.started = True
            yield self._next("start", 0, 0, mp4_init(self.codec, needed))

    def _next(self, kind: str, at: int, n: int, data: bytes) -> dict:
        self.part += 1
        return {"part": self.part - 1, "kind": kind, "decode_time": at, "n_samples": n, "data": data}

    def _flush(self):
        if self.started and self.pending:
            yield self._next("fragment", self.base, len(self.pending), mp4_fragment(self.number, self.base, self.pending))
            self.base += sum(d for _, d, _ in self.pending)
            self.number, self.pending = self.number + 1, []

    def end(self):
        if self.last_ts is not None:
            self.pending.append((self.last, max(1, self.total // self.count) if self.count else 3003, self.last_key))
            yield from self._flush()


def parts(units: DataFrame, codec: str = media.H264, key: str = "stream_id") -> DataFrame:
    """The parts of each stream's file, from units (key, au_no, ts64, data)."""
    kind = units.schema[key].dataType.simpleString()
    return ordered_scan(units.select(key, "au_no", "ts64", "data"), [key], ["au_no"], lambda: Mp4Writer(codec), f"{key} {kind}, {PARTS}")


def write_mp4(units: DataFrame, folder: str, codec: str = media.H264, key: str = "stream_id") -> None:
    """One file a stream, <key>.mp4; a stream without parameter sets has none."""
    rows = parts(units, codec, key)
    sinks.write_files(rows.select(F.concat(F.col(key).cast("string"), F.lit(".mp4")).alias("name"), "part", "data"), folder, ["part"])


class SegmentsWriter(DataSourceStreamArrowWriter):
    """Rows (name, data) to a file each. A micro-batch's files get their names when it commits; one that is run again replaces them."""

    def __init__(self, folder: str):
        self.writer = sinks.FilesWriter(folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> sinks.Written:
        return self.writer.write(batches)

    def commit(self, messages, batchId: int) -> None:
        self.writer.commit(messages)

    def abort(self, messages, batchId: int) -> None:
        self.writer.abort(messages)


class Segments(DataSource):
    """Option: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "sightline_segments"

    def schema(self) -> str:
        return "name string, data binary"

    def streamWriter(self, schema, overwrite: bool) -> SegmentsWriter:
        return SegmentsWriter(self.options["path"])


def segments(stream: DataFrame, folder: str, checkpoint: str, key: str = "stream_id", trigger: dict | None = None):
    """The running query that writes a stream of parts (key, part, data) as segments <key>-<part>.m4s; those of a stream end to end are its file."""
    stream.sparkSession.dataSource.register(Segments)
    rows = stream.select(F.concat(F.col(key).cast("string"), F.lit("-"), F.lpad(F.col("part").cast("string"), 8, "0"), F.lit(".m4s")).alias("name"), "data")
    return rows.writeStream.format("sightline_segments").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Mp4(ranged.Chain):
    """Samples of fragmented files, by ranges of top-level boxes: a fragment belongs to the range in which its moof begins."""

    suffix, head = ".mp4", 8
    columns = "fragment_no long, sample_no int, decode_time long, duration long, key boolean, data binary"
    KINDS = (b"ftyp", b"styp", b"moov", b"moof", b"mdat", b"free", b"sidx", b"mfra")

    @classmethod
    def name(cls) -> str:
        return "sightline_mp4"

    def size(self, file, at):
        head = file.at(at, 8)
        n = int.from_bytes(head[:4], "big")
        return n if len(head) == 8 and head[4:] in self.KINDS and n >= 8 else 0

    def rows(self, file, part):
        for at, n in self.places(file, part):
            if file.at(at + 4, 4) == b"moof":
                yield from self._samples(file, at, n)

    def _inside(self, data: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            yield data[at + 4 : at + 8], data[at + 8 : at + n]
            at += max(8, n)

    def _samples(self, file, at, n):
        number, time, runs = 0, 0, []
        for kind, body in self._inside(file.at(at + 8, n - 8)):
            if kind == b"mfhd":
                number = int.from_bytes(body[4:8], "big")
            for inner, x in self._inside(body) if kind == b"traf" else ():
                if inner == b"tfdt":
                    time = int.from_bytes(x[4:12] if x[0] else x[4:8], "big")
                elif inner == b"trun":
                    runs.append(x)
        k = 0
        for x in runs:
            flags, count, offset = struct.unpack(">IIi", x[:12])
            place, width = at + offset, 4 * bin(flags >> 8 & 0xF).count("1")
            for i in range(count):
                fields = iter(struct.unpack(f">{width // 4}I", x[12 + i * width : 12 + (i + 1) * width]))
                duration, size, sync = (next(fields) if flags & bit else 0 for bit in (0x100, 0x200, 0x400))
                yield number, k, time, duration, not sync & 0x10000, file.at(place, size)
                place, k = place + size, k + 1


def read_mp4(spark: SparkSession, path: str, range_bytes: int = ranged.RANGE_BYTES, **options) -> DataFrame:
    """path, fragment_no, sample_no, decode_time (of the fragment), duration, key, data of each sample."""
    return ranged.loaded(spark, Mp4, path, range_bytes, **options).drop("range_no", "place")
