"""Media files read in byte ranges: a file of any size is many partitions.

Each format is a Python data source. A partition is a range of bytes; what
begins in a range belongs to it, wherever it ends, so ranges need nothing of
each other but a place to begin:

* Annex-B: the next start code; exact for any bytes.
* WAV: the index of chunks that the header gives; exact.
* PCAP and length-prefixed NAL units are chains without marks: the first place
  from which a chain of CHAIN well-formed records (or fewer, up to the end of
  the file) goes on. ranges() gives where each range came in and went out, so
  that linked() can tell whether all ranges are one chain.

Files are opened by pyarrow's file systems (local, S3, GCS, HDFS); what only
Spark's readers open is read whole by the readers of sources.media.

Numbers along a file (arrival_no, au_no) come from a count a range, added up
over the ranges before it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sightline.operators import series
from sightline.sources import audio, media

RANGE_BYTES = 64 << 20
#: Well-formed records in a row that a range of a chain begins with.
CHAIN = 16
BACK_BYTES = 1 << 20
#: Bytes read at a time, and rows of a batch.
READ_BYTES, BATCH = 1 << 20, 1024
#: Bytes of a file's head that stay in memory beside the piece that is read.
HEAD_BYTES = 4096
#: Tasks of a read whose ranges are small: beyond so many, neighbouring ranges share one, of RANGE_BYTES at most.
MOST_TASKS = 192


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder (all below it) or of a file."""
    fs, at = store(path)
    one = fs.get_file_info(at)
    if one.type == pafs.FileType.File:
        return [(path, one.size)]
    if one.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
    return sorted((path.rstrip("/") + f.path[len(at.rstrip("/")) :], f.size) for f in found)


class Bytes:
    """A file that is read at any place, a piece at a time."""

    def __init__(self, path: str):
        fs, at = store(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        self._start, self._held = 0, b""
        self._head: bytes | None = None

    def at(self, start: int, n: int) -> bytes:
        """n bytes from start on, fewer at the end of the file."""
        end = min(self.size, start + n)
        if end <= HEAD_BYTES and not (self._start <= start and end <= self._start + len(self._held)):
            if self._head is None:
                self._head = self.file.read_at(min(self.size, HEAD_BYTES), 0)
            return self._head[start:end]
        if start < self._start or end > self._start + len(self._held):
            self._load(start, n)
        return self._held[start - self._start : end - self._start]

    def _load(self, start: int, n: int) -> None:
        self._held = self.file.read_at(min(self.size - start, max(n, READ_BYTES)), start) if start < self.size else b""
        self._start = start

    def find(self, what: bytes, start: int, end: int) -> int:
        """Where `what` first begins from start to before end; -1 if nowhere."""
        end = min(end, self.size)
        while start < end:
            # a piece is looked through where it lies, and read once for all finds in it
            if start < self._start or start + len(what) > self._start + len(self._held):
                self._load(start, READ_BYTES)
            found = self._held.find(what, start - self._start, end - self._start + len(what) - 1)
            if found >= 0:
                return self._start + found
            held = self._start + len(self._held)
            if held >= self.size:
                return -1
            start = max(start + 1, held - len(what) + 1)
        return -1


class FileRange(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int, size: int):
        self.path, self.number, self.start, self.end, self.size = path, number, start, end, size


class FileRanges(InputPartition):
    """The ranges of a task, neighbours along their files."""

    def __init__(self, ranges: list[FileRange]):
        self.ranges = ranges


def packed(ranges: list[FileRange]) -> list[FileRanges]:
    """Ranges dealt to tasks in order: one each if they are few, else as many a task as keep tasks at about MOST_TASKS, up to RANGE_BYTES (a larger range is alone)."""
    most = 0 if len(ranges) <= MOST_TASKS else min(RANGE_BYTES, -(-sum(max(1, r.end - r.start) for r in ranges) // MOST_TASKS))
    out: list[FileRanges] = []
    held = 0
    for r in ranges:
        n = max(1, r.end - r.start)
        if not out or held + n > most:
            out.append(FileRanges([]))
            held = 0
        out[-1].ranges.append(r)
        held += n
    return out


class RangeReader(DataSourceReader):
    def __init__(self, source: RangedSource, schema: StructType):
        self.source, self.schema = source, to_arrow_schema(schema)

    def partitions(self) -> list[FileRanges]:
        each = int(self.source.options.get("rangebytes", RANGE_BYTES))
        return packed([FileRange(path, i, start, min(size, start + each), size) for path, size in listed(self.source.options["path"], self.source.suffix) for i, start in enumerate(range(0, max(size, 1), each))])

    def read(self, task: FileRanges) -> Iterator[pa.RecordBatch]:
        rows, now, file = [], None, None
        for part in task.ranges:
            if part.path != now:
                now, file = part.path, Bytes(part.path)
            for k, row in enumerate(self.source.rows(file, part)):
                rows.append((part.path, part.number, k, *row))
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class RangedSource(DataSource):
    """Options: path, rangeBytes. Rows have path, range_no, place (within the range) and the format's columns."""

    suffix, columns = "", ""

    def schema(self) -> str:
        return "path string, range_no int, place long, " + self.columns

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(self, schema)

    def rows(self, file: Bytes, part: FileRange) -> Iterator[tuple]:
        raise NotImplementedError


class AnnexB(RangedSource):
    suffix, columns = "", "offset long, nal binary"

    @classmethod
    def name(cls) -> str:
        return "sightline_annexb"

    def rows(self, file, part):
        start = file.find(b"\0\0\1", part.start, part.end)
        while start >= 0:
            after = file.find(b"\0\0\1", start + 3, file.size)
            nal = file.at(start + 3, (after if after >= 0 else file.size) - start - 3)
            nal = nal.rstrip(b"\0") if after >= 0 else nal
            if nal:
                yield start, nal
            start = after if after < part.end else -1


class Chain(RangedSource):
    """Records that lie end to end, each with its size at its head."""

    #: Bytes of a head, and before the first record.
    head, before = 0, 0

    def size(self, file: Bytes, at: int) -> int:
        """Bytes of the record at a place, its head included; 0 if no well-formed one begins there."""
        raise NotImplementedError

    def prepared(self, file: Bytes) -> bool:
        """Takes what the file's own head says; whether the file is of this format."""
        return True

    def _goes_on(self, file: Bytes, at: int) -> bool:
        for _ in range(CHAIN):
            if at >= file.size:
                # a last record that is cut is no end of a chain that just began
                return at == file.size
            n = self.size(file, at)
            if not n:
                return False
            at += n
        return True

    def entry(self, file: Bytes, part: FileRange) -> int:
        """Where the range's first record begins, at its end or later if none does."""
        # few records may be left where the range begins, but many after a place so far before it (option backBytes)
        start = part.start - int(self.options.get("backbytes", BACK_BYTES))
        at = self.before if start <= self.before else next((at for at in range(start, part.end) if self._goes_on(file, at)), part.end)
        while at < part.start:
            at += self.size(file, at) or file.size
        return at

    def places(self, file: Bytes, part: FileRange) -> Iterator[tuple[int, int]]:
        """Places and sizes of the range's whole records."""
        at = self.entry(file, part)
        while at < part.end and at + self.head <= file.size:
            n = self.size(file, at)
            if not n or at + n > file.size:
                return
            yield at, n
            at += n


class Pcap(Chain):
    suffix, columns = ".pcap", "offset long, capture_us long, protocol int, segment binary"
    head = 16
    before = 24

    @classmethod
    def name(cls) -> str:
        return "sightline_pcap"

    def prepared(self, file):
        magic = file.at(0, 24)
        if len(magic) < 24 or magic[:4] not in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
            return False
        self.order = "<" if magic[0] in (0xD4, 0x4D) else ">"
        self.nano = magic[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
        snap, self.link = struct.unpack(self.order + "II", magic[16:24])
        self.most = max(snap, 65_535) if snap else 1 << 18
        return True

    def size(self, file, at):
        head = file.at(at, 16)
        if len(head) < 16:
            return 0
        _, sub, n, whole = struct.unpack(self.order + "IIII", head)
        return 16 + n if sub < (1_000_000_000 if self.nano else 1_000_000) and 0 < n <= self.most and n <= whole <= self.most * 4 else 0

    def rows(self, file, part):
        if not self.prepared(file):
            return
        head = file.at(0, 24)
        for at, n in self.places(file, part):
            for us, protocol, segment in media.pcap_frames(head + file.at(at, n)):
                yield at, us, protocol, segment


class LengthPrefixed(Chain):
    suffix, columns = "", "offset long, nal binary"
    head = 4

    @classmethod
    def name(cls) -> str:
        return "sightline_length_prefixed"

    def size(self, file, at):
        head = file.at(at, 5)
        n = int.from_bytes(head[:4], "big")
        # a NAL unit is not empty, and its first bit is 0
        return 4 + n if len(head) == 5 and 0 < n <= 1 << 27 and head[4] < 0x80 and head[4] else 0

    def rows(self, file, part):
        for at, n in self.places(file, part):
            yield at, file.at(at + 4, n - 4)


class Wav(RangedSource):
    suffix, columns = ".wav", "chunk_no long, sample_rate int, num_channels int, samples array<float>"

    @classmethod
    def name(cls) -> str:
        return "sightline_wav"

    def rows(self, file, part):
        head, at, body = None, 12, None
        if file.at(0, 4) != b"RIFF" or file.at(8, 4) != b"WAVE":
            raise ValueError(f"{part.path} is not a WAV file")
        while at + 8 <= file.size and body is None:
            name, n = file.at(at, 4), int.from_bytes(file.at(at + 4, 4), "little")
            if name == b"fmt ":
                head = file.at(at + 8, 16)
            elif name == b"data":
                body = at + 8, min(file.size, at + 8 + n) if n != 0xFFFFFFFF else file.size
            at += 8 + n + n % 2
        if head is None or body is None:
            raise ValueError(f"{part.path} has no format or no samples")
        _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head)
        frame = channels * bits // 8
        step = max(1, rate * int(self.options.get("chunkms", 1000)) // 1000) * frame
        first, end = body[0], body[1] - (body[1] - body[0]) % frame
        prefix = struct.pack("<4sI4s4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16) + head + b"data"
        # chunks that begin in the range
        for k in range(max(0, -(-(part.start - first) // step)), max(0, -(-(min(part.end, end) - first) // step))):
            a = first + k * step
            data = file.at(a, min(step, end - a))
            _, _, samples = audio.read_wav(prefix + struct.pack("<I", len(data)) + data)
            yield k, rate, channels, samples.tolist()


def ranges(spark: SparkSession, source: type[Chain], path: str, range_bytes: int = RANGE_BYTES, back_bytes: int = BACK_BYTES) -> DataFrame:
    """path, range_no, entry and exit of each range of chains of records."""
    parts = spark.createDataFrame([(p, i, a, min(size, a + range_bytes), size) for p, size in listed(path, source.suffix) for i, a in enumerate(range(0, max(size, 1), range_bytes))], "path string, range_no int, start long, end long, size long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chain, file = source({"backbytes": back_bytes}), Bytes(r["path"])
                part = FileRange(r["path"], r["range_no"], r["start"], r["end"], r["size"])
                if chain.prepared(file):
                    # a range without a record lets the one before it pass through
                    here = [(at, at + n) for at, n in chain.places(file, part)]
                    yield pa.RecordBatch.from_pylist([{"path": r["path"], "range_no": r["range_no"], "entry": here[0][0] if here else None, "exit": here[-1][1] if here else None}], pa.schema([("path", pa.string()), ("range_no", pa.int32()), ("entry", pa.int64()), ("exit", pa.int64())]))

    return parts.repartition("path", "range_no").mapInArrow(run, "path string, range_no int, entry long, exit long")


def linked(found: DataFrame) -> DataFrame:
    """Of ranges(), those that don't come in where the range before them went out."""
    before = F.last("exit", ignorenulls=True).over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("expected", before).where("entry <> expected")


def loaded(spark: SparkSession, source: type[RangedSource], path: str, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("rangeBytes", range_bytes)
    for k, x in options.items():
        reader = reader.option(k, x)
    return reader.load(path)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their number along the file, from 1: by a count a range."""
    own = Window.partitionBy("path", "range_no").orderBy("place")
    within = rows.withColumn(name, F.row_number().over(own).cast("long"))
    counts = within.groupBy("path", "range_no").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return within.join(before, ["path", "range_no"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def placed(rows: DataFrame, name: str) -> DataFrame:
    """As numbered(), for all rows of a source: their place in the range is known, so only counts of ranges are shuffled."""
    counts = rows.groupBy("path", "range_no").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("path", "range_no", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, ["path", "range_no"]).withColumn(name, F.col("place") + 1 + F.col("_before")).drop("_before")


def pcap_packets(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """RTP packets of captures: path, arrival_no, capture_us, port, data."""
    rows = loaded(spark, Pcap, path, range_bytes, **options)
    byte = lambda k: F.conv(F.hex(F.substring("segment", k, 1)), 16, 10).cast("int")
    rtp = rows.where((F.col("protocol") == 17) & (F.length("segment") >= 20)).where(F.shiftright(byte(9), 6) == 2)
    return numbered(rtp, "arrival_no").select("path", "arrival_no", "capture_us", (byte(3) * 256 + byte(4)).alias("port"), F.expr("substring(segment, 9)").alias("data"))


def units(nals: DataFrame, codec: str = media.H264, fps: float = 30.0, every_slice: bool = False, width: int = series.WIDTH) -> DataFrame:
    """Access units of NAL units (path, offset, nal), in column expressions: a picture's first slice ends the unit before it, if that has a picture."""

    @F.pandas_udf("boolean")
    def starts(x):
        return x.map(lambda nal: nal is not None and media.first_slice(codec, bytes(nal)))

    first_byte = F.conv(F.hex(F.substring("nal", 1, 1)), 16, 10).cast("int")
    kind = media.nal_class_column(F.lit(codec), first_byte)
    # the slice header is in the first bytes
    rows = nals.withColumn("kind", kind).withColumn("_video", F.col("kind").isin("video", "key")).withColumn("_starts", F.col("_video") & (F.lit(True) if every_slice else starts(F.when(F.col("kind").isin("video", "key"), F.substring("nal", 1, 16)))))
    at_once = series.cut(nals, "path", width)
    videos = series.running_count(rows, "path", "offset", F.col("_video"), "_videos", at_once)
    new = F.col("_starts") & (F.col("_videos") > 1)
    placed = series.running_count(videos, "path", "offset", new, "au_no", at_once)
    parts = placed.groupBy("path", "au_no").agg(F.bool_or(F.col("kind") == "key").alias("key"), F.count(F.lit(1)).cast("int").alias("n_nals"), F.sort_array(F.collect_list(F.struct("offset", "nal"))).alias("_nals"))
    code = F.lit(b"\0\0\0\1")
    data = F.unhex(F.array_join(F.transform("_nals", lambda x: F.hex(F.concat(code, x["nal"]))), ""))
    return parts.select("path", "au_no", F.rint(F.lit(90_000 / (fps or 30.0)) * F.col("au_no")).cast("long").alias("ts90k"), "key", "n_nals", data.alias("data"))


def annexb_units(spark: SparkSession, path: str, codec: str = media.H264, fps: float = 30.0, range_bytes: int = RANGE_BYTES, every_slice: bool = False, width: int = series.WIDTH) -> DataFrame:
    return units(loaded(spark, AnnexB, path, range_bytes).drop("range_no", "place"), codec, fps, every_slice, width)


def length_prefixed_units(spark: SparkSession, path: str, codec: str = media.H264, fps: float = 30.0, range_bytes: int = RANGE_BYTES, width: int = series.WIDTH, **options) -> DataFrame:
    return units(loaded(spark, LengthPrefixed, path, range_bytes, **options).drop("range_no", "place"), codec, fps, width=width)


def wav_chunks(spark: SparkSession, path: str, chunk_ms: int = 1000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    return loaded(spark, Wav, path, range_bytes, chunkMs=chunk_ms).select("path", "chunk_no", "sample_rate", "num_channels", "samples")
