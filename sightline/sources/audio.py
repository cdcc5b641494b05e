"""WAV files, channel and rate conversion, log-mel features."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNKS = "path string, chunk_no long, sample_rate int, num_channels int, samples array<float>"


def read_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved samples. 8-bit is unsigned, 16 and 24-bit signed, 32-bit float; at most 8 channels."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, body = 12, None, b""
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + n]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", part[:16])
            head = channels, rate, bits
        elif name == b"data":
            body = part
        at += 8 + n + n % 2
    if head is None or not 1 <= head[0] <= 8:
        raise ValueError("no format, or too many channels")
    channels, rate, bits = head
    body = body[: len(body) // (channels * bits // 8) * (channels * bits // 8)]
    if bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(body, "<i2").astype(np.float32) / 32768
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 8388608
    elif bits == 32:
        x = np.frombuffer(body, "<f4")
    else:
        raise ValueError(f"{bits} bits")
    return rate, channels, x.astype(np.float32)


def write_wav(rate: int, channels: int, samples: np.ndarray) -> bytes:
    """16-bit PCM: clamped to +-1, times 32767, rounded to even."""
    body = np.rint(np.clip(np.asarray(samples, np.float32), -1, 1) * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body)) + body


def duration(rate: int, channels: int, n_samples: int) -> float:
    return n_samples / channels / rate


def read_wavs(spark: SparkSession, path: str, chunk_ms: int = 1000) -> DataFrame:
    return wav_chunks(spark.read.format("binaryFile").load(path), chunk_ms)


def wav_chunks(files: DataFrame, chunk_ms: int = 1000) -> DataFrame:
    """Chunks of WAV files (path, content); the last may be short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rate, channels, x = read_wav(data)
                step = max(1, rate * chunk_ms // 1000) * channels
                rows = [x[k : k + step] for k in range(0, len(x), step)]
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), pa.array([rate] * n, pa.int32()), pa.array([channels] * n, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], ["path", "chunk_no", "sample_rate", "num_channels", "samples"])

    return files.select("path", "content").mapInArrow(run, CHUNKS)


def wav_bytes(chunks: DataFrame) -> DataFrame:
    """stream_id and its WAV file (chunk_no, sample_rate, num_channels, samples). A file is written whole, so a stream's chunks meet in one task."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk_no").to_pylist()
        x = np.concatenate([np.array(r["samples"], np.float32) for r in rows])
        return pa.table({"stream_id": pa.array([key[0].as_py()], pa.int64()), "wav": pa.array([write_wav(rows[0]["sample_rate"], rows[0]["num_channels"], x)], pa.binary())})

    return chunks.groupBy("stream_id").applyInArrow(run, "stream_id long, wav binary")


def write_wavs(chunks: DataFrame, folder: str) -> None:
    """A file for each stream, <stream_id>.wav, of its chunks in order. The head needs the size of all, a pre-aggregated sum; samples are written as they come, so no task holds a stream."""
    from pyspark.sql import functions as F

    from sightline.sources import sinks

    name = F.concat(F.col("stream_id").cast("string"), F.lit(".wav"))

    def pcm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [write_wav(1, 1, np.array(x, np.float32))[44:] for x in batch.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("place"), pa.array(data, pa.binary())], ["name", "place", "data"])

    body = chunks.select(name.alias("name"), F.col("chunk_no").cast("long").alias("place"), "samples").mapInArrow(pcm, "name string, place long, data binary")
    sizes = chunks.groupBy("stream_id").agg(F.min_by("sample_rate", "chunk_no").alias("rate"), F.min_by("num_channels", "chunk_no").alias("channels"), F.sum(F.size("samples")).alias("n"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * r["n"], b"WAVE", b"fmt ", 16, 1, r["channels"], r["rate"], r["rate"] * r["channels"] * 2, r["channels"] * 2, 16, b"data", 2 * r["n"]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array([-1] * len(rows), pa.int64()), pa.array(made, pa.binary())], ["name", "place", "data"])

    head = sizes.select(name.alias("name"), "rate", "channels", "n").mapInArrow(heads, "name string, place long, data binary")
    sinks.write_files(head.unionByName(body), folder, ["place"])


def resample(x: np.ndarray, rate: int, to: int, taps: int = 32) -> np.ndarray:
    """Mono samples at another rate, by a Hann-windowed sinc."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    cut = min(1.0, to / rate)
    at = np.arange(len(x) * to // rate) * (rate / to)
    near = np.floor(at).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)
    d = at[:, None] - near
    weight = np.sinc(d * cut) * cut * np.cos(np.pi * d / (2 * taps)) ** 2
    inside = (near >= 0) & (near < len(x))
    return ((np.asarray(x, np.float64)[np.clip(near, 0, len(x) - 1)] * inside * weight).sum(1) / np.maximum((weight * inside).sum(1), 1e-9)).astype(np.float32)


@dataclass
class Resampler:
    """resample() for a stream in chunks: push() gives what is settled, end() the rest; together the same as for the whole stream."""

    rate: int
    to: int
    taps: int = 32
    seen: int = 0
    done: int = 0

    def __post_init__(self):
        self.held = np.zeros(0, np.float32)
        self.start = 0  # place of the first held sample

    def push(self, x: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, np.asarray(x, np.float32)])
        self.seen += len(x)
        return self._settled((self.seen - self.taps) * self.to // self.rate)

    def end(self) -> np.ndarray:
        return self._settled(self.seen * self.to // self.rate)

    def _settled(self, upto: int) -> np.ndarray:
        if upto <= self.done:
            return np.zeros(0, np.float32)
        if self.rate == self.to:
            out = self.held[self.done - self.start : upto - self.start]
        else:
            cut = min(1.0, self.to / self.rate)
            at = np.arange(self.done, upto) * (self.rate / self.to)
            near = np.floor(at).astype(int)[:, None] + np.arange(-self.taps + 1, self.taps + 1)
            d = at[:, None] - near
            weight = np.sinc(d * cut) * cut * np.cos(np.pi * d / (2 * self.taps)) ** 2
            inside = (near >= 0) & (near < self.seen)
            values = self.held.astype(np.float64)[np.clip(near - self.start, 0, len(self.held) - 1)]
            out = ((values * inside * weight).sum(1) / np.maximum((weight * inside).sum(1), 1e-9)).astype(np.float32)
        self.done = upto
        keep = max(self.start, int(self.done * self.rate // self.to) - self.taps - 1)
        self.held, self.start = self.held[keep - self.start :], keep
        return out


@dataclass
class ResampleStep:
    """A stream's chunks (chunk_no, sample_rate, samples; mono) at another rate, one output chunk for each and one at the end; a change of the source's rate starts anew."""

    to: int
    own: Resampler | None = None
    last: int = -1

    def push(self, row):
        if self.own is None or self.own.rate != row["sample_rate"]:
            self.own = Resampler(row["sample_rate"], self.to)
        self.last = row["chunk_no"]
        yield {"chunk_no": self.last, "sample_rate": self.to, "samples": self.own.push(np.array(row["samples"], np.float32)).tolist()}

    def end(self):
        if self.own is not None and len(rest := self.own.end()):
            yield {"chunk_no": self.last + 1, "sample_rate": self.to, "samples": rest.tolist()}


def resampled(chunks: DataFrame, to: int, key: str = "path") -> DataFrame:
    """key, chunk_no, sample_rate, samples of mono streams at another rate; state goes from chunk to chunk."""
    from sightline.operators.fold import ordered_scan

    kind = chunks.schema[key].dataType.simpleString()
    return ordered_scan(chunks.select(key, "chunk_no", "sample_rate", "samples"), [key], ["chunk_no"], lambda: ResampleStep(to), f"{key} {kind}, chunk_no long, sample_rate int, samples array<float>")


def hz_to_mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def mel_to_hz(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def mel_filterbank(n_mels: int, n_fft: int, rate: int, low: float = 0.0, high: float | None = None, norm: str = "slaney") -> np.ndarray:
    """n_mels triangles over the FFT's bins; of equal area, or of sum 1."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high or rate / 2), n_mels + 2))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    if norm == "slaney":
        return bank * (2 / (edges[2:] - edges[:-2]))[:, None]
    return bank / np.maximum(bank.sum(1, keepdims=True), 1e-12)


@dataclass
class LogMel:
    """Pre-emphasis, reflect padding, symmetric Hann window, FFT, mel bands, mul * log(x + eps) + add."""

    rate: int = 32_000
    n_fft: int = 1024
    window: int = 800
    hop: int = 320
    n_mels: int = 128
    emphasis: float = 0.97
    power: float = 2.0
    eps: float = 1e-5
    mul: float = 0.2
    add: float = 0.9
    norm: str = "sum"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        if self.emphasis:
            x = x[1:] - self.emphasis * x[:-1]
        half = self.n_fft // 2
        if len(x) <= half:
            x = np.pad(x, (0, half + 1 - len(x)))
        x = np.pad(x, half, mode="reflect")
        side = (self.n_fft - self.window) // 2
        w = np.pad(np.hanning(self.window), (side, self.n_fft - self.window - side))
        frames = np.lib.stride_tricks.sliding_window_view(x, self.n_fft)[:: self.hop] * w
        spectrum = np.abs(np.fft.rfft(frames)) ** self.power
        return self.mul * np.log(spectrum @ mel_filterbank(self.n_mels, self.n_fft, self.rate, norm=self.norm).T + self.eps) + self.add


def log_mel(chunks: DataFrame, features: LogMel) -> DataFrame:
    """chunks with mel: frames x bands, as arrays."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([*chunks.schema.fields, T.StructField("mel", T.ArrayType(T.ArrayType(T.DoubleType())))])
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mel = [features(np.array(x, np.float32)).tolist() for x in batch.column("samples").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mel, schema.field("mel").type)], schema=schema)

    return chunks.mapInArrow(run, kind)
