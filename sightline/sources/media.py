"""Video byte streams: file names, NAL units, RTP, SDP, PCAP, access units, parameter sets.

Parsers are plain functions over bytes; the readers run them on binaryFile rows
by mapInArrow, so files of any store Spark reads are parsed where they are read.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

H264, H265 = "h264", "h265"


def name_codec(name: Column) -> Column:
    return F.when(name.rlike("[.](264|h264)$"), H264).when(name.rlike("[.](265|h265|hevc)$"), H265).when(name.rlike("[.]pcap$"), "pcap")


def name_fps(name: Column) -> Column:
    """The number before fps after an underscore; 0 if there is none."""
    return F.coalesce(F.regexp_extract(name, "_([0-9.]+)fps", 1).try_cast("double"), F.lit(0.0))


def nal_type(codec: str, nal: bytes) -> int:
    return nal[0] & 31 if codec == H264 else nal[0] >> 1 & 63


def nal_class(codec: str, kind: int) -> str:
    """key, video, sps, pps, vps, sei, or other."""
    if codec == H264:
        return {5: "key", 7: "sps", 8: "pps", 6: "sei"}.get(kind, "video" if 1 <= kind <= 4 else "other")
    return {32: "vps", 33: "sps", 34: "pps", 39: "sei", 40: "sei"}.get(kind, "key" if 16 <= kind <= 21 else "video" if kind <= 9 else "other")


def nal_class_column(codec: Column, first_byte: Column) -> Column:
    """The same as a column, from the first byte of a NAL unit."""
    a, b = first_byte.bitwiseAND(31), F.shiftright(first_byte, 1).bitwiseAND(63)
    avc = F.when(a == 5, "key").when(a == 7, "sps").when(a == 8, "pps").when(a == 6, "sei").when(a.between(1, 4), "video").otherwise("other")
    hevc = F.when(b == 32, "vps").when(b == 33, "sps").when(b == 34, "pps").when(b.isin(39, 40), "sei").when(b.between(16, 21), "key").when(b <= 9, "video").otherwise("other")
    return F.when(codec == H264, avc).otherwise(hevc)


def without_emulation(data: bytes) -> bytes:
    return re.sub(rb"\x00\x00\x03(?=[\x00-\x03]|$)", b"\x00\x00", data, flags=re.S)


class Bits:
    """A bit reader with Exp-Golomb codes."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def read(self, n: int) -> int:
        if n > self.left:
            raise EOFError("out of bits")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def ue(self) -> int:
        zeros = 0
        while not self.read(1):
            zeros += 1
        return (1 << zeros) - 1 + self.read(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


def first_slice(codec: str, nal: bytes) -> bool:
    """Whether a video NAL unit starts a picture."""
    if codec == H265:
        return len(nal) > 2 and bool(nal[2] & 0x80)
    return Bits(without_emulation(nal[1:16]) or b"\0").ue() == 0 if len(nal) > 1 else False


def split_annexb(data: bytes) -> list[bytes]:
    """NAL units between 3- or 4-byte start codes."""
    cuts = [(m.start(), m.end()) for m in re.finditer(rb"\x00\x00\x01", data)]
    out = []
    for i, (_, a) in enumerate(cuts):
        b = cuts[i + 1][0] if i + 1 < len(cuts) else len(data)
        out.append(data[a:b].rstrip(b"\0") if i + 1 < len(cuts) else data[a:b])
    return [x for x in out if x]


def split_lengths(data: bytes) -> list[bytes]:
    """NAL units after 4-byte big-endian lengths; a cut last one is dropped."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def units_of(codec: str, nals: list[bytes], fps: float = 30.0, every_slice: bool = False) -> list[dict]:
    """Access units on a synthetic 90 kHz clock: a picture's first slice (or every slice) ends the unit before it; the last unit is flushed."""
    out, now, has_video = [], [], False
    for nal in nals:
        video = nal_class(codec, nal_type(codec, nal)) in ("video", "key")
        if video and has_video and (every_slice or first_slice(codec, nal)):
            out.append(now)
            now, has_video = [], False
        now.append(nal)
        has_video |= video
    if now:
        out.append(now)
    return [{"au_no": i, "ts90k": round(90_000 / (fps or 30.0) * i), "key": any(nal_class(codec, nal_type(codec, x)) == "key" for x in u), "n_nals": len(u), "data": b"".join(b"\0\0\0\1" + x for x in u)} for i, u in enumerate(out)]


def sps_size(codec: str, sps: bytes) -> tuple[int, int]:
    """Width and height from a sequence parameter set."""
    b = Bits(without_emulation(sps[1 if codec == H264 else 2 :]))
    if codec == H265:
        b.read(4)
        layers = b.read(3)
        b.read(1)
        b.read(88)
        b.read(8)
        flags = [(b.read(1), b.read(1)) for _ in range(layers)]
        if layers:
            b.read(2 * (8 - layers))
        for profile, level in flags:
            b.read(88 * profile)
            b.read(8 * level)
        b.ue()
        chroma = b.ue()
        if chroma == 3:
            b.read(1)
        w, h = b.ue(), b.ue()
        if b.read(1):
            l, r, t, o = b.ue(), b.ue(), b.ue(), b.ue()
            sx, sy = {1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1))
            w, h = w - sx * (l + r), h - sy * (t + o)
        return w, h
    profile = b.read(8)
    b.read(16)
    b.ue()
    chroma = 1
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
        chroma = b.ue()
        if chroma == 3:
            b.read(1)
        b.ue(), b.ue(), b.read(1)
        if b.read(1):
            for i in range(8 if chroma != 3 else 12):
                if b.read(1):
                    last = nxt = 8
                    for _ in range(16 if i < 6 else 64):
                        if nxt:
                            nxt = (last + b.se() + 256) % 256
                        last = nxt or last
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.read(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    b.ue(), b.read(1)
    w, h = (b.ue() + 1) * 16, b.ue() + 1
    frames = b.read(1)
    h *= 16 * (2 - frames)
    if not frames:
        b.read(1)
    b.read(1)
    if b.read(1):
        l, r, t, o = b.ue(), b.ue(), b.ue(), b.ue()
        sx, sy = {0: (1, 1), 1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1))
        w, h = w - sx * (l + r), h - sy * (2 - frames) * (t + o)
    return w, h


def rtp_header(data: bytes) -> dict | None:
    """seq16, ts32, ssrc, payload type, marker and payload of a packet; None if it is no whole RTP packet."""
    if len(data) < 12 or data[0] >> 6 != 2:
        return None
    seq, ts, ssrc = struct.unpack(">HII", data[2:12])
    n = 12 + 4 * (data[0] & 15)
    if data[0] & 16:
        if len(data) < n + 4:
            return None
        n += 4 + 4 * int.from_bytes(data[n + 2 : n + 4], "big")
    if n > len(data):
        return None
    return {"seq16": seq, "ts32": ts, "ssrc": ssrc, "pt": data[1] & 127, "marker": bool(data[1] & 128), "payload": data[n:]}


def depacketized(codec: str, payloads: list[bytes]) -> tuple[list[bytes], int]:
    """NAL units of one access unit's payloads, in order, and errors: single units, aggregates and fragments."""
    out, errors, part = [], 0, None
    for p in payloads:
        if not p:
            errors += 1
            continue
        kind, head = nal_type(codec, p), 1 if codec == H264 else 2
        if kind == (24 if codec == H264 else 48):
            at = head
            while at + 2 <= len(p):
                n = int.from_bytes(p[at : at + 2], "big")
                if not n or at + 2 + n > len(p):
                    errors += 1
                    break
                out.append(p[at + 2 : at + 2 + n])
                at += 2 + n
        elif kind == (28 if codec == H264 else 49):
            if len(p) <= head + 1:
                errors += 1
                continue
            f = p[head]
            if f & 0x80:
                first = bytes([p[0] & 0xE0 | f & 31]) if codec == H264 else bytes([p[0] & 0x81 | (f & 63) << 1, p[1]])
                errors += part is not None
                part = first + p[head + 1 :]
            elif part is None:
                errors += 1
                continue
            else:
                part += p[head + 1 :]
            if f & 0x40:
                out.append(part)
                part = None
        else:
            out.append(p)
    return out, errors + (part is not None)


def parse_sdp(text: str) -> list[dict]:
    """The media of a session description: kind, port, payload types, codec, clock, parameter sets, keys."""
    media: list[dict] = []
    for line in text.replace("\r", "").split("\n"):
        if m := re.match(r"m=(\w+) (\d+) (\S+) (.+)", line):
            media.append({"kind": m[1], "port": int(m[2]), "protocol": m[3], "pts": [int(x) for x in m[4].split() if x.isdigit()], "codec": None, "clock": None, "channels": None, "crypto": [], "sets": []})
        elif media:
            now = media[-1]
            if m := re.match(r"a=rtpmap:(\d+) ([^/]+)/(\d+)(?:/(\d+))?", line):
                now |= {"pt": int(m[1]), "codec": m[2], "clock": int(m[3]), "channels": int(m[4] or 1)}
            elif m := re.match(r"a=crypto:(\d+) (\S+) inline:(\S+)", line):
                now["crypto"].append({"tag": int(m[1]), "suite": m[2], "key": m[3]})
            elif line.startswith("a=fmtp:"):
                for _, value in re.findall(r"(sprop-parameter-sets|sprop-vps|sprop-sps|sprop-pps)=([^;\s]+)", line):
                    now["sets"] += [base64.b64decode(x + "=" * (-len(x) % 4)) for x in value.split(",") if x]
    return media


def receiver_config(media: list[dict]) -> dict | None:
    """Payload type and clock to receive: audio before video."""
    for kind in ("audio", "video"):
        for x in media:
            if x["kind"] == kind and x["codec"]:
                return {"kind": kind, "pt": x.get("pt", (x["pts"] or [None])[0]), "clock": x["clock"], "codec": x["codec"]}
    return None


def pcap_frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Time in microseconds, IP protocol and transport segment of each captured IPv4 packet (Ethernet, Linux cooked or raw)."""
    if len(data) < 24 or data[:4] not in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        return
    order = "<" if data[0] in (0xD4, 0x4D) else ">"
    nano = data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    link = struct.unpack(order + "I", data[20:24])[0]
    skip, at = {1: 14, 113: 16}.get(link, 0), 24
    while at + 16 <= len(data):
        sec, sub, n, _ = struct.unpack(order + "IIII", data[at : at + 16])
        p = data[at + 16 : at + 16 + n]
        at += 16 + n
        ip = p[skip:]
        if skip and int.from_bytes(p[skip - 2 : skip], "big") != 0x800 or len(ip) < 20 or ip[0] >> 4 != 4:
            continue
        yield sec * 1_000_000 + (sub // 1000 if nano else sub), ip[9], ip[(ip[0] & 15) * 4 : int.from_bytes(ip[2:4], "big")]


def pcap_rtp(data: bytes) -> list[dict]:
    out = []
    for us, protocol, seg in pcap_frames(data):
        if protocol == 17 and len(seg) >= 8 + 12 and seg[8] >> 6 == 2:
            out.append({"arrival_no": len(out) + 1, "capture_us": us, "port": int.from_bytes(seg[2:4], "big"), "data": seg[8:]})
    return out


def pcap_sdp(data: bytes) -> str | None:
    """The first session description answered on port 554."""
    for _, protocol, seg in pcap_frames(data):
        if protocol == 6 and len(seg) >= 20 and 554 in struct.unpack(">HH", seg[:4]):
            body = seg[(seg[12] >> 4) * 4 :]
            if b"Content-Type: application/sdp" in body and (at := body.find(b"v=0\r\n")) >= 0:
                return body[at:].split(b"\r\n\r\n")[0].decode("utf-8", "replace")
    return None


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files of any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, columns: str, parse) -> DataFrame:
    """The rows that parse(path, content) gives for each file, with its path."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("path string, " + columns)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [{"path": name, **r} for r in parse(name, content)]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 1000], schema)

    return files.select("path", "content").mapInArrow(run, kind)


def _codec_of(path: str) -> str:
    return H265 if re.search(r"[.](265|h265|hevc)$", path) else H264


UNITS = "au_no long, ts90k long, key boolean, n_nals int, data binary"


def annexb_units(files: DataFrame, every_slice: bool = False) -> DataFrame:
    """Access units of Annex-B content; codec and rate from the names. every_slice: each video NAL unit starts one."""

    def parse(name: str, data: bytes):
        m = re.search(r"_([0-9.]+)fps", name)
        return units_of(_codec_of(name), split_annexb(data), float(m[1]) if m else 30.0, every_slice)

    return _parsed(files, UNITS, parse)


def read_annexb(spark: SparkSession, path: str) -> DataFrame:
    return annexb_units(files_at(spark, path))


def chunked_units(chunks: DataFrame, codec: str = H264, fps: float = 30.0) -> DataFrame:
    """Access units of Annex-B streams that come in chunks (path, chunk_no, data): start codes and units may cross chunks, and no more than a unit is held."""
    from sightline.operators.fold import ordered_scan
    from sightline.operators.steps import UnitChunker

    return ordered_scan(chunks.select("path", "chunk_no", "data"), ["path"], ["chunk_no"], lambda: UnitChunker(codec, fps), "path string, " + UNITS)


def captured_units(files: DataFrame, codec: str = H264) -> DataFrame:
    """Access units of captures, file by file."""
    return received_units(pcap_packets(files), "path", codec)


def received_units(packets: DataFrame, key: str = "stream_id", codec: str = H264, pt: int | None = None) -> DataFrame:
    """Access units of RTP packets (key, arrival_no, data) through the receiver: source switch, reordering, depacketizing, assembly. pt: the one payload type that is received (None: all)."""
    from sightline.operators.fold import ordered_scan
    from sightline.operators.steps import RECEIVED, RtpReceiver

    rows = parse_packets(packets.select(key, "arrival_no", "data"))
    if pt is not None:
        rows = rows.where(F.col("pt") == pt)
    kind = packets.schema[key].dataType.simpleString()
    return ordered_scan(rows.select(key, "arrival_no", "seq16", "ts32", "ssrc", "marker", "payload"), [key], ["arrival_no"], lambda: RtpReceiver(codec), f"{key} {kind}, " + RECEIVED)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Access units of a file by its suffix: a capture's packets by media time, any other file as Annex-B."""
    if not path.endswith(".pcap"):
        return read_annexb(spark, path)
    files = files_at(spark, path)
    h265 = pcap_descriptions(files).where(F.contains("sdp", F.lit("H265"))).limit(1).count() > 0
    return captured_units(files, H265 if h265 else H264).select("path", (F.col("au_no") - 1).alias("au_no"), F.col("ts64").alias("ts90k"), "key", "n_nals", "data")


def read_pictures(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Encoded picture files as they are (path, content), the first `most` by name; decoding is up to the user."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jp*g").load(path).select("path", "content")
    return files if most is None else files.orderBy("path").limit(most)


def length_prefixed_units(files: DataFrame, codec: str = H264, fps: float = 30.0) -> DataFrame:
    return _parsed(files, UNITS, lambda _, data: units_of(codec, split_lengths(data), fps))


def read_length_prefixed(spark: SparkSession, path: str, codec: str = H264, fps: float = 30.0) -> DataFrame:
    return length_prefixed_units(files_at(spark, path), codec, fps)


def pcap_packets(files: DataFrame) -> DataFrame:
    return _parsed(files, "arrival_no long, capture_us long, port int, data binary", lambda _, data: pcap_rtp(data))


def read_pcap_rtp(spark: SparkSession, path: str) -> DataFrame:
    return pcap_packets(files_at(spark, path))


def pcap_descriptions(files: DataFrame) -> DataFrame:
    return _parsed(files, "sdp string", lambda _, data: [{"sdp": x} for x in [pcap_sdp(data)] if x])


def read_pcap_sdp(spark: SparkSession, path: str) -> DataFrame:
    return pcap_descriptions(files_at(spark, path))


def described_media(descriptions: DataFrame) -> DataFrame:
    """The media of session descriptions (path, sdp): one row each, with its parameter sets and whether a receiver would take it."""

    def parse(_, sdp: bytes):
        media = parse_sdp(sdp.decode("utf-8", "replace"))
        chosen = receiver_config(media)
        for i, m in enumerate(media):
            pt = m.get("pt", (m["pts"] or [None])[0])
            yield {"media_no": i, "kind": m["kind"], "port": m["port"], "pt": pt, "codec": m["codec"], "clock": m["clock"], "channels": m["channels"], "crypto": [c["suite"] for c in m["crypto"]], "sets": m["sets"], "received": chosen is not None and (chosen["kind"], chosen["pt"]) == (m["kind"], pt)}

    files = descriptions.select("path", F.col("sdp").cast("binary").alias("content"))
    return _parsed(files, "media_no int, kind string, port int, pt int, codec string, clock int, channels int, crypto array<string>, sets array<binary>, received boolean", parse)


def picture_sizes(sets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width and height of sequence parameter sets (codec, sps)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = sets.select(*keys).schema.add("width", "integer").add("height", "integer")
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [sps_size(c, x) for c, x in zip(batch.column("codec").to_pylist(), batch.column("sps").to_pylist(), strict=True)]
            more = {"width": pa.array([w for w, _ in sizes], pa.int32()), "height": pa.array([h for _, h in sizes], pa.int32())}
            yield pa.RecordBatch.from_arrays([more[n] if n in more else batch.column(n) for n in schema.names], schema=schema)

    return sets.select(*keys, "codec", "sps").mapInArrow(run, kind)


def parse_packets(packets: DataFrame) -> DataFrame:
    """packets (data) with their RTP header fields; rows that are no RTP packets go."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = packets.drop("data").schema
    for name, t in (("seq16", "long"), ("ts32", "long"), ("ssrc", "long"), ("pt", "integer"), ("marker", "boolean"), ("payload", "binary")):
        kind = kind.add(name, t)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{**r, **h} for r in batch.to_pylist() if (h := rtp_header(r.pop("data") or b""))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return packets.mapInArrow(run, kind)
