"""Files read in byte ranges equal files read whole."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.sources import audio, media, ranged, sinks


def nals(rng, n, codec=media.H264):
    out = []
    for i in range(n):
        head = b"\x67\x42" if i % 20 == 0 else b"\x68\xce" if i % 20 == 1 else b"\x65\x88" if i % 20 == 2 else rng.choice([b"\x41\x88", b"\x41\x40", b"\x06\x05"])
        body = bytes(rng.choice([1, 2, 3, 7, 255]) for _ in range(rng.randrange(0, 40)))
        out.append(head + body)
    return out


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def same(a, b, *columns):
    rows = lambda df: sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect())
    assert (got := rows(a)) == rows(b) and got
    return got


SIZES = [3, 17, 101, 1 << 20]
#: So that chains are looked for in small files too.
BACK = 2000


@pytest.mark.parametrize("n", SIZES)
def test_annexb_in_ranges(spark, tmp_path, n):
    rng = random.Random(n)
    data = b"\0\0" + b"".join(rng.choice([b"\0\0\1", b"\0\0\0\1", b"\0\0\0\0\0\1"]) + x for x in nals(rng, 12 if n < 10 else 60))
    at = put(tmp_path, "v.264", data)
    got = ranged.loaded(spark, ranged.AnnexB, at, n)
    assert [bytes(r.nal) for r in sorted(got.collect(), key=lambda r: r.offset)] == media.split_annexb(data)
    whole = media.annexb_units(media.files_at(spark, at))
    for width in (7, 1 << 16) if n == 101 else (1 << 16,):
        same(ranged.annexb_units(spark, at, range_bytes=n, width=width), whole, "au_no", "ts90k", "key", "n_nals", "data")
    same(ranged.annexb_units(spark, at, range_bytes=n, every_slice=True), media.annexb_units(media.files_at(spark, at), every_slice=True), "au_no", "key", "data")


def capture(rng, n, order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", ("<", True): b"\x4d\x3c\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    out = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        rtp = struct.pack(">BBHII", 0x80 if i % 7 else 0x40, 96, i, 3000 * i, 9) + bytes(rng.choice([0, 1, 0xFF]) for _ in range(rng.randrange(0, 60)))
        tcp = i % 5 == 4
        segment = b"\0" * 12 + b"\x50" + b"\0" * 7 + rtp if tcp else struct.pack(">HHHH", 1, 5000 + i % 3, 8 + len(rtp), 0) + rtp
        p = b"\0" * 12 + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(segment), 0, 0, 64, 6 if tcp else 17, 0, 1, 2) + segment
        out += struct.pack(order + "IIII", 1_700_000_000 + i, i, len(p), len(p)) + p
    return out


@pytest.mark.parametrize("order, nano", [("<", False), (">", True)])
@pytest.mark.parametrize("n", [150, 1033, 1 << 20])
def test_pcap_in_ranges(spark, tmp_path, n, order, nano):
    data = capture(random.Random(n), 120, order, nano)
    at = put(tmp_path, "c.pcap", data)
    put(tmp_path, "none.pcap", b"not a capture")
    same(ranged.pcap_packets(spark, at, n, backBytes=BACK), media.pcap_packets(media.files_at(spark, at)), "arrival_no", "capture_us", "port", "data")
    found = ranged.ranges(spark, ranged.Pcap, at, n, BACK)
    assert ranged.linked(found).count() == 0 and found.where("entry IS NOT NULL").count() >= min(3, len(data) // n)


def test_a_cut_capture_loses_only_its_last_packet(spark, tmp_path):
    data = capture(random.Random(1), 60)
    at = put(tmp_path, "c.pcap", data[:-5])
    got = ranged.pcap_packets(spark, at, 400).count()
    whole = ranged.pcap_packets(spark, put(tmp_path, "c.pcap", data), 400).count()
    assert whole - 1 <= got <= whole


def test_wrong_links_are_told(spark):
    found = spark.createDataFrame([("a", 0, 24, 100), ("a", 1, 101, 200), ("a", 2, None, None), ("a", 3, 200, 300)], "path string, range_no int, entry long, exit long")
    assert [r.range_no for r in ranged.linked(found).collect()] == [1]


@pytest.mark.parametrize("n", SIZES[1:])
def test_length_prefixed_in_ranges(spark, tmp_path, n):
    rng = random.Random(n)
    data = b"".join(struct.pack(">I", len(x)) + x for x in nals(rng, 80))
    at = put(tmp_path, "v.avcc", data)
    same(ranged.length_prefixed_units(spark, at, range_bytes=n, backBytes=BACK), media.length_prefixed_units(media.files_at(spark, at)), "au_no", "ts90k", "key", "n_nals", "data")
    assert ranged.linked(ranged.ranges(spark, ranged.LengthPrefixed, at, n, BACK)).count() == 0


@pytest.mark.parametrize("n", [64, 1000, 1 << 20])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_in_ranges(spark, tmp_path, n, channels):
    x = np.sin(np.arange(1501 * channels) / 7).astype(np.float32)
    data = audio.write_wav(800, channels, x)
    at = put(tmp_path, "a.wav", data[:36] + b"LIST" + struct.pack("<I", 5) + b"abcde\0" + data[36:])
    rows = same(ranged.wav_chunks(spark, at, 100, n).withColumn("samples", F.col("samples").cast("string")), audio.wav_chunks(media.files_at(spark, at), 100).withColumn("samples", F.col("samples").cast("string")), "chunk_no", "sample_rate", "num_channels", "samples")
    assert len(rows) == 19


def test_one_file_is_many_partitions(spark, tmp_path):
    data = b"".join(b"\0\0\1" + x for x in nals(random.Random(2), 200))
    at = put(tmp_path, "v.264", data)
    df = ranged.loaded(spark, ranged.AnnexB, at, len(data) // 5 + 1)
    assert df.rdd.getNumPartitions() == 5 and df.select("range_no").distinct().count() == 5


def test_files_are_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i % 3}.bin", i, bytes([i])) for i in range(30)], "name string, k long, data binary").repartition(4)
    sinks.write_files(rows, f"file://{tmp_path}/out", ["k"])
    assert {p.name: list(p.read_bytes()) for p in (tmp_path / "out").iterdir()} == {f"f{j}.bin": list(range(j, 30, 3)) for j in range(3)}
    spark.dataSource.register(sinks.FilesSink)
    with pytest.raises(Exception):
        rows.select("name", "data").write.format("sightline_files").mode("append").save(f"file://{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("*.bin")) if (tmp_path / "bad").exists() else True
