"""MP4 files: parts, samples read back in ranges, segments of micro-batches."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_core import sps

from sightline.sources import media, mp4
from sightline.streaming import drivers, states


def units(n, every=7, seed=1, start=0):
    rng, out, ts = random.Random(seed), [], 1000
    for k in range(n):
        key = k % every == start
        nals = ([sps(), b"\x68\xce"] if key else []) + [(b"\x65\x88" if key else b"\x41\x9a") + bytes(rng.choice([5, 6, 7, 255]) for _ in range(rng.randrange(1, 30)))]
        out.append((k, ts, b"".join(b"\0\0\0\1" + x for x in nals)))
        ts += rng.choice([3000, 3000, 3003, 0, 9000])
    return out


def samples(rows):
    """Duration, key and length-prefixed data of each unit."""
    steps = [max(1, b[1] - a[1]) for a, b in zip(rows, rows[1:], strict=False)]
    steps.append(max(1, sum(steps) // len(steps)) if steps else 3003)
    return [(d, any(x[0] & 31 == 5 for x in media.split_annexb(r[2])), b"".join(struct.pack(">I", len(x)) + x for x in media.split_annexb(r[2]))) for d, r in zip(steps, rows, strict=True)]


def fragments(rows):
    out = []
    for s in samples(rows):
        if s[1] or not out:
            out.append([])
        out[-1].append(s)
    return out


def read(spark, path, **options):
    got = {}
    for r in sorted(mp4.read_mp4(spark, path, **options).collect(), key=lambda r: (r.path, r.fragment_no, r.sample_no)):
        got.setdefault(r.path.rsplit("/", 1)[1], {}).setdefault((r.fragment_no, r.decode_time), []).append((r.duration, r.key, bytes(r.data)))
    return got


def expected(rows):
    out, at = {}, 0
    for i, f in enumerate(fragments(rows), 1):
        out[i, at] = f
        at += sum(d for d, _, _ in f)
    return out


SCHEMA = "stream_id long, au_no long, ts64 long, data binary"


@pytest.mark.parametrize("range_bytes", [300, 1 << 20])
def test_files_hold_their_units(spark, tmp_path, range_bytes):
    streams = {1: units(40), 2: units(25, start=3), 3: units(1), 4: [(0, 5, b"\0\0\0\1\x41\x9a\x05")]}
    df = spark.createDataFrame([(s, *u) for s, rows in streams.items() for u in rows], SCHEMA).repartition(4)
    mp4.write_mp4(df, f"file://{tmp_path}/out")
    got = read(spark, f"file://{tmp_path}/out", range_bytes=range_bytes, backBytes=900)
    # units before the first key are a fragment too; a stream without parameter sets has no file
    assert got == {f"{s}.mp4": expected(streams[s]) for s in (1, 2, 3)}
    data = (tmp_path / "out" / "1.mp4").read_bytes()
    at, kinds = 0, []
    while at < len(data):
        kinds.append(data[at + 4 : at + 8].decode())
        at += int.from_bytes(data[at : at + 4], "big")
    assert at == len(data) and kinds == ["ftyp", "moov"] + ["moof", "mdat"] * 6


def test_hevc_needs_three_sets():
    w = mp4.Mp4Writer(media.H265)
    assert list(w.push({"ts64": 0, "data": b"\0\0\0\1\x40\1x\0\0\0\1\x44\1y\0\0\0\1\x26\1z"})) == [] and not w.started


def test_segments_of_micro_batches(spark, tmp_path):
    rows = [(s, *u) for s in (1, 2) for u in units(60, every=9, seed=s)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("au_no") + 1000))
    last = spark.createDataFrame([(9, 500, 0, b"")], SCHEMA).withColumn("ts", F.timestamp_seconds(F.lit(3000)))
    stream = states.replayed(df.unionByName(last), "au_no", 5).withWatermark("ts", "1 second")
    query = mp4.segments(states.mp4_parts(stream, media.H264, idle_s=60), f"file://{tmp_path}/seg", f"file://{tmp_path}/check")
    query.awaitTermination()
    assert len({p["batchId"] for p in query.recentProgress}) >= 4
    (tmp_path / "whole").mkdir()
    for s in (1, 2):
        parts = sorted((tmp_path / "seg").glob(f"{s}-*.m4s"))
        assert len(parts) == 1 + 7
        (tmp_path / "whole" / f"{s}.mp4").write_bytes(b"".join(p.read_bytes() for p in parts))
    assert read(spark, str(tmp_path / "whole")) == {f"{s}.mp4": expected([u[1:] for u in rows if u[0] == s]) for s in (1, 2)}
    assert not list((tmp_path / "seg").glob("_temporary*"))
