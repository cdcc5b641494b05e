"""Hand-made cases and properties."""

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline import config
from sightline.functions import geometry as g
from sightline.functions import pixels
from sightline.functions import vectors as v
from sightline.operators import detector, matching, series, steps, trackers
from sightline.operators.fold import ordered_scan
from sightline.sources import audio, labels, media

DET = "stream_id long, frame_no long, det_id long, cl int, conf double, x0 double, y0 double, x1 double, y1 double"


def rows_of(step, rows):
    return [o for r in rows for o in step.push(r)]


def test_iou_cases(spark):
    cases = [((0, 0, 1, 1), (0, 0, 1, 1), 1.0), ((0, 0, 1, 1), (2, 2, 3, 3), 0.0), ((0, 0, 2, 1), (1, 0, 3, 1), 1 / 3), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 1, 1), (1, 0, 2, 1), 0.0)]
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b, _ in cases], ", ".join(f"{p}{s} double" for p in "ab" for s in g.SIDES))
    got = [r[0] for r in df.select(g.iou(g.box("a"), g.box("b"))).collect()]
    assert got == pytest.approx([c for *_, c in cases])
    a, b = (np.array([c[i] for c in cases], float) for i in (0, 1))
    assert np.diag(trackers.overlaps(a, b)) == pytest.approx(got) and trackers.overlaps(a, b[:2]).shape == (len(cases), 2)


def test_greedy_takes_the_first_of_equals():
    assert trackers.greedy(np.array([[0.5, 0.5, 0.1], [0.9, 0.2, 0.2], [0.3, 0.0, 0.0]])) == [(0, 0), (1, 1)]
    assert trackers.greedy(np.zeros((0, 3))) == trackers.greedy(np.zeros((3, 0))) == trackers.greedy(np.zeros((2, 2))) == []


def random_dets(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.random() * 0.7, rng.random() * 0.7
        out.append((i % 2, i % 5, i, rng.randrange(2), round(rng.random(), 1), x, y, x + rng.random() * 0.3, y + rng.random() * 0.3))
    return out


def test_suppression_properties(spark):
    det = spark.createDataFrame(random_dets(120), DET)
    kept = matching.suppress(det, 0.3)
    pairs = kept.alias("a").join(kept.alias("b"), ["stream_id", "frame_no", "cl"]).where("a.det_id < b.det_id")
    box = lambda t: {s: F.col(f"{t}.{s}") for s in g.SIDES}
    assert pairs.where(g.iou_suppression(box("a"), box("b")) > 0.3).isEmpty()
    again = matching.suppress(kept, 0.3)
    assert {r.det_id for r in again.collect()} == {r.det_id for r in kept.collect()}


def test_matching_is_one_to_one_and_maximal(spark):
    a, b = (spark.createDataFrame(random_dets(80, s), DET) for s in (1, 2))
    found = matching.match_boxes(a, b, "det_id", "det_id", 0.05).collect()
    key = lambda r, i: (r.stream_id, r.frame_no, i)
    used_a, used_b = {key(r, r.a_id) for r in found}, {key(r, r.b_id) for r in found}
    assert len(used_a) == len(used_b) == len(found)
    pairs = matching.sides(a, b, "det_id", "det_id").where(g.iou(g.box("a_"), g.box("b_")) >= 0.05).collect()
    assert all(key(r, r.a_id) in used_a or key(r, r.b_id) in used_b for r in pairs)


def test_perfect_tracking(spark):
    gt = spark.createDataFrame([(0, f, k, 0.1 * k, 0.1, 0.1 * k + 0.08, 0.3) for f in range(10) for k in range(4)], "stream_id long, frame_no long, gt_id long, x0 double, y0 double, x1 double, y1 double")
    r = matching.mota_summary(gt.withColumnRenamed("gt_id", "track_id"), gt, by=[]).first()
    assert (r.mota, r.motp, r.idf1, r.switches, r.mostly_tracked) == (1.0, 1.0, 1.0, 0, 4)


def test_switch_without_fragmentation_and_lost_objects(spark):
    box = (0.0, 0.0, 0.5, 0.5)
    gt = spark.createDataFrame([(0, f, 1, *box) for f in range(5)] + [(0, f, 2, 0.6, 0.6, 0.9, 0.9) for f in range(5)], "stream_id long, frame_no long, gt_id long, x0 double, y0 double, x1 double, y1 double")
    hyp = spark.createDataFrame([(0, 0, 7, *box), (0, 1, 8, *box), (0, 3, 7, *box), (0, 4, 7, *box), (0, 4, 99, 0.0, 0.9, 0.1, 1.0)], "stream_id long, frame_no long, track_id long, x0 double, y0 double, x1 double, y1 double")
    r = matching.mota_summary(hyp, gt, by=[]).first()
    assert (r.switches, r.fragmentations, r.missed, r.fp_tracks, r.mostly_tracked, r.mostly_lost) == (2, 1, 1, 1, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 3), min_size=1, max_size=40))
def test_throttle_gaps(gaps):
    t, rows = 100.0, []
    for x in gaps:
        t += x
        rows.append({"t": t})
    kept = [r["t"] for r in rows_of(steps.Throttle(0.5), rows) if r["kept"]]
    assert kept[0] == rows[0]["t"] and all(b - a >= 0.5 - 1e-6 for a, b in zip(kept, kept[1:], strict=False))


def test_throttle_jumps():
    got = [r["kept"] for r in rows_of(steps.Throttle(1.0), [{"t": t} for t in (5.0, 5.5, 6.0, 2.0, 2.5, 30.0)])]
    assert got == [True, False, True, True, False, True]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 65535), st.integers(5, 80), st.randoms())
def test_reorder_restores_small_shuffles(start, n, rng):
    order = list(range(n))
    for i in range(0, n - 2, 3):
        part = order[i : i + 3]
        rng.shuffle(part)
        order[i : i + 3] = part
    if order[0] != 0:  # the first packet fixes the start
        order.remove(0)
        order.insert(0, 0)
    out = rows_of(steps.Reorder(), [{"seq16": (start + k) % 65536, "ts32": k * 10} for k in order])
    assert [o["seq16"] for o in out if o["event"] == "out"] == [(start + k) % 65536 for k in range(n)]
    assert {o["event"] for o in out} == {"out"}


def test_reorder_losses():
    seqs = [10, 12, 13, 14, 15, 11, 16, 16]
    out = rows_of(steps.Reorder(), [{"seq16": s, "ts32": s} for s in seqs])
    assert [(o["event"], o["seq16"]) for o in out] == [("out", 10), ("missing", 11), ("out", 12), ("out", 13), ("out", 14), ("out", 15), ("late", 11), ("out", 16)]
    late = rows_of(steps.Reorder(), [{"seq16": 1, "ts32": 0}, {"seq16": 3, "ts32": 90_000}])
    assert [(o["event"], o["seq16"]) for o in late] == [("out", 1), ("missing", 2), ("out", 3)]
    wrap = rows_of(steps.Reorder(), [{"seq16": 0, "ts32": 2**32 - 5}, {"seq16": 1, "ts32": 5}])
    assert [o["ts64"] for o in wrap] == [2**32 - 5, 2**32 + 5]


def test_source_switch_on_the_fourth_packet():
    got = [r["accepted"] for r in rows_of(steps.SourceSwitch(), [{"ssrc": s} for s in (1, 2, 2, 1, 2, 2, 2, 1)])]
    assert got == [True, False, False, True, False, True, True, False]


def test_best_shot_and_snapshots():
    got = [r["taken"] for r in rows_of(steps.BestShot(least=0.1), [{"q": q, "frame_no": i} for i, q in enumerate((0.05, 0.2, 0.21, 0.25, 0.24, 0.31))])]
    assert got == [False, True, False, True, False, True]
    assert [r["picture"] for r in rows_of(steps.Snapshot(), [{"t": t} for t in (1.0, 6.0, 10.0, 11.0)])] == [False, True, False, True]


def test_decayed_histogram_equals_a_walk(spark):
    rng = random.Random(3)
    values = [rng.random() * 120 - 10 for _ in range(137)]
    bins = [0.0] * 40
    for i, x in enumerate(values, 1):
        if i % 10 == 0:
            bins = [b * series.DECAY**10 for b in bins]
        bins[min(39, max(0, int((x) / 100 * 40)))] += 1 - series.DECAY
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values, 1)], "series string, i long, v double")
    got = {r.bin: r.weight for r in series.decayed_histogram(df, 0.0, 100.0).collect()}
    assert all(got.get(k, 0.0) == pytest.approx(b, abs=1e-12) for k, b in enumerate(bins))


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(0, 5, 2)
        cost, limit = rng.random((n, m)), 0.6
        pairs, rows, cols = trackers.assignment(cost, limit)
        total = sum(cost[a, b] for a, b in pairs) + (len(rows) + len(cols)) * limit / 2
        best = (n + m) * limit / 2
        for k in range(min(n, m) + 1):
            for a in permutations(range(n), k):
                for b in permutations(range(m), k):
                    best = min(best, sum(cost[i, j] for i, j in zip(a, b, strict=True)) + (n + m - 2 * k) * limit / 2)
        assert total == pytest.approx(best)


def test_filters_stay_symmetric_and_follow():
    f = trackers.BoxFilter((0.1, 0.1, 0.2, 0.3), 0.0)
    for k in range(1, 12):
        f.update((0.1 + 0.01 * k, 0.1, 0.2 + 0.01 * k, 0.3), k * 0.1)
    c = f.filter.cov
    assert np.allclose(c, c.T, atol=1e-5) and np.linalg.eigvalsh(c.astype(float)).min() > -1e-6
    x = f.predict(1.2)
    assert x[0] == pytest.approx(0.22, abs=0.02)
    first = f.filter.mean.copy()
    f.predict(1.2)  # moves again from the same update
    assert f.filter.mean[0] > first[0]


def scene(frames=20, gone=()):
    for k in range(frames):
        dets = [{"det_id": 10 * k + j, "cl": 0, "conf": 0.9, "x0": 0.1 + 0.4 * j + 0.005 * k, "y0": 0.2, "x1": 0.25 + 0.4 * j + 0.005 * k, "y1": 0.6} for j in range(2) if (k, j) not in gone]
        yield {"frame_no": k, "t": k * 0.2, "dets": dets}


@pytest.mark.parametrize("make", [trackers.CascadeTracker, trackers.AssociationTracker])
def test_trackers_keep_ids(make):
    t = make()
    ids = [{o["track_id"]: o["det_id"] for o in t.push(f)} for f in scene(20, {(8, 1)})]
    assert len({i for x in ids[2:] for i in x}) == 2
    assert [sorted(d % 10 for d in x.values() if d is not None) for x in (ids[5], ids[19])] == [[0, 1], [0, 1]]


def test_cascade_loses_and_drops_tracks():
    t = trackers.CascadeTracker()
    frames = list(scene(3)) + [{"frame_no": k, "t": k * 0.3, "dets": []} for k in range(3, 20)]
    states = [[o["state"] for o in t.push(f)] for f in frames]
    assert states[2] == ["tracked", "tracked"] and states[4] == ["lost", "lost"] and states[-1] == []
    single = trackers.CascadeTracker(single=True)
    ids = [o["track_id"] for f in scene(3) for o in single.push(f)]
    assert ids == list(range(0xBEEF0000, 0xBEEF0000 + 6))


def test_batch_and_streaming_tracks_agree(spark, tmp_path):
    from sightline.streaming import drivers

    rows = [(0, f["frame_no"], f["t"], f["dets"]) for f in scene(6)]
    kind = "stream_id long, frame_no long, t double, dets array<struct<det_id: long, cl: int, conf: double, x0: double, y0: double, x1: double, y1: double>>"
    frames = spark.createDataFrame(rows, kind)
    for k in range(3):
        frames.where(f"frame_no div 2 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    batch = trackers.track(frames).select("frame_no", "track_id", "state", "observations").collect()

    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = drivers.stateful(stream, ["stream_id"], ["t"], trackers.CascadeTracker, trackers.TRACK_COLUMNS)
    got = drivers.drained(out).select("frame_no", "track_id", "state", "observations").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_labels_and_tracksets(spark, tmp_path):
    face, pose = " ".join(["0.5 0.5 0.9"] * 5), " ".join(["0.1 0.2 0.3"] * 17)
    (tmp_path / "a.txt").write_text(f"0 0.5 0.5 0.2 0.4\n1 0.5 0.5 0.2 0.4 {face}\n0 0.5 0.5 0.2 0.4 {pose}\n0 .5 .5 .2 .4 {face} {pose}\nbad\n1 2\n")
    rows = sorted(labels.read_labels(spark, str(tmp_path / "a.txt")).collect(), key=lambda r: r.line_no)
    assert [(r.cl, round(r.x0, 6), r.face_points and len(r.face_points), r.pose_points and len(r.pose_points)) for r in rows] == [(0, 0.4, None, None), (1, 0.4, 5, None), (0, 0.4, None, 17), (0, 0.4, 5, 17)]
    (tmp_path / "t.json").write_text('{"metadata": {"frame_rate": 5, "classes": ["person"]}, "frames": [{"frame_time": 0.0, "objects": {"7": {"box": [0, 0.1, 0.2, 0.3], "class": "person"}}}, {"frame_time": 0.2, "objects": {}}]}')
    assert [tuple(r) for r in labels.read_trackset(spark, str(tmp_path / "t.json")).collect()] == [(0, 0.0, 7, "person", 1.0, 0.0, 0.1, 0.2, 0.3)]


def test_prompts_and_raw_images(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(b"a dog".ljust(128, b"\0") + np.array([3, 4, 0, 0], "<f4").tobytes())
    r = labels.read_prompts(spark, str(tmp_path / "p.bin"), 4).first()
    assert (r.prompt_id, r.text) == (0, "a dog") and r.embedding == pytest.approx([0.6, 0.8, 0, 0])
    y, u, w = np.arange(24, dtype=np.uint8).reshape(4, 6), np.ones((2, 3), np.uint8), np.zeros((2, 3), np.uint8)
    assert all((a == b).all() for a, b in zip((y, u, w), labels.parse_raw_image(labels.raw_image(y, u, w)), strict=True))


def test_nal_units():
    sps, pps, idr, p = b"\x67\x42\x00\x1e", b"\x68\xce", b"\x65\x88\x84", b"\x41\x9a\x02"
    data = b"\0\0\0\1" + sps + b"\0\0\1" + pps + b"\0\0\1" + idr + b"\0\0\0\1" + p
    nals = media.split_annexb(data)
    assert nals == [sps, pps, idr, p] and [media.nal_class("h264", media.nal_type("h264", n)) for n in nals] == ["sps", "pps", "key", "video"]
    assert media.split_lengths(b"".join(len(n).to_bytes(4, "big") + n for n in nals)) == nals
    units = media.units_of("h264", nals, 25.0)
    assert [(u["n_nals"], u["key"], u["ts90k"]) for u in units] == [(3, True, 0), (1, False, 3600)]
    assert media.without_emulation(b"\0\0\3\1\0\0\3") == b"\0\0\1\0\0"


def test_exp_golomb():
    bits = "1" + "010" + "011" + "00100" + "00101"
    r = media.Bits(int(bits.ljust(24, "0"), 2).to_bytes(3, "big"))
    assert [r.ue(), r.ue(), r.ue(), r.se(), r.se()] == [0, 1, 2, 2, -2]


def test_picture_size():
    ue = lambda x: bin(x + 1)[2:].rjust(2 * len(bin(x + 1)) - 5, "0")
    body = format(66, "08b") + "0" * 8 + format(30, "08b") + ue(0) + ue(0) + ue(0) + ue(0) + ue(1) + "0" + ue(119) + ue(67) + "1" + "1" + "1" + ue(0) + ue(0) + ue(0) + ue(4) + "0"
    sps = b"\x67" + int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")
    assert media.sps_size("h264", sps) == (1920, 1080)


def sps():
    ue = lambda x: bin(x + 1)[2:].rjust(2 * len(bin(x + 1)) - 5, "0")
    body = format(66, "08b") + "0" * 8 + format(30, "08b") + ue(0) + ue(0) + ue(0) + ue(0) + ue(1) + "0" + ue(39) + ue(29) + "1" + "1" + "0" + "0" + "1"
    return b"\x67" + int(body.ljust(-(-len(body) // 8) * 8, "0"), 2).to_bytes(-(-len(body) // 8), "big")


def test_mp4_start():
    data = labels.mp4_init("h264", [sps(), b"\x68\xce"])
    assert data[4:8] == b"ftyp" and b"avcC\1" + sps()[1:4] in data and struct.pack(">HH", 640, 480) in data
    at, seen = 0, []
    while at < len(data):
        seen.append(data[at + 4 : at + 8])
        at += int.from_bytes(data[at : at + 4], "big")
    assert at == len(data) and seen == [b"ftyp", b"moov"]


def test_media_dispatch_and_pictures(spark, tmp_path):
    from tests_support import pcap_of_units

    (tmp_path / "x.pcap").write_bytes(pcap_of_units([[b"\x67a", b"\x65b"], [b"\x41c"]]))
    (tmp_path / "p.jpg").write_bytes(b"JPEG")
    assert [r.n_nals for r in media.read_media(spark, str(tmp_path / "x.pcap")).orderBy("au_no").collect()] == [2, 1]
    assert media.read_pictures(spark, str(tmp_path), 5).count() == 1
    assert len(media.units_of("h264", [b"\x65\x88", b"\x65\x08"], every_slice=True)) == 2


def test_conversion_paths():
    assert pixels.conversion_path("nv12", "planar") == ["nv12", "yuv420", "rgb24", "planar"] and pixels.conversion_path("rgb24", "rgb24") == ["rgb24"]
    with pytest.raises(ValueError):
        pixels.conversion_path("mono", "rgb24")
    a = [np.zeros((2, 2), np.uint8)]
    assert pixels.equal_images(a, a) and not pixels.equal_images(a, [a[0] + 3]) and pixels.equal_images(a, [a[0] + 3], 3)


def test_rtp_and_depacketization(spark):
    head = struct.pack(">BBHIII", 0x90 | 1, 0x80 | 96, 7, 1000, 42, 9) + struct.pack(">HHI", 1, 1, 5)
    h = media.rtp_header(head + b"xyz")
    assert (h["seq16"], h["ts32"], h["ssrc"], h["pt"], h["marker"], h["payload"]) == (7, 1000, 42, 96, True, b"xyz")
    assert media.rtp_header(b"\x40" + head[1:]) is None and media.rtp_header(head[:14]) is None
    rows = media.parse_packets(spark.createDataFrame([(1, head + b"p"), (2, b"bad")], "n long, data binary")).collect()
    assert [(r.n, bytes(r.payload)) for r in rows] == [(1, b"p")]
    fu = [b"\x7c\x85ab", b"\x7c\x05cd", b"\x7c\x45ef"]
    assert media.depacketized("h264", [b"\x67q", b"\x78\0\2\x68r\0\1s", *fu]) == ([b"\x67q", b"\x68r", b"s", b"\x65abcdef"], 0)
    assert media.depacketized("h264", [fu[1]]) == ([], 1)
    assert media.depacketized("h265", [b"\x62\x01\x93ab", b"\x62\x01\x53cd"])[0] == [b"\x26\x01abcd"]


def test_sdp():
    text = "v=0\r\nm=video 5004 RTP/AVP 96\r\na=rtpmap:96 H264/90000\r\na=fmtp:96 packetization-mode=1;sprop-parameter-sets=Z0I=,aM4=\r\na=crypto:1 AES_CM_128_HMAC_SHA1_80 inline:abc\r\nm=audio 0 RTP/AVP 0\r\na=rtpmap:0 PCMU/8000/1\r\n"
    m = media.parse_sdp(text)
    assert m[0]["codec"] == "H264" and m[0]["sets"] == [b"gB", b"h\xce"] and m[0]["crypto"][0]["key"] == "abc"
    assert media.receiver_config(m) == {"kind": "audio", "pt": 0, "clock": 8000, "codec": "PCMU"} and media.receiver_config(m[:1])["pt"] == 96


def test_pcap(spark, tmp_path):
    def packet(protocol, segment):
        ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(segment), 0, 0, 64, protocol, 0, 1, 2)
        p = b"\0" * 12 + b"\x08\0" + ip + segment
        return struct.pack("<IIII", 5, 7, len(p), len(p)) + p

    rtp = struct.pack(">BBHII", 0x80, 96, 1, 2, 3) + b"zz"
    tcp = struct.pack(">HHIIBBHHH", 554, 9, 0, 0, 0x50, 0, 0, 0, 0) + b"RTSP/1.0 200 OK\r\nContent-Type: application/sdp\r\n\r\nv=0\r\nm=video 1 RTP/AVP 96\r\n\r\n"
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + packet(17, struct.pack(">HHHH", 1, 5004, 8 + len(rtp), 0) + rtp) + packet(6, tcp) + packet(1, b"x")
    (tmp_path / "c.pcap").write_bytes(data)
    row = media.read_pcap_rtp(spark, str(tmp_path)).first()
    assert (row.arrival_no, row.capture_us, row.port, bytes(row.data)) == (1, 5_000_007, 5004, rtp)
    assert media.read_pcap_sdp(spark, str(tmp_path)).first().sdp == "v=0\r\nm=video 1 RTP/AVP 96"


def test_annexb_reader(spark, tmp_path):
    (tmp_path / "clip_10fps.264").write_bytes(b"\0\0\0\1\x65\x88" * 3)
    assert [(r.au_no, r.ts90k, r.key) for r in media.read_annexb(spark, str(tmp_path)).orderBy("au_no").collect()] == [(0, 0, True), (1, 9000, True), (2, 18000, True)]


def test_mp4_fragments(spark):
    rows = [(1, k, 3000, k % 2 == 0, bytes([k])) for k in range(4)]
    out = labels.mp4_fragments(spark.createDataFrame(rows, "stream_id long, au_no long, duration long, key boolean, data binary")).orderBy("fragment_no").collect()
    assert [(r.fragment_no, r.decode_time) for r in out] == [(1, 0), (2, 6000)]
    data = bytes(out[1].data)
    n = int.from_bytes(data[:4], "big")
    assert data[4:8] == b"moof" and data[n + 4 : n + 8] == b"mdat" and data[n + 8 :] == b"\2\3" and len(data) == n + 10


def test_wav(spark, tmp_path):
    x = np.array([0.0, 0.5, -1.0, 2.0, 0.25], np.float32)
    wav = audio.write_wav(8000, 1, x)
    rate, channels, y = audio.read_wav(wav)
    assert (rate, channels) == (8000, 1) and np.allclose(y, np.clip(x, -1, 1), atol=1e-4)
    (tmp_path / "a.wav").write_bytes(audio.write_wav(1000, 2, np.zeros(5000)))
    rows = audio.read_wavs(spark, str(tmp_path)).collect()
    assert [len(r.samples) for r in rows] == [2000, 2000, 1000] and audio.duration(1000, 2, 5000) == 2.5
    back = audio.wav_bytes(audio.read_wavs(spark, str(tmp_path)).withColumn("stream_id", F.lit(1))).first()
    assert bytes(back.wav) == (tmp_path / "a.wav").read_bytes()
    body = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 9, 9, 3, 24, b"data", 6) + b"\0\0\x40\0\0\xc0"
    assert audio.read_wav(body)[2].tolist() == [0.5, -0.5]


def test_audio_features(spark):
    t = np.arange(32_000) / 32_000
    tone = np.sin(2 * np.pi * 4000 * t)
    m = audio.LogMel()(tone)
    centres = audio.mel_to_hz(np.linspace(0, audio.hz_to_mel(16_000), 130))[1:-1]
    assert m.shape[1] == 128 and abs(centres[m.mean(0).argmax()] - 4000) < 200
    assert audio.mel_to_hz(audio.hz_to_mel(1234.5)) == pytest.approx(1234.5)
    half = audio.resample(np.sin(2 * np.pi * 300 * t), 32_000, 16_000)
    assert len(half) == 16_000 and np.allclose(half[100:-100], np.sin(2 * np.pi * 300 * np.arange(16_000) / 16_000)[100:-100], atol=1e-2)
    chunks = spark.createDataFrame([(1, tone[:4000].tolist())], "chunk_no long, samples array<float>")
    assert len(audio.log_mel(chunks, audio.LogMel()).first().mel[0]) == 128


def test_channel_mixes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "s array<double>")
    mix = lambda a, b: df.select(v.remixed(F.col("s"), a, b)).first()[0]
    assert mix(1, 2) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6] and mix(2, 1) == [1.5, 3.5, 5.5] and mix(3, 2) == [1, 2.5, 4, 5.5] and mix(2, 3) == [1, 1, 2, 3, 3, 4, 5, 5, 6]


def test_pixels():
    rng = np.random.default_rng(0)
    p, r = rng.integers(0, 256, (16, 24), np.uint8), rng.integers(0, 256, (16, 24), np.uint8)
    assert (pixels.half(p) == [[(int(p[y : y + 2, x : x + 2].sum()) + 2) // 4 for x in range(0, 24, 2)] for y in range(0, 16, 2)]).all()
    assert pixels.scale(p, 6, 4).shape == (4, 6) and (pixels.blur(np.full((5, 6), 77, np.uint8)) == 77).all()
    d = abs(p.astype(int) - r.astype(int))
    up = lambda a, b: (a + b + 1) // 2
    for y in range(4):
        for x in range(6):
            c = [up(up(d[4 * y, k], d[4 * y + 1, k]), up(d[4 * y + 2, k], d[4 * y + 3, k])) for k in range(4 * x, 4 * x + 4)]
            assert pixels.mad_4x4(p, r)[y, x] == (sum(c) + 2) // 4
    rgb = np.repeat(np.repeat(rng.integers(0, 256, (4, 4, 3), np.uint8), 2, 0), 2, 1)
    assert abs(pixels.to_rgb(*pixels.to_yuv(rgb)).astype(int) - rgb).max() <= 4
    u, w = pixels.deinterleave(pixels.interleave(p, r))
    assert (u == p).all() and (w == r).all()
    assert pixels.image_hash([p, r]) == pixels.image_hash([p.copy(), r]) != pixels.image_hash([r, p])
    assert (pixels.warp(p, np.array([[1, 0, 0], [0, 1, 0]]), 24, 16) == p).all()
    a = rng.random((5, 2))
    m = np.array([[0.9, 0.2, 3], [-0.1, 1.1, 4]])
    assert np.allclose(pixels.affine(a, a @ m[:, :2].T + m[:, 2]), m)
    box, score = pixels.noise_roi(np.array([[0, 1, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]]))
    assert box.tolist() == [0.25, 0.0, 0.75, 1 / 3] and score == pytest.approx(2 / 12)
    assert (pixels.reference_updated(p, r, (0, 0, 0, 0)) == p).all() and (pixels.reference_updated(p, r, (0, 0, 1, 1)) == r).all()


def test_image_columns(spark):
    p = np.arange(64, dtype=np.uint8).reshape(8, 8)
    row = pixels.on_images(spark.createDataFrame([(8, 8, p.tobytes(), "k")], "width int, height int, y binary, k string"), pixels.half).first()
    assert (row.width, row.height, row.k) == (4, 4, "k") and bytes(row.y) == pixels.half(p).tobytes()


def test_configuration():
    tree = {"a": {"x": 1, "x@jetson": 2}, "list": [{"b@cpu": 3}], "n@nvidia": {"k": 1}}
    assert config.for_platform(tree, "jetson") == {"a": {"x": 2}, "list": [{}]}
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    assert config.get({"a": {"b": "1.5"}}, "a.b", 0.0) == 1.5 and config.get({}, "a.b", True) is True
    assert config.InferConfig.of({"det_thr": 0.3}).over(config.InferConfig(nms_thr=0.5)) == config.InferConfig(det_thr=0.3, nms_thr=0.5)
    with pytest.raises(KeyError):
        config.InferConfig.of({"nope": 1})
    md = config.ModelDescription(("person", "face", "person_hat", "person_fiqa_0.5"))
    assert md.classes == ["person", "face"] and md.index("face") == 1 and md.fiqa_weights == {1: 0.6}


def test_detector_hook(spark):
    md = config.ModelDescription(("person", "face"), key_points=22, reid=2)

    def load():
        def model(batch):
            t = np.zeros((4 + 2 + 66 + 2, 3), np.float32)
            t[:4] = np.array([[50, 51, 50], [50, 50, 30], [40, 40, 10], [60, 60, 10]])
            t[4:6] = [[0.9, 0.8, 0.1], [0.1, 0.1, 0.7]]
            return [t] * len(batch)

        return model

    frames = spark.createDataFrame([(0, 1), (0, 2)], "stream_id long, frame_no long")
    rows = detector.infer(frames, load, md, config.InferConfig(det_thr=0.5, fuse_face_person=True), 100, 100).collect()
    assert len(rows) == 2 and all(r.det_id == 0 and r.face_id == 2 and len(r.face_points) == 5 and len(r.pose_points) == 17 for r in rows)
    assert detector.batch_size([(33, 20), (10, 70)], config.InferConfig(limit_max_width=640)) == (64, 96)
    grown = detector._grown([{"x": 0.4, "y": 0.4, "conf": 1}, {"x": 0.6, "y": 0.5, "conf": 1}])
    assert grown["x0"] == pytest.approx(0.37) and grown["y1"] == pytest.approx(0.52)


def test_pipeline_results(spark):
    from sightline.operators.pipeline import stats, track_streams

    rows = [(3, f["frame_no"], f["t"], None if k % 4 else 0.001, f["dets"]) for k, f in enumerate(scene(10))]
    frames = spark.createDataFrame(rows, "stream_id long, frame_no long, t double, area double, dets array<struct<det_id: long, cl: int, conf: double, x0: double, y0: double, x1: double, y1: double>>")
    out = {r.frame_no: r for r in track_streams(frames, 0.15).collect()}
    assert [out[k].result_type for k in (0, 1, 4)] == ["TRACK_FRAME_SKIP_NO_MOTION", "TRACK_FRAME_TRACKED_ROI", "TRACK_FRAME_SKIP_NO_MOTION"]
    assert len(out[9].tracks) == 2 and out[0].tracks is None and all(t.best > 0 for t in out[9].tracks)
    assert stats(track_streams(frames, 0.15)).count() == 2


def test_noise_floor_and_ordered_scan(spark):
    df = spark.createDataFrame([(b, k, float(v_)) for b in range(3) for k, v_ in enumerate([10] * 20 + [200])], "block long, frame_no long, v double")
    out = ordered_scan(df, ["block"], ["frame_no"], steps.NoiseFloor, "block long, frame_no long, v double, floor double, motion boolean").collect()
    assert len(out) == 63 and all(r.motion == (r.v > r.floor + 24) for r in out)
