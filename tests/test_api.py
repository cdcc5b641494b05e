import numpy as np
import pytest

from sightline import api
from tests_support import pcap_of_units


def det(x, **more):
    return {"box": [x, 0.1, x + 0.2, 0.5], "confidence": 0.9, "class": 0, **more}


def test_matching_of_lists(spark):
    a, b = [det(0.1), det(0.5)], [det(0.52), det(0.11), {**det(0.1), "class": 1}]
    assert api.match_box_iou(spark, a, b, 0.3) == ([0, 1], [1, 0])
    face = [v for k in range(5) for v in (0.2 + 0.01 * k, 0.2, 0.9)]
    assert api.match_box_iou(spark, [det(0.1, face_points=face)], [det(0.1, face_points=face)], 0.3, api.FACE_POINTS) == ([0], [0])
    with pytest.raises(ValueError):
        api.parse_detection(det(0.1, face_points=[1, 2]))
    with pytest.raises(KeyError):
        api.parse_detection({"box": [0, 0, 1, 1]})


def test_metrics_of_frames(spark):
    m = api.MotaMetrics(spark)
    for k in range(4):
        m.add_frame([det(0.1, track_id=5 if k < 2 else 6)], [det(0.1, track_id=1)])
    r = m.get_results()
    assert (r["matches"], r["switches"], r["mota"]) == (4, 1, 0.75)


def test_motion_tracker():
    t = api.MotionTracker()
    still = np.full((64, 64), 50, np.uint8)
    t.add_frame(still)
    assert t.get_roi().tolist() == [0, 0, 1, 1]
    t.add_frame(still)
    assert t.score == 0 and t.get_roi().tolist() == [0, 0, 0, 0]
    moved = still.copy()
    moved[16:40, 16:40] = 250
    t.add_frame(moved)
    assert t.score > 0 and t.get_roi()[0] <= 0.25 and t.get_roi()[2] >= 0.6
    t.set_roi((0, 0, 1, 1))
    t.add_frame(moved)
    assert t.score == 0


def test_pcap_decoder():
    d = api.PcapDecoder(pcap_of_units([[b"\x67a", b"\x65b"], [b"\x41c"]]))
    assert [d.get_frame()["nals"], d.get_frame()["nals"], d.get_frame()] == [[b"\x67a", b"\x65b"], [b"\x41c"], None]


def test_pcap_decoder_sorts_and_tells_losses():
    data = pcap_of_units([[b"\x67a", b"\x65b"], [b"\x41c", b"\x41d"], [b"\x41e"], [b"\x41f"], [b"\x41g"], [b"\x41h"], [b"\x41i"]])
    head, records, at = data[:24], [], 24
    while at < len(data):
        n = 16 + int.from_bytes(data[at + 8 : at + 12], "little")
        records.append(data[at : at + n])
        at += n
    frames = lambda some: [(f["ts90k"], f["nals"], f["complete"]) for f in iter(api.PcapDecoder(head + b"".join(some)).get_frame, None)]
    whole = frames(records)
    assert [f[1] for f in whole] == [[b"\x67a", b"\x65b"], [b"\x41c", b"\x41d"], [b"\x41e"], [b"\x41f"], [b"\x41g"], [b"\x41h"], [b"\x41i"]]
    # out of order, and one twice
    assert frames([records[k] for k in (0, 2, 1, 1, 4, 3, 5, 6, 8, 7)]) == whole
    lost = frames(records[:3] + records[4:])
    assert [f[1] for f in lost][:2] == [[b"\x67a", b"\x65b"], [b"\x41c"]] and not all(f[2] for f in lost)


def test_individual_images_and_video_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from sightline.config import InferConfig, ModelDescription

    def seen_by(image):
        def model(batch):
            at = np.array([[50], [50], [40], [60], [0.9]], np.float32)
            return [at if image(f) else at * 0 for f in batch["frame_no"]]

        return model

    md, cfg = ModelDescription(("person",)), InferConfig(det_thr=0.5)
    images = spark.createDataFrame([(1, k, k * 0.2) for k in range(4)], "stream_id long, frame_no long, t double")
    s = api.TrackStream(api.TrackSharedState({"min_interval": 10.0}))
    rows = {r.frame_no: r for r in s.run_on_individual_images(images, lambda: seen_by(lambda f: f != 2), md, cfg, 100, 100).collect()}
    assert [[(t.state, t.det_id is not None) for t in rows[k].tracks] for k in range(4)] == [[("tracked", True)], [("tracked", True)], [], [("tracked", True)]]
    assert len({rows[k].tracks[0].track_id for k in (0, 1, 3)}) == 3
    (tmp_path / "a_10fps.264").write_bytes(b"\0\0\0\1\x65\x88" * 5)
    s = api.TrackStream(api.TrackSharedState())
    decode = lambda units: units.select("path", F.col("au_no").alias("frame_no"), (F.col("ts90k") / 90_000).alias("t"))
    out = s.run_on_video_file(spark, f"{tmp_path}/a_10fps.264", decode, lambda: seen_by(lambda f: True), md, cfg, 100, 100).orderBy("frame_no").collect()
    assert [(r.frame_no, round(r.t, 6), len(r.tracks)) for r in out] == [(k, k / 10, 1) for k in range(5)] and len({r.tracks[0].track_id for r in out}) == 1


def test_stream(spark):
    s = api.TrackStream(api.TrackSharedState({"min_interval": 0.1}), {"tracker": "association"}, "door")
    rows = [(1, k, k * 0.2, None, [(k, 0, 0.9, 0.1, 0.1, 0.3, 0.5)]) for k in range(5)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_no long, t double, area double, dets array<struct<det_id: long, cl: int, conf: double, x0: double, y0: double, x1: double, y1: double>>")
    assert s.run(frames).where("size(tracks) = 1").count() == 5 and len(s.get_results()) == 1 and s.get_results() == []
    assert api.configure(api.InferConfig(det_thr=0.1), {"nms_thr": 0.4}).det_thr == 0.1 and api.get_version()


def test_stream_of_packets(spark):
    data = pcap_of_units([[b"\x67a", b"\x65b"], [b"\x41c"], [b"\x41d"]])
    rows = [(s, p["arrival_no"], p["data"]) for s in (1, 2) for p in api.media.pcap_rtp(data)]
    rows += [(1, 100, rows[0][2][:1] + b"\x61" + rows[0][2][2:]), (1, 101, b"no packet"), (1, 102, None)]  # another payload type, and what is no packet
    packets = spark.createDataFrame(rows, "stream_id long, arrival_no long, data binary")
    s = api.TrackStream(api.TrackSharedState())
    s.set_sdp("v=0\r\nm=audio 1 RTP/AVP 97\r\na=rtpmap:97 OPUS/48000\r\nm=video 0 RTP/AVP 96\r\na=rtpmap:96 H264/90000\r\n")
    units = sorted((r.stream_id, r.au_no, r.key, r.n_nals, r.complete, bytes(r.data)) for r in s.add_rtp_packets(packets).collect())
    start = b"\0\0\0\1"
    want = [(1, True, 2, True, start + b"\x67a" + start + b"\x65b"), (2, False, 1, True, start + b"\x41c"), (3, False, 1, True, start + b"\x41d")]
    assert units == [(k, *u) for k in (1, 2) for u in want]
    assert s.add_rtp_packets(packets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.set_sdp("v=0\r\nm=audio 1 RTP/AVP 97\r\na=rtpmap:97 OPUS/48000\r\n")


def test_stream_of_images(spark):
    from sightline.config import InferConfig, ModelDescription

    def load():
        def model(batch):
            at = np.array([[50], [50], [40], [60], [0.9]], np.float32)
            return [at if f != 2 else at * 0 for f in batch["frame_no"]]  # frame 2 shows nothing

        return model

    images = spark.createDataFrame([(1, k, k * 0.2) for k in range(4)], "stream_id long, frame_no long, t double")
    s = api.TrackStream(api.TrackSharedState())
    rows = {r.frame_no: r for r in s.run_on_images(images, load, ModelDescription(("person",)), InferConfig(det_thr=0.5), 100, 100).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and len({rows[k].tracks[0].track_id for k in (0, 1, 3)}) == 1
    assert rows[2].tracks[0].det_id is None and rows[3].tracks[0].det_id is not None
