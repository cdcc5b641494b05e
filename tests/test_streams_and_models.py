"""The mask gate of the tracker, decoding by class, label tails, chunked streams, searches in blocks."""

import numpy as np
import pytest

from sightline import config
from sightline.functions import vectors as v
from sightline.operators import detector, trackers
from sightline.operators.steps import RtpReceiver, UnitChunker
from sightline.sources import audio, labels, media


def det(i, x, y, size=0.1, conf=0.9, **more):
    return {"det_id": i, "cl": 0, "conf": conf, "x0": x, "y0": y, "x1": x + size, "y1": y + size, **more}


def test_cells_equal_those_of_the_column(spark):
    from sightline.functions import geometry as g

    rng = np.random.default_rng(1)
    boxes = [tuple(map(float, b)) for b in rng.uniform(-0.3, 1.3, (200, 4)).round(3)]
    rows = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double").select(*g.SIDES, g.cell_mask(g.box()).alias("m")).collect()
    assert all(r.m % (1 << 64) == trackers.cells((r.x0, r.y0, r.x1, r.y1)) for r in rows)


def test_a_likeness_alone_does_not_join_far_boxes():
    t = trackers.CascadeTracker()
    same = [1.0, 0.0, 0.0]
    first = list(t.push({"frame_no": 0, "t": 0.0, "dets": [det(0, 0.1, 0.1, conf=1.2, reid=same), det(1, 0.4, 0.8, conf=1.2, reid=[0.0, 1.0, 0.0])]}))
    second = list(t.push({"frame_no": 1, "t": 0.1, "dets": [det(2, 0.7, 0.5, reid=same), det(3, 0.4, 0.8, reid=[0.0, 1.0, 0.0])]}))
    was = {r["det_id"]: r["track_id"] for r in first}
    now = {r["det_id"]: r["track_id"] for r in second if r["det_id"] is not None}
    assert now[3] == was[1] and now[2] not in was.values()


def test_flow_box_covers_moved_pose_points():
    t = trackers.CascadeTracker(move_point=lambda p: p + 0.3)
    list(t.push({"frame_no": 0, "t": 0.0, "dets": [det(0, 0.3, 0.3, conf=1.2, pose_points=[{"x": 0.35, "y": 0.35, "conf": 0.9}])]}))
    list(t.push({"frame_no": 1, "t": 0.1, "dets": []}))
    assert np.allclose(t.tracks[0].flow, [0.3, 0.3, 0.65, 0.65])


def test_removed_ids_of_the_association_tracker_do_not_pile_up():
    t = trackers.AssociationTracker()
    for k in range(200):
        list(t.push({"frame_no": k, "t": k * 1.0, "dets": [det(k, k % 8 / 10, k * 3 % 8 / 10)] if k % 3 == 0 else []}))
    assert len(t.removed) <= len(t.tracked) + len(t.lost) + 2


def test_decode_gives_each_class_its_own():
    md = config.ModelDescription(("person", "face"), key_points=22, reid=1)
    t = np.zeros((4 + 2 + 66 + 1, 1))
    t[:6, 0] = [50, 50, 20, 20, 0.9, 0.8]
    rows = detector.decode(t, md, 0.5, 100, 100)
    assert [r["cl"] for r in rows] == [0, 1]
    assert "face_points" not in rows[0] and len(rows[0]["pose_points"]) == 17 and rows[0]["reid"] == [0.0]
    assert len(rows[1]["face_points"]) == 5 and "pose_points" not in rows[1] and "reid" not in rows[1]


def test_decode_of_nineteen_points():
    md = config.ModelDescription(("person", "face"), key_points=19)
    t = np.zeros((4 + 2 + 57, 1))
    t[:6, 0] = [50, 50, 20, 20, 0.9, 0.1]
    rng = np.random.default_rng(3)
    points = rng.uniform(0, 1, (19, 3))
    t[6:, 0] = (points * [100, 100, 1]).ravel()
    (row,) = detector.decode(t, md, 0.5, 100, 100)
    x0 = x1 = points[2, 0]
    y0 = y1 = points[2, 1]
    for k in (1, 0, 18, 17):
        x0, x1, y0, y1 = min(x0, points[k, 0]), max(x1, points[k, 0]), min(y0, points[k, 1]), max(y1, points[k, 1])
        w, h = x1 - x0, y1 - y0
        x0, x1, y0, y1 = x0 - 0.15 * w, x1 + 0.15 * w, y0 - 0.2 * h, y1 + 0.2 * h
    want = {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "conf": points[[2, 1, 0, 18, 17], 2].sum()}
    assert row["subbox"] == pytest.approx(want) and len(row["pose_points"]) == 17 and len(row["face_points"]) == 5


def test_label_tails_and_cap(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n" * 200 + "0 0.5 0.5 0.2 0.2 x 3\n1 2 3 4\n2 x 1 1 1 1\n" + "3 0.1 0.1 0.1 0.1\n" * 400)
    rows = labels.read_labels(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert len(rows) == labels.MOST_LABELS and rows[0].cl == 0 and rows[0].x0 == pytest.approx(0.4) and {r.cl for r in rows[1:]} == {3}


@pytest.mark.parametrize("rate, to", [(64, 48), (48, 64), (10, 10), (44100, 16000)])
def test_resampling_in_chunks_equals_the_whole(rate, to):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 900).astype(np.float32)
    own, out = audio.Resampler(rate, to), []
    for part in np.split(x, [3, 4, 200, 201, 650]):
        out.append(own.push(part))
    assert np.allclose(np.concatenate([*out, own.end()]), audio.resample(x, rate, to), atol=1e-6)


def test_chunked_units_equal_whole_ones():
    nals = [b"\x67\x42\x01", b"\x68\xce", b"\x65\x88\x05"] + [bytes([0x41, 0x88 if k % 3 else 0x40, k + 4]) for k in range(30)]
    data = b"".join((b"\0\0\0\1" if k % 2 else b"\0\0\1") + x for k, x in enumerate(nals))
    for size in (1, 2, 5, 1000):
        own = UnitChunker("h264", 25.0)
        got = [u for k in range(0, len(data), size) for u in own.push({"data": data[k : k + size]})] + list(own.end())
        assert got == media.units_of("h264", media.split_annexb(data), 25.0)


def test_receiver_reports_loss():
    own = RtpReceiver("h264")
    packet = lambda n, payload, marker: {"ssrc": 7, "seq16": n, "ts32": n // 2 * 3000, "marker": marker, "payload": payload}
    sent = [packet(n, bytes([0x41, 0x88, n]), n % 2 == 1) for n in range(40) if n != 9]
    units = [u for p in sent for u in own.push(p)] + list(own.end())
    assert [u["complete"] for u in units].count(False) == 1 and sum(u["n_packets"] for u in units) == 39
    own.reset()
    assert not own.packets and own.source.current is None


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x, p = rng.normal(0, 1, (40, 8)), rng.normal(0, 1, (30, 8))
    p[7] = p[3]
    a = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    b = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(p)], "prompt_id long, embedding array<double>")
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    cosine = unit(x) @ unit(p).T
    for block in (4, 1000):
        got = {(r.vec_id, r.rank): r.prompt_id for r in v.nearest(a, b, 3, block=block).collect()}
        want = {(i, k + 1): j for i, row in enumerate(cosine) for k, j in enumerate(sorted(range(30), key=lambda j: (-round(row[j], 12), j))[:3])}
        assert got == want
    assert v.nearest(a, b.limit(0), 3).count() == 0


def test_centered_of_groups_and_of_all(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 0.0])], "label int, e array<double>")
    got = sorted((r.label, tuple(np.round(r.centered, 4))) for r in v.centered(rows, "e", ["label"]).collect())
    assert got[0][1] == (-0.7071, -0.7071) and got[1][1] == (0.7071, 0.7071)
    assert v.centered(rows, "e", []).count() == 3


def test_streams_are_drained_to_files_and_watched(spark, tmp_path):
    from sightline.streaming import drivers

    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "id long, k long")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert drivers.drained(stream()).count() == 30
    assert {r["k"]: r["count"] for r in drivers.drained(stream().groupBy("k").count(), "complete").collect()} == {0: 10, 1: 10, 2: 10}
    seen = []
    drivers.watched(stream(), lambda batch, n: seen.append((n, batch.count()))).awaitTermination()
    assert sum(n for _, n in seen) == 30
