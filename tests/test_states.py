"""Typed state: streams in several micro-batches give what batch gives, and silent keys leave by timer."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import steps, trackers
from sightline.operators.fold import ordered_scan
from sightline.plans.queries import REORDERED, det, pkt
from sightline.streaming import drivers, states

TINY = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def batches(df):
    """drained(), with the number of micro-batches."""
    seen = []
    inner = drivers.watched
    drivers.watched = lambda s, put, *a: inner(s, lambda r, b: (seen.append(b), put(r, b)), *a)
    try:
        return drivers.drained(df), seen
    finally:
        drivers.watched = inner


def test_reorder_buffer_over_micro_batches(spark):
    p = pkt(spark, TINY).select("stream_id", F.col("arrival_no").cast("long").alias("arrival_no"), F.col("seq16").cast("long").alias("seq16"), "ts32")
    want = ordered_scan(p, ["stream_id"], ["arrival_no"], steps.Reorder, REORDERED)
    got, seen = batches(states.reordered(states.replayed(p, "arrival_no", 4), "stream_id", "arrival_no", "seq16 long, ts32 long", REORDERED))
    assert len(set(seen)) >= 4 and rows(got, "*") == rows(want, "*") and got.where("event = 'out'").count() > 800


def test_tracks_over_micro_batches(spark):
    frames = trackers.frames_of(det(spark, TINY).withColumn("t", F.col("frame_no") * 0.5)).select("stream_id", "frame_no", "t", "dets")
    want = trackers.track(frames)
    got, seen = batches(states.tracked(states.replayed(frames, "frame_no")))
    assert len(set(seen)) >= 3 and rows(got, "*") == rows(want, "*") and got.where("observations > 1").count() > 0


def test_flat_states_over_micro_batches(spark):
    frames = det(spark, TINY).selectExpr("stream_id", "det_id AS frame_no", "det_id * 0.13D AS t", "conf AS area", "det_id % 5 <> 0 AS has_image")
    for make, state, column in (
        (lambda: steps.Throttle(0.5), "last double", "kept"),
        (steps.MotionSkip, "skipped boolean", "skipped"),
        (steps.Snapshot, "picture double, embedding double", "picture"),
    ):
        schema = f"stream_id long, frame_no long, t double, area double, has_image boolean, {column} boolean"
        want = ordered_scan(frames, ["stream_id"], ["frame_no"], make, schema)
        got = drivers.drained(states.stepped(states.replayed(frames, "frame_no"), ["stream_id"], ["frame_no"], make, state, schema))
        assert rows(got, "stream_id", "frame_no", column) == rows(want, "stream_id", "frame_no", column)


SHOT = "stream_id long, track_id long, frame_no long, taken boolean, best double, best_frame long, gone boolean"


@pytest.mark.parametrize("idle", [0, 10])
def test_a_silent_track_leaves_by_timer(spark, idle):
    # track 1 falls silent at second 5, track 2 goes on to second 60, track 1 comes back at 50 with a worse shot
    data = [(0, 1, k, k, 0.5 + k / 100) for k in range(6)] + [(0, 2, k, k, 0.4) for k in range(61)] + [(0, 1, 50, 50, 0.3)]
    df = spark.createDataFrame(data, "stream_id long, track_id long, frame_no long, s long, q double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    stream = states.replayed(df, "s", 6).withWatermark("ts", "1 second")
    out = drivers.drained(states.stepped(stream, ["stream_id", "track_id"], ["frame_no"], steps.BestShot, "best double, best_frame long", SHOT, idle_s=idle, left=True)).collect()
    gone = [(r.track_id, r.best_frame) for r in out if r.gone]
    back = [r for r in out if r.track_id == 1 and r.frame_no == 50]
    assert len(back) == 1
    if idle:
        # forgotten, so the worse shot is a new best one
        assert (1, 0) in gone and back[0].best == 0.3
    else:
        assert not gone and back[0].best == 0.5


def test_a_silent_stream_gives_up_its_tracks(spark):
    dets = [{"det_id": 1, "cl": 0, "conf": 1.3, "x0": 0.1, "y0": 0.1, "x1": 0.2, "y1": 0.3}]
    data = [(s, k, float(k), dets) for s, until in ((0, 6), (1, 60)) for k in range(until)]
    df = spark.createDataFrame(data, "stream_id long, frame_no long, t double, dets array<struct<det_id: long, cl: int, conf: double, x0: double, y0: double, x1: double, y1: double>>").withColumn("ts", F.timestamp_seconds(F.col("t").cast("long") + 1000))
    out = drivers.drained(states.tracked(states.replayed(df, "frame_no", 5).withWatermark("ts", "1 second"), idle_s=8)).collect()
    assert [(r.stream_id, r.observations) for r in out if r.state == "gone" and r.stream_id == 0] == [(0, 6)]
    assert len([r for r in out if r.state != "gone"]) == 66


def test_saved_tracks_are_the_same(spark):
    a, b = trackers.CascadeTracker(), trackers.CascadeTracker()
    for k in range(30):
        dets = [{"det_id": 10 * k + j, "cl": 0, "conf": 0.7 + j / 10, "x0": 0.1 * j + k / 100, "y0": 0.2, "x1": 0.1 * j + 0.1 + k / 100, "y1": 0.4, "reid": [1.0, j, 0.5], "pose_points": [{"x": 0.1 * j + 0.05, "y": 0.3, "conf": 0.9}]} for j in range(3) if (k + j) % 7]
        row = {"frame_no": k, "t": k * 0.3, "dets": dets}
        c = trackers.CascadeTracker()
        c.restore(b.next_id, b.saved())
        b = c
        assert list(a.push(row)) == list(b.push(row))
