"""Queries against their SQL on rows as larger tables have them, and steps whose work must not outgrow their input."""

import duckdb
import numpy as np
import pytest

from sightline.plans.queries import ORACLE, QUERIES


def both(spark, name, folder, table):
    """The query's rows and its SQL's, sorted."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    return sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, str(folder)).collect()), key=repr), sorted(result.fetchall(), key=repr)


def put_events(spark, folder, rows):
    """events of (event_id, user_id)."""
    spark.createDataFrame([(i, u, "click", 1.0) for i, u in rows], "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("name", ["best_shot", "stream_best_shot"])
def test_shots_at_the_bar(spark, tmp_path, name):
    """A shot of exactly 1.2 times the last one: the product's rounding decides, so both sides multiply in one order."""
    put_events(spark, tmp_path, [(700_000 + i, 11_359) for i in [196, 270, 2616, 2908, 2953, 4444, 5296, 6165, 7512, 8834, 11658, 11718, 12554, 14312, 14723, 22293, 22511, 23503, 24762, 25530, 25884, 26021, 26540, 30001, 31522, 32387, 33581, 35816, 37735, 37781, 40261, 42234, 44664, 46582, 47638, 48720, 49661, 49690, 49838, 50395, 51659, 52666, 53811, 56873, 58316, 64395, 65525, 66907, 66950, 69175, 69924, 70132, 70999, 71792, 74274, 74424, 75554, 76239, 77477, 81019, 82715, 84609, 86284, 86372, 86840, 86944, 88735, 90273, 92356, 92417, 94707, 95895, 97482, 97909, 98338, 99704]])
    got, want = both(spark, name, tmp_path, "events")
    assert got == want


def test_moved_boxes_have_exact_sums(spark):
    """Five weighted flows are added exactly and divided once, so the order of the sum, which SQL leaves open, does not matter."""
    from pyspark.sql import functions as F

    from sightline.functions import geometry as g
    from sightline.operators import series

    flow = lambda x, y: (F.pmod(x * 37 + y * 11, F.lit(201)) - 100, F.pmod(x * 17 + y * 29, F.lit(201)) - 100)
    corners = np.random.default_rng(3).uniform(0.3, 0.6, (500, 4)) * [0, 0, 1, 1]
    boxes = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "i int, x0 double, y0 double, x1 double, y1 double")
    got = boxes.select("i", *[c.alias(f"to_{s}") for s, c in series.predicted_box(g.box(), flow, 80, 45).items()]).collect()
    for r in got:
        x0, y0, x1, y1 = map(float, corners[r.i])
        eighths = 0
        for fx, fy, n in ((0.5, 0.5, 4), (0.35, 0.5, 1), (0.65, 0.5, 1), (0.5, 0.35, 1), (0.5, 0.65, 1)):
            ix, iy = int((x0 * fx + x1 * (1 - fx)) * 80 + 0.5), int((y0 * fy + y1 * (1 - fy)) * 45 + 0.5)
            eighths += n * ((ix * 37 + iy * 11) % 201 - 100)
        assert r.to_x0 == min(1.0, max(0.0, x0 - eighths / 8 / 10240.0))


def test_no_resampled_value_is_left_out(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = both(spark, "resampled_audio", tmp_path, "embeddings")
    assert len(got) == 3000 * 48 and got == want


@pytest.mark.parametrize("name", ["pcap_ranges", "pcap_scan"])
def test_packet_times_wrap(spark, tmp_path, name):
    """event_id * 3000 beyond 32 bits: a packet's time is its last 32."""
    put_events(spark, tmp_path, [(1_431_600 + i, 7) for i in range(200)])
    got, want = both(spark, name, tmp_path, "events")
    assert got == want and len(got) > 100


def test_small_ranges_share_tasks_and_reads(spark, tmp_path, monkeypatch):
    """Tasks don't grow with the number of ranges, and a record's search reads no piece again."""
    from sightline.sources import ranged

    data = b"".join(b"\0\0\1\x41" + bytes([1 + i % 200]) * 20 for i in range(4000))
    (tmp_path / "v.264").write_bytes(data)
    df = ranged.loaded(spark, ranged.AnnexB, str(tmp_path), 16)
    assert df.rdd.getNumPartitions() < 2 * ranged.MOST_TASKS
    assert [r.offset for r in df.orderBy("path", "range_no", "place").collect()] == [24 * i for i in range(4000)]
    read = []
    file = ranged.Bytes(str(tmp_path / "v.264"))
    real = file.file
    file.file = type("Counted", (), {"read_at": lambda self, n, at: read.append(n) or real.read_at(n, at)})()
    ranges = [ranged.FileRange("v", i, a, min(a + 16, len(data)), len(data)) for i, a in enumerate(range(0, len(data), 16))]
    found = [nal for r in ranges for _, nal in ranged.AnnexB({}).rows(file, r)]
    assert len(found) == 4000 and sum(read) <= 2 * len(data)


def test_plain_frames_and_their_general_form():
    """The common layout is read by a pattern: the same as the general parser, and far faster."""
    import time

    from sightline.sources import yaml_tracks

    item = lambda i, c="person": f"    '{i}':\n      box: [0.1, {i / 7}, 3, 4.5e-3]\n      class: {c}\n      conf: 0.{i}\n"
    frames = ["- frame_time: 0.5\n  objects: {}\n", "- frame_time: 7\n  objects:\n" + item(1) + item(2, "7") + item(3, "a b "), "- frame_time: 1.5\n  objects:\n" + item(4).replace("'", '"'), "- frame_time: 1.5\n  objects:\n" + item(5).replace("class: person", "class: 'x: y'"), "- frame_time: 2\n  objects:\n" + item(1, "a") + item(1, "b"), "- frame_time: 0.5\n  objects:\n" + item(8).rstrip("\n"), "- frame_time: 0.5\n  objects:\n" + item(8, "~")]
    for f in frames:
        assert yaml_tracks.parsed(f.encode()) == yaml_tracks.general(f.encode())
    long = ("- frame_time: 1.5\n  objects:\n" + "".join(map(item, range(3000)))).encode()
    took = []
    for f in (yaml_tracks.parsed, yaml_tracks.general):
        start = time.perf_counter()
        f(long)
        took.append(time.perf_counter() - start)
    assert took[0] * 3 < took[1]


@pytest.mark.parametrize("n", [7, 40, 900, 1 << 20])
def test_json_track_files_in_ranges(spark, tmp_path, n):
    """A frame at a time gives what the whole file gives; marks in text are none."""
    import json

    from sightline.sources import labels

    objects = lambda k: {str(10 * k + i): {"box": [0.1, k / 7, 3, 4], "class": '{"frame_time": 1' if k % 3 else "p", **({"conf": 0.25} if i else {})} for i in range(k % 4)}
    doc = {"metadata": {"classes": ["p"], "frame_rate": 2, "width": 1, "height": 1, "original_video": 'a{"frame_time":'}, "frames": [{"frame_time": k / 2, "objects": objects(k)} for k in range(40)]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({**doc, "frames": doc["frames"][5:]}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({**doc, "frames": []}))
    whole, got = labels.read_trackset(spark, str(tmp_path)), labels.read_trackset(spark, str(tmp_path), n)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.select(*whole.columns).collect())) and got.count() > 100
    (tmp_path / "d.json").write_text('{"frames": [{"objects": {}, "frame_time": 1}]}')
    with pytest.raises(Exception, match="read the file whole"):
        labels.read_trackset(spark, str(tmp_path), n).collect()


def test_a_micro_batch_is_objects_a_slice_at_a_time():
    import pandas as pd

    from sightline.operators.fold import Step
    from sightline.streaming import drivers

    class Sum(Step):
        total = 0.0

        def push(self, row):
            self.total += row["v"] or 0.0
            yield {"i": row["i"], "total": self.total}

    n = 3 * drivers.SLICE + 5
    frame = pd.DataFrame({"i": range(n), "v": [None if k % 7 == 0 else float(k) for k in range(n)]})
    parts = list(drivers.pushed(Sum(), frame))
    assert [len(p) for p in parts] == [drivers.SLICE] * 3 + [5]
    step = Sum()
    assert [r for p in parts for r in p] == [r for row in frame.astype(object).where(frame.notna(), None).to_dict("records") for r in step.push(row)]


def walkers(n, frames):
    """Frames of n people who walk side by side."""
    for k in range(frames):
        yield {"frame_no": k, "t": k * 0.2, "dets": [{"det_id": 100 * k + j, "cl": 0, "conf": 0.9, "x0": 0.04 * j + 0.001 * k, "y0": 0.2, "x1": 0.04 * j + 0.03 + 0.001 * k, "y1": 0.3 + 0.01 * j} for j in range(n)]}


def test_a_frames_filters_are_one():
    """The filters of all tracks of a frame go by arrays, to the same numbers: a frame costs less than its tracks' own filters."""
    import time

    from sightline.operators import trackers

    rows, own = None, []
    took = [0.0, 0.0]
    tracker = trackers.CascadeTracker()
    for row in walkers(20, 40):
        boxes = [tuple(d[c] for c in ("x0", "y0", "x1", "y1")) for d in row["dets"]]
        if rows is None:
            rows, own = trackers.Filters.started(boxes), [trackers.BoxFilter(np.array(b), row["t"]) for b in boxes]
        start = time.perf_counter()
        predicted = [f.predict(row["t"]) for f in own]
        for f, b in zip(own, boxes, strict=True):
            f.update(np.array(b), row["t"])
        took[0] += time.perf_counter() - start
        dt = [0.2 * trackers.BoxFilter.RATE if row["frame_no"] else 0.0] * 20
        rows = trackers.Filters.ahead(rows, dt)
        assert np.allclose(trackers.Filters.boxes(rows), predicted, rtol=1e-4, atol=1e-5)
        rows = trackers.Filters.corrected(trackers.Filters.ahead(rows, dt), boxes)
        for f, r in zip(own, rows, strict=True):
            assert np.allclose(f.filter.mean, r[:8], rtol=1e-4, atol=1e-5) and np.allclose(f.filter.cov, trackers.Filters.matrix(r), rtol=1e-3, atol=1e-7)
            assert (trackers.Filters.of(r[:8], trackers.Filters.matrix(r).ravel()) == r).all()
        start = time.perf_counter()
        out = list(tracker.push(row))
        took[1] += time.perf_counter() - start
        assert len(out) == 20 and len({r["track_id"] for r in out}) == 20
    assert took[1] < took[0]


def test_boxes_without_height_or_numbers_are_no_candidates():
    from sightline.operators import trackers

    t = trackers.CascadeTracker()
    odd = [(0.1, 0.2, 0.3, 0.2), (0.1, None, 0.3, 0.4), (0.1, 0.2, float("nan"), 0.4), (0.5, 0.5, 0.7, 0.9)]
    frames = [list(t.push({"frame_no": k, "t": k * 0.2, "dets": [{"det_id": 10 * k + j, "cl": 0, "conf": 0.9, **dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))} for j, b in enumerate(odd)]})) for k in range(5)]
    assert [r["observations"] for f in frames for r in f if r["det_id"] is not None and r["det_id"] % 10 == 3] == [1, 2, 3, 4, 5]
    assert {r["observations"] for f in frames for r in f if r["det_id"] is not None and r["det_id"] % 10 < 3} == {1}


def test_few_pairs_and_many_are_matched_alike(monkeypatch):
    from sightline.operators import trackers

    runs = []
    for few in (0, 1 << 30):
        monkeypatch.setattr(trackers.CascadeTracker, "FEW", few)
        t = trackers.CascadeTracker()
        runs.append([r for row in walkers(12, 25) for r in t.push({**row, "dets": [d for d in row["dets"] if (d["det_id"] * 7) % 11 > 2]})])
    assert runs[0] == runs[1] and len(runs[0]) > 200


def test_batches_become_objects_by_columns():
    import pyarrow as pa

    from sightline.operators.fold import values_of

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.float64()), ("c", pa.list_(pa.struct([("x", pa.float32()), ("s", pa.string())])))]))
    data = pa.array([[{"a": 1, "b": 2.5, "c": [{"x": 1.5, "s": "q"}, None]}], None, [], [None, {"a": None, "b": 1.0, "c": None}, {"a": 3, "b": float("inf"), "c": []}]], kind)
    for at in range(5):
        for n in range(5 - at):
            assert values_of(data.slice(at, n)) == data.slice(at, n).to_pylist()
    for other in (pa.array([True, None]), pa.array([b"x", None]), pa.array([1, None], pa.int32()), pa.array([], pa.float64())):
        assert values_of(other) == other.to_pylist()


def test_planes_of_a_stack_are_blurred_at_once():
    """The same bytes as a sum of shifted planes in wide integers, for less: no plane is padded, and sums are of 16 bits."""
    import time

    from sightline.functions import pixels

    def plain(plane):
        k, p = (1, 4, 6, 4, 1), np.pad(plane.astype(np.int32), 2, mode="edge")
        rows = sum(c * p[i : i + len(plane)] for i, c in enumerate(k))
        return ((sum(c * rows[:, i : i + plane.shape[1]] for i, c in enumerate(k)) + 128) >> 8).astype(np.uint8)

    rng = np.random.default_rng(5)
    planes = [rng.integers(0, 256, (16, 32), np.uint8) for _ in range(300)] + [np.full((16, 32), 255, np.uint8), rng.integers(254, 256, (1, 3), np.uint8)]
    took = [0.0, 0.0]
    for p in planes:
        start = time.perf_counter()
        want = plain(p)
        took[0] += time.perf_counter() - start
        start = time.perf_counter()
        got = pixels.blur(p)
        took[1] += time.perf_counter() - start
        assert (got == want).all() and (pixels.blur(np.stack([p, p[::-1]])) == [want, plain(p[::-1])]).all()
    assert took[1] * 1.3 < took[0]
    a, b = np.stack(planes[:2]), np.stack(planes[2:4])
    assert (pixels.mad_4x4(a, b) == [pixels.mad_4x4(x, y) for x, y in zip(a, b, strict=True)]).all()


def test_a_pipelines_frames_cost_less_than_their_filters():
    """As test_a_frames_filters_are_one, through the pipeline of a stream."""
    import time

    from sightline.operators import trackers
    from sightline.operators.pipeline import StreamPipeline

    frames = list(walkers(20, 40))
    pipeline, own = StreamPipeline(0.1), [trackers.BoxFilter(np.array([0.1, 0.2, 0.3, 0.4]), 0.0) for _ in range(20)]
    start = time.perf_counter()
    out = [r for row in frames for r in pipeline.push(row)]
    took = time.perf_counter() - start
    start = time.perf_counter()
    for row in frames:
        for f in own:
            f.predict(row["t"])
            f.update(np.array([0.1, 0.2, 0.3, 0.4]), row["t"])
    assert took < time.perf_counter() - start
    assert [len(r["tracks"]) for r in out] == [20] * 40


@pytest.mark.parametrize("scan", ["pipeline", "cascade"])
def test_each_stream_has_a_task(spark, scan):
    """A hash puts some of few streams into one task, which then takes as long as all of them."""
    from pyspark.sql import functions as F

    from sightline.operators.pipeline import track_streams
    from sightline.operators.trackers import track

    frames = spark.range(1600).selectExpr("id % 8 AS stream_id", "id div 8 AS frame_no", "(id div 8) * 0.5D AS t", "array(named_struct('det_id', id, 'cl', 0, 'conf', 0.9D, 'x0', 0.1D, 'y0', 0.1D, 'x1', 0.3D, 'y1', 0.3D)) AS dets", "0.1D AS area")
    rows = {"pipeline": track_streams, "cascade": track}[scan](frames)
    found = rows.select("stream_id", F.spark_partition_id().alias("task")).groupBy("stream_id", "task").count().collect()
    assert sorted((r.stream_id, r["count"]) for r in found) == [(k, 200) for k in range(8)]
    assert len({r.task for r in found}) == 8


def test_label_files_are_capped_without_a_shuffle(spark, tmp_path):
    from sightline.sources import labels

    good = [f"{k % 3} 0.5 0.5 0.2 {k / 1000}" for k in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(x for k, line in enumerate(good) for x in ([line, "1 2", ""] if k % 2 else [line])) + "\n")
    (tmp_path / "b.txt").write_text("1 .5 .5 .2 .4 x 7\nnone\n\n 2\t.5  .5 .2 .4 \r\n1 0.5 x 0.5 0.5 0.5\n")
    (tmp_path / "c.txt").write_text("")
    df = labels.read_labels(spark, str(tmp_path))
    rows = sorted((r.path[-5:], r.line_no, r.cl, round(r.y1 - r.y0, 6)) for r in df.collect())
    places = [k // 2 * 4 + k % 2 for k in range(labels.MOST_LABELS)]
    assert rows == [("a.txt", place, k % 3, k / 1000) for k, place in enumerate(places)] + [("b.txt", 0, 1, 0.4), ("b.txt", 3, 2, 0.4)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_label_files_share_a_folder(spark, monkeypatch):
    """Files grow with the input, folders to list don't."""
    from sightline.sources import labels

    read, seen = labels.read_labels, []
    monkeypatch.setattr(labels, "read_labels", lambda spark, path: seen.append(path) or read(spark, path))
    assert QUERIES["labels_scan"](spark, "/root/testdata/sf0.001").count() > 0
    assert "*" not in seen[0]
    assert {r.path.rsplit("/", 1)[0].split("/")[-1] for r in read(spark, seen[0]).select("path").distinct().collect()} == {seen[0].split("/")[-1]}
