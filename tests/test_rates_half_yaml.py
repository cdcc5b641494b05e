"""Half precision, latency percentiles, observed counters, YAML track files, WAV files by the sink."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors as v
from sightline.operators import matching, series
from sightline.sources import audio, labels, yaml_tracks
from sightline.streaming import drivers, observed, states


def test_half_equals_numpy(spark):
    rng = np.random.default_rng(1)
    edge = [0.0, -0.0, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 2.0**-26, 6e-8, 2.0**-14, 2.0**-14 - 2.0**-25, 1 + 2.0**-11, 1 + 3 * 2.0**-11, 65504.0, 65519.9, 65520.0, -65520.0, 1e30, np.inf, -np.inf]
    edge += [x for k in range(-16, 17) for x in (np.nextafter(2.0**k, 0), 2.0**k, np.nextafter(2.0**k, 9e9))]
    x = np.concatenate([edge, rng.normal(size=2000) * 2.0 ** rng.integers(-28, 18, 2000)])
    got = spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "i long, x double").select("i", v.half(F.col("x")).alias("h")).orderBy("i").collect()
    with np.errstate(over="ignore"):
        assert [r.h for r in got] == x.astype(np.float16).astype(np.float64).tolist()
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(v.half(F.col("x")).alias("h")).collect()[0].h is None


def test_ties_of_half_scores_go_by_id(spark):
    # 0.50001 and 0.50002 are one half; the two boxes overlap
    rows = [(0, 0, 0, 1, 0.50001, 0.1, 0.1, 0.3, 0.3), (0, 0, 0, 2, 0.50002, 0.1, 0.1, 0.3, 0.31), (0, 0, 0, 3, 0.4, 0.7, 0.7, 0.7, 0.7), (0, 0, 0, 4, 0.3, 0.7, 0.7, 0.7, 0.7)]
    df = spark.createDataFrame(rows, "stream_id long, frame_no long, cl int, det_id long, conf double, x0 double, y0 double, x1 double, y1 double")
    ids = lambda d: sorted(r.det_id for r in d.collect())
    assert ids(matching.suppress(df, 0.45)) == [2, 3, 4] and ids(matching.suppress_half(df, 0.45)) == [1, 3, 4] and ids(matching.suppress_half(df, 0.45, most=1)) == [1]


def test_percentiles_are_within_a_bin(spark):
    rng = np.random.default_rng(3)
    data = [(s, i + 1, float(abs(rng.normal(0.2 + s / 20, 0.05))), bool(rng.random() < 0.25)) for s in range(4) for i in range(2000)]
    df = spark.createDataFrame(data, "stream_id long, i long, latency double, skipped boolean")
    rates = {r.stream_id: r for r in series.stream_rates(df, 10.0).collect()}
    for s in range(4):
        own = np.array([x[2] for x in data if x[0] == s])
        # the last samples weigh most: a half-life of 50 decays, one each 10 samples
        age = (2000 // 10) - np.arange(1, 2001) // 10
        order, weight = np.argsort(own), 0.5 ** (10 * age / 50)
        cum = np.cumsum(weight[order]) / weight.sum()
        for p, got in ((0.5, rates[s].p50), (0.9, rates[s].p90)):
            assert abs(own[order][np.searchsorted(cum, p)] - got) <= 1 / 40
        assert rates[s].ran + rates[s].skipped == 2000 and rates[s].fps == rates[s].ran / 10
    modes = spark.createDataFrame([(0, 6), (1, 3), (2, 1)], "mode int, n long")
    (one,) = series.realtime_summary(series.stream_rates(df, 10.0), modes).collect()
    assert one.streams == 4 and abs(one.fps_total - sum(r.fps for r in rates.values())) < 1e-9 and abs(one.mode0 - 0.6) < 1e-6


def test_observed_counters_equal_a_group_by(spark):
    data = [(i % 3, i, i % 7 == 0, float(i)) for i in range(500)]
    df = spark.createDataFrame(data, "stream_id long, n long, late boolean, x double")
    stats = observed.Stats()
    spark.streams.addListener(stats)
    try:
        stream = observed.counted(states.replayed(df, "n", 3), "packets", n_late=F.col("late"), total=F.sum("x"))
        seen = []
        query = drivers.watched(stream, lambda rows, b: seen.append(rows.count()))
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        name = str(query.id)
        for _ in range(100):
            if stats.totals(name).get("input", {}).get("rows") == 500:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(stats)
    got = stats.totals(name)
    assert sum(seen) == 500 and got["packets"] == {"rows": 500, "n_late": len([1 for r in data if r[2]]), "total": sum(r[3] for r in data)}
    table = stats.table(spark).where("name = 'packets' AND key = 'rows'")
    assert table.count() >= 3 and table.agg(F.sum("value")).first()[0] == 500
    assert "  packets:\n    n_late: 72\n    rows: 500\n" in stats.yaml(name)


YAML = """# made by hand
metadata:
  classes: [person, face]
  frame_rate: 25.0
  width: 640
  height: 480
  original_video: 'a: b.mp4'
frames:
- frame_time: 0.0
  objects:
    '1': {}
- frame_time: 0.04
  objects:
    '1':
      box: [0.1, 0.2, 0.3, 0.4]
      class: 0
      conf: 0.9
    10001:
      box:
      - 0.5
      - 0.6
      - 0.7
      - 0.8
      class: face
- objects: {}
  frame_time: 0.08
-
  frame_time: 0.12
  objects:
    "7":
      class: 1
      conf: 1
      box: [1, 2, 3, 4]
""".replace("    '1': {}\n", "    '5':\n      box: [0, 0, 1, 1]\n      class: 0\n")


@pytest.mark.parametrize("range_bytes", [20, 97, 1 << 20])
@pytest.mark.parametrize("indent", ["", "  "])
def test_yaml_track_files_in_ranges(spark, tmp_path, range_bytes, indent):
    head, frames = YAML.split("frames:\n")
    (tmp_path / "a.yaml").write_text(head + "frames:\n" + "".join(indent + x for x in frames.splitlines(True)))
    (tmp_path / "b.yaml").write_text("frames: []\n")
    rows = sorted(tuple(r)[1:] for r in labels.read_yaml_trackset(spark, str(tmp_path), range_bytes).collect())
    assert rows == [(0, 0.0, 5, "0", 1.0, 0.0, 0.0, 1.0, 1.0), (1, 0.04, 1, "0", 0.9, 0.1, 0.2, 0.3, 0.4), (1, 0.04, 10001, "face", 1.0, 0.5, 0.6, 0.7, 0.8), (3, 0.12, 7, "1", 1.0, 1.0, 2.0, 3.0, 4.0)]


def test_yaml_blocks():
    text = "a: 1\nb:\n- x\n- c: 'd: e'\n  f: [1, two]\ng: {}\n"
    assert yaml_tracks.block(yaml_tracks.lines_of(text)) == {"a": 1, "b": ["x", {"c": "d: e", "f": [1, "two"]}], "g": {}}
    assert yaml_tracks.block(yaml_tracks.lines_of("a:\n  '1':\n    box: [0.5]\n  2: ~\n")) == {"a": {"1": {"box": [0.5]}, "2": None}}


def test_wav_files_by_the_sink(spark, tmp_path):
    x = {s: np.sin(np.arange(700 + s) / (5 + s)).astype(np.float32) for s in (1, 2)}
    chunks = spark.createDataFrame([(s, k, 8000, 1, a[k * 100 : (k + 1) * 100].tolist()) for s, a in x.items() for k in range(8)], "stream_id long, chunk_no long, sample_rate int, num_channels int, samples array<float>").repartition(5)
    audio.write_wavs(chunks, f"file://{tmp_path}/w")
    for s, a in x.items():
        assert (tmp_path / "w" / f"{s}.wav").read_bytes() == audio.write_wav(8000, 1, a)
