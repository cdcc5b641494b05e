"""Scans in blocks give what steps give row by row, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import scan, series, steps


def rows_of(n, seed=1):
    """One long key, a short one and the null key: values, jumping times, areas, sources."""
    rng = random.Random(seed)
    out = []
    for key, size in (("long", n), ("short", 37), (None, 5), ("mid", n // 3)):
        t, ssrc = 100.0, 1
        for i in range(size):
            t += rng.choice([0.0, 0.01, 0.04, 0.04, 0.2, 0.6])
            t += rng.choice([0] * 60 + [-30, -0.3, 11, 9.99, 10.02, 500])
            ssrc = rng.choice([ssrc] * 30 + [1, 2, 3])
            out.append((key, i, rng.choice([3.0, 4.5, 9.0, 30.0, 250.0]) * rng.random(), t, rng.choice([0.005, 0.02, 0.03, 0.04, 0.06]), ssrc, rng.random() > 0.1))
    return out


SCHEMA = "k string, i long, v double, t double, area double, ssrc long, has_image boolean"
LAWS = [
    (scan.RunningMean(), steps.RunningMean, ["mean"]),
    (scan.NoiseFloor(), steps.NoiseFloor, ["floor", "motion"]),
    (scan.MotionSkip(), steps.MotionSkip, ["skipped"]),
    (scan.Throttle(0.5), lambda: steps.Throttle(0.5), ["kept"]),
    (scan.Throttle(0.0), lambda: steps.Throttle(0.0), ["kept"]),
    (scan.Throttle(3.0), lambda: steps.Throttle(3.0), ["kept"]),
    (scan.DecoderThrottle(0.3), lambda: steps.DecoderThrottle(0.3), ["kept"]),
    (scan.SourceSwitch(), steps.SourceSwitch, ["accepted"]),
]


def walked(rows, make, columns):
    names = SCHEMA.replace(",", "").split()[::2]
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        step = state.setdefault(r[0], make())
        (got,) = step.push(dict(zip(names, r, strict=True)))
        out[r[0], r[1]] = [got[c] for c in columns]
    return out


def agree(a, b):
    return a.keys() == b.keys() and all(x == y if isinstance(x, bool) else abs(x - y) <= 1e-9 * max(1, abs(y)) for k in a for x, y in zip(a[k], b[k], strict=True))


@pytest.mark.parametrize("law, make, columns", LAWS)
@pytest.mark.parametrize("size", [1, 7, 100])
def test_summaries_compose(law, make, columns, size):
    """Laws alone, without Spark: blocks of any size, run from the composed states."""
    for seed in range(8):
        rows = [r for r in rows_of(600, seed) if r[0] == "long"]
        names = SCHEMA.replace(",", "").split()[::2]
        lists = lambda part: {c: [r[names.index(c)] for r in part] for c in law.reads}
        state, got = law.start(), {}
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            out = law.run(lists(part), at, state)
            for k, r in enumerate(part):
                got[r[0], r[1]] = [out[c][k] for c in columns]
            state = law.after(state, law.summary(lists(part), at))
        assert agree(got, walked(rows, make, columns))


@pytest.mark.parametrize("law, make, columns", LAWS[:4] + LAWS[6:])
def test_one_key_in_many_tasks(spark, law, make, columns):
    rows = rows_of(2000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = walked(rows, make, columns)
    for block_rows in (200, 10_000):
        out = scan.scanned(df, ["k"], ["i"], law, block_rows)
        assert agree({(r.k, r.i): [r[c] for c in columns] for r in out.collect()}, want)
        assert out.columns == [*df.columns, *law.adds]
    assert scan.scanned(df.limit(0), ["k"], ["i"], law).count() == 0


def test_a_long_key_is_cut(spark):
    df = spark.createDataFrame(rows_of(2000), SCHEMA)
    out = scan.scanned(df, ["k"], ["i"], scan.RunningMean(), 200)
    files = [f for f in out.inputFiles() if "/blocks-" in f]
    blocks = spark.read.parquet(files[0].rsplit("/", 1)[0])
    sizes = {(r.k, r._block): r._n for r in blocks.collect()}
    long = [n for (k, _), n in sizes.items() if k == "long"]
    assert len(long) >= 8 and max(long) <= 500 and sum(long) == 2000
    assert [n for (k, _), n in sizes.items() if k == "short"] == [37]


def packets(n=900, streams=3):
    rng = random.Random(4)
    out = []
    for s in range(streams):
        arrivals = sorted(range(n), key=lambda q: q + rng.choice([0, 0, 0, 2.5, 40.5]))
        out += [(s, a, q, (65_000 + q) % 65_536, (4_294_960_000 + 3000 * (q // 4)) % (1 << 32), q % 4 == 3) for a, q in enumerate(arrivals) if rng.random() > 0.03]
    return out


@pytest.mark.parametrize("width", [7, 100])
def test_counters_and_units_in_blocks(spark, width):
    df = spark.createDataFrame(packets(), "stream_id long, arrival_no long, seq_no long, seq16 long, ts32 long, marker boolean").repartition(3)
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    wide = 1 << 30
    seq = series.unwrapped(df, width)
    assert same(seq, series.unwrapped(df, wide)) and seq.where("seq_ext - seq_no <> 65000").count() == 0
    ts = series.extended(df, "seq_no", width)
    assert same(ts, series.extended(df, "seq_no", wide)) and ts.where("ts64 <> 4294960000 + 3000 * (seq_no div 4)").count() == 0
    units = series.access_units(ts.withColumn("seq_ext", F.col("seq_no")), width)
    assert same(units, series.access_units(ts.withColumn("seq_ext", F.col("seq_no")), wide)) and units.count() > 600
    assert same(series.sample_durations(units, width=width), series.sample_durations(units, width=wide))
    assert same(series.loss_stats(df, width), series.loss_stats(df, wide))
