"""Vector functions take each aggregate once: their time grows with the vector's length, not its square."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import vectors as v


@pytest.fixture(scope="module")
def long_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 1024)).astype(np.float32)
    x[3] = 0
    df = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], "vec_id long, label int, embedding array<float>").repartition(4).cache()
    df.count()
    return x.astype(np.float64), df


def test_values_of_long_vectors(long_vectors):
    x, df = long_vectors
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    want = {"unit": np.divide(x, norm, where=norm > 0, out=np.zeros_like(x)), "soft": np.exp(x - x.max(1, keepdims=True)) / np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)}
    got = df.select("vec_id", v.l2_normalized(F.col("embedding")).alias("unit"), v.softmax(F.col("embedding")).alias("soft")).collect()
    for r in got:
        assert np.allclose(r.unit, want["unit"][r.vec_id], atol=1e-12) and np.allclose(r.soft, want["soft"][r.vec_id], atol=1e-12)
    means = {k: x[np.arange(200) % 3 == k].sum(0) / ((np.arange(200) % 3 == k).sum() + 1e-7) for k in range(3)}
    for r in v.centered(df, "embedding", ["label"]).collect():
        c = x[r.vec_id] - means[r.label]
        assert np.allclose(r.centered, c / np.linalg.norm(c), atol=1e-12)


def test_time_is_linear_in_the_length(long_vectors):
    _, df = long_vectors
    for f in (v.l2_normalized, v.softmax):
        took = {}
        for n in (128, 1024):
            some = df.select(f(F.slice("embedding", 1, n)).alias("u"))
            some.write.format("noop").mode("overwrite").save()
            t = time.time()
            some.write.format("noop").mode("overwrite").save()
            took[n] = time.time() - t
        # quadratic work would take 64 times as long
        assert took[1024] < 16 * max(took[128], 0.1)


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],), ([3.0, 4.0],)], "e array<double>")
    assert [r.u for r in df.select(v.l2_normalized(F.col("e")).alias("u")).collect()] == [None, [], [0.0, 0.0], [0.6, 0.8]]
    assert [r.u for r in df.select(v.softmax(F.col("e")).alias("u")).collect()][:3] == [None, [], [0.5, 0.5]]


def test_nearest_in_blocks_is_one_stage_a_block(spark, long_vectors):
    _, df = long_vectors
    asked, prompts = df.where("vec_id % 10 = 1"), df.select(F.col("vec_id").alias("prompt_id"), "embedding")
    one, many = v.nearest(asked, prompts, 3), v.nearest(asked, prompts, 3, block=20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    # blocks are side by side: no MapInArrow has another below it
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in plan.splitlines() if "MapInArrow" in line or "PythonMapInArrow" in line]
    assert len(depth) >= 10 and len(set(depth)) <= 2
