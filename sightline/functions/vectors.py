"""Vectors as array columns: products, norms, softmax, face-quality marginals, scores and rates of audio chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes of the axes of the face-quality output, and the weight of each step of its last axis.
FIQA_AXES = [3, 2, 3, 2, 2, 5]
FIQA_STEPS = [0.0, 0.25, 0.5, 0.75, 1.0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(v: Column, k) -> Column:
    return F.transform(v, lambda x: x * F.lit(k) if not isinstance(k, Column) else x * k)


def once(value: Column, use) -> Column:
    """use(value), the value computed once: a lambda's own variable, where an expression would be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def l2_normalized(v: Column) -> Column:
    """v over its length; the zero vector stays."""
    over = lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(0.0))
    return once(v, lambda w: once(F.struct(w.alias("v"), F.sqrt(dot(w, w)).alias("n")), over))


def centered(rows: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """rows with `centered`: the vector less its group's mean, L2-normalised. Means are per dimension, over (count + 1e-7); every task sums its own rows first, a row a group."""
    from pyspark.sql.pandas.types import to_arrow_schema

    narrow = rows.select(*keys, vector)
    kind = narrow.select(*keys).schema.add("_sum", T.ArrayType(T.DoubleType())).add("_n", "long")
    schema = to_arrow_schema(kind)

    def sums(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in keys]
            for i, x in enumerate(batch.column(vector).to_pylist()):
                if x is not None:
                    one = held.setdefault(tuple(c[i] for c in names), [np.zeros(len(x)), 0])
                    one[0] += np.asarray(x, np.float64)
                    one[1] += 1
        yield pa.RecordBatch.from_pylist([{**dict(zip(keys, k, strict=True)), "_sum": x.tolist(), "_n": n} for k, (x, n) in held.items()], schema)

    partial = narrow.mapInArrow(sums, kind)
    total_of = F.aggregate(F.collect_list("_sum"), F.expr("CAST(array() AS array<double>)"), lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda a, b: a + b)))
    means = partial.groupBy(*keys).agg(total_of.alias("_sum"), F.sum("_n").alias("_n"))
    means = means.select(*keys, F.transform("_sum", lambda x: x / (F.col("_n") + F.lit(1e-7))).alias("_mean"))
    both = rows.join(means, keys) if keys else rows.withColumn("_one", F.lit(1)).join(F.broadcast(means.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return both.withColumn("centered", l2_normalized(F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m))).drop("_mean")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def softmax(v: Column) -> Column:
    powers = once(v, lambda w: once(F.struct(w.alias("w"), F.array_max(w).cast("double").alias("top")), lambda s: F.transform(s["w"], lambda x: F.exp(x.cast("double") - s["top"]))))
    return once(powers, lambda w: once(F.struct(w.alias("w"), total(w).alias("t")), lambda s: F.transform(s["w"], lambda x: x / s["t"])))


def marginal(p: Column, axis: int, sizes: list[int]) -> Column:
    """Sums over all axes but one of a flat array (last axis fastest)."""
    inner = 1
    for s in sizes[axis + 1 :]:
        inner *= s
    k = sizes[axis]
    indexed = F.transform(p, lambda x, i: F.struct(x.alias("x"), F.pmod(F.floor(i / inner).cast("int"), F.lit(k)).alias("k")))
    share = lambda w, j: F.aggregate(w, F.lit(0.0), lambda a, e: a + F.when(e["k"] == j, e["x"]).otherwise(0.0))
    return once(indexed, lambda w: F.array(*[share(w, j) for j in range(k)]))


def fiqa_quality(logits: Column, sizes: list[int] = FIQA_AXES, steps: list[float] = FIQA_STEPS) -> Column:
    return dot(marginal(softmax(logits), len(sizes) - 1, sizes), F.array(*map(F.lit, steps)))


def attribute_score(attrs: Column, weights: list[float]) -> Column:
    """Weighted mean of min(1, 1.2 a); a weight is the number in the attribute's name + 0.1."""
    w = F.array(*[F.lit(x + 0.1) for x in weights])
    return dot(F.transform(attrs, lambda a: F.least(F.lit(1.0), a.cast("double") * 1.2)), w) / total(w)


def top_k(rows: DataFrame, keys: list[str], vector: str, k: int) -> DataFrame:
    """keys, rank, class, prob: the k largest sigmoids of each vector; the lower class of equals. Sorting is inside a row."""
    probs = F.transform(vector, lambda x, i: F.struct((-sigmoid(x.cast("double"))).alias("p"), i.alias("class")))
    ranked = rows.select(*keys, F.posexplode(F.slice(F.array_sort(probs), 1, k)).alias("rank", "e"))
    return ranked.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("e.class").alias("class"), (-F.col("e.p")).alias("prob"))


def nearest(queries: DataFrame, prompts: DataFrame, k: int, query: str = "vec_id", prompt: str = "prompt_id", block: int = 4096) -> DataFrame:
    """The k prompts of the largest cosine for each query, the lower id of equals.

    Prompts are collected and broadcast `block` at a time, by hash; within a
    block, a query row finds its best by itself, without a shuffle. Each block
    is a scan of its own, and the best of blocks meet by query, so a task holds
    one block whatever the number of prompts.
    """
    spark = queries.sparkSession
    units = prompts.where("embedding IS NOT NULL").select(F.col(prompt).cast("long").alias("p"), l2_normalized(F.col("embedding")).alias("u"))
    blocks = -(-units.count() // block) or 1
    asked = queries.where("embedding IS NOT NULL").select(query, l2_normalized(F.col("embedding")).alias("_q"))
    kind = asked.select(query).schema.add("_best", T.ArrayType(T.StructType([T.StructField("c", T.DoubleType()), T.StructField("p", T.LongType())])))
    found = []
    for b in range(blocks):
        part = units.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).collect()
        if part:
            found.append(asked.mapInArrow(_nearer(spark.sparkContext.broadcast((np.array([x.p for x in part], np.int64), np.array([x.u for x in part], np.float64))), k), kind))
    if not found:
        return spark.createDataFrame([], kind).select(query, F.lit(1).alias("rank"), F.lit(0).cast("long").alias(prompt), F.lit(0.0).alias("cosine"))
    best = found[0]
    if len(found) > 1:
        for more in found[1:]:
            best = best.unionByName(more)
        # k rows a query and block
        first = F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("_best")), lambda e: F.struct((-e["c"]).alias("c"), e["p"].alias("p")))), 1, k)
        best = best.groupBy(query).agg(F.transform(first, lambda e: F.struct((-e["c"]).alias("c"), e["p"].alias("p"))).alias("_best"))
    ranked = best.select(query, F.posexplode("_best").alias("rank", "e"))
    return ranked.select(query, (F.col("rank") + 1).alias("rank"), F.col("e.p").alias(prompt), F.col("e.c").alias("cosine"))


def _nearer(held, k: int):
    """Each row's best among the held vectors."""

    def run(batches):
        ids, u = held.value
        for batch in batches:
            q = np.array(batch.column("_q").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            c = np.zeros((len(q), len(ids)))
            for i in range(u.shape[1] if len(q) else 0):  # in the order of the elements, so that equal vectors have equal products
                c += q[:, i, None] * u[None, :, i]
            order = np.lexsort((np.broadcast_to(ids, c.shape), -c), axis=1)[:, :k]
            best = [[{"c": float(row[j]), "p": int(ids[j])} for j in at] for row, at in zip(c, order, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.list_(pa.struct([("c", pa.float64()), ("p", pa.int64())])))], [batch.schema.names[0], "_best"])

    return run


def searched(queries: DataFrame, rows: DataFrame, k: int, query: str = "query_id", row: str = "vec_id", block: int = 4096) -> DataFrame:
    """The k rows of the largest cosine for each query, the lower id of equals. Queries are broadcast a block at a time; each task keeps its k best."""
    spark, schema = rows.sparkSession, "q long, c double, r long"
    units = rows.where("embedding IS NOT NULL").select(F.col(row).cast("long").alias("r"), l2_normalized(F.col("embedding")).alias("u"))
    asked = queries.where("embedding IS NOT NULL").select(F.col(query).cast("long").alias("q"), l2_normalized(F.col("embedding")).alias("u"))
    blocks = -(-asked.count() // block) or 1

    def best_of(part: list):
        held = spark.sparkContext.broadcast((np.array([x.q for x in part], np.int64), np.array([x.u for x in part], np.float64)))

        def run(batches):
            ids, q = held.value
            c, r = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for frame in batches:
                for at in range(0, len(frame), 1024):
                    some = frame.iloc[at : at + 1024]
                    u = np.stack(some["u"].to_numpy()).astype(np.float64)
                    product = np.zeros((len(ids), len(u)))
                    for i in range(u.shape[1]):  # in the order of the elements, so that equal vectors have equal products
                        product += q[:, i, None] * u[None, :, i]
                    c, r = np.hstack([c, product]), np.hstack([r, np.broadcast_to(some["r"].to_numpy(), product.shape)])
                    order = np.lexsort((r, -c), axis=1)[:, :k]
                    c, r = np.take_along_axis(c, order, 1), np.take_along_axis(r, order, 1)
            yield pd.DataFrame({"q": np.repeat(ids, c.shape[1]), "c": c.ravel(), "r": r.ravel()})

        return units.mapInPandas(run, schema)

    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        found = found.unionByName(best_of(part)) if part else found
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "r"))), 1, k).alias("best"))
    ranked = best.select("q", F.posexplode("best").alias("rank", "e"))
    return ranked.select(F.col("q").alias(query), (F.col("rank") + 1).alias("rank"), F.col("e.r").alias(row), (-F.col("e.c")).alias("cosine"))


def audio_levels(samples: Column) -> dict[str, Column]:
    """peak, energy, rms and lufs (unweighted, ungated) of a chunk's samples."""
    energy = dot(samples, samples)
    n = F.size(samples)
    mean = F.try_divide(energy, n)
    return {
        "peak": F.aggregate(samples, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))),
        "energy": energy,
        "rms": F.coalesce(F.sqrt(mean), F.lit(0.0)),
        "lufs": F.when(n == 0, 0.0).when(mean <= 0, -90.0).otherwise(-0.691 + 10 * F.log10(F.greatest(mean, F.lit(1e-300)))),
    }


def remixed(samples: Column, n_in: int, n_out: int) -> Column:
    """Interleaved samples of n_in channels as n_out: copied, averaged, or averaged in proportional groups."""
    if n_in == n_out:
        return doubles(samples)
    groups = [[0] if n_in == 1 else list(range(n_in)) if n_out == 1 else list(range(c * n_in // n_out, max((c + 1) * n_in // n_out, c * n_in // n_out + 1))) for c in range(n_out)]
    frames = F.sequence(F.lit(0), F.floor(F.size(samples) / n_in).cast("int") - 1)
    mix = lambda f: F.array(*[sum((samples[(f * n_in + i).cast("int")].cast("double") for i in g[1:]), samples[(f * n_in + g[0]).cast("int")].cast("double")) / len(g) for g in groups])
    return F.when(F.size(samples) < n_in, F.array().cast("array<double>")).otherwise(F.flatten(F.transform(frames, mix)))


def half(x: Column) -> Column:
    """A number as the nearest of 16 bits (to even where two are as near), as a double: 11 bits from 2**-14 on, steps of 2**-24 below, infinity from 65520 on. Column expressions: powers of two and rint are exact."""
    size = F.abs(x.cast("double"))
    near = F.floor(F.log2(F.greatest(size, F.lit(2.0**-30)))).cast("double")
    # the logarithm may be off by one next to a power of two
    power = F.when(size < F.pow(F.lit(2.0), near), near - 1).when(size >= F.pow(F.lit(2.0), near + 1), near + 1).otherwise(near)
    step = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14.0)) - 10)
    rounded = F.rint(size / step) * step
    out = F.when(F.isnan(size), size).when(size >= 65520, F.lit(float("inf"))).otherwise(rounded)
    return F.when(x < 0, -out).otherwise(out)


def through_half(column: str) -> Column:
    """A vector of 32-bit floats rounded to 16 bits and back, by Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.asarray(a, np.float32).astype(np.float16).astype(np.float32))

    return run(column)
