"""Analytic operators over ordered series: windows, decayed histograms, rollups, block motion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE, EVERY, BINS = 50, 10, 40
DECAY = 0.5 ** (1.0 / HALF_LIFE)


def signed(x: Column, bits: int) -> Column:
    half = 1 << bits - 1
    return F.pmod(x + F.lit(half), F.lit(1 << bits)) - F.lit(half)


#: Rows of a series that one window walks. Where a key has more, series are cut into blocks of so many places of the order column, which windows walk side by side; what a block needs of those before it comes from a row a block.
WIDTH = 1 << 16


def cut(rows: DataFrame, key: str, width: int) -> int | None:
    """width, if a key has more rows than that: then its series must be cut."""
    most = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return width if (most or 0) > width else None


def _blocked(rows: DataFrame, key: str, order: str, width: int) -> tuple[DataFrame, Window]:
    return rows.withColumn("_b", F.floor(F.col(order) / width)), Window.partitionBy(key, "_b").orderBy(order)


def _with_carried(rows: DataFrame, key: str, summaries: list[Column], carried: list[Column]) -> DataFrame:
    """rows (of _blocked) with columns that a window over each block's summaries, in order of blocks, gives."""
    blocks = rows.groupBy(key, "_b").agg(*summaries)
    heads = blocks.select(F.col(key).alias("_key"), F.col("_b").alias("_block"), *carried)
    return rows.join(heads, rows[key].eqNullSafe(heads["_key"]) & (rows["_b"] == heads["_block"])).drop("_key", "_block")


def _over_blocks(key: str, to_here: bool = False) -> Window:
    w = Window.partitionBy(key).orderBy("_b")
    return w.rowsBetween(Window.unboundedPreceding, 0 if to_here else -1)


def extended_counter(rows: DataFrame, key: str, order: str, value: str, bits: int, name: str, width: int | None = None) -> DataFrame:
    """rows with a counter of so many bits unwrapped along `order`: each step is the least signed one. In blocks of width, if it is given; so for those below."""
    if not width:
        w = Window.partitionBy(key).orderBy(order)
        step = F.coalesce(signed(F.col(value) - F.lag(value).over(w), bits), F.lit(0))
        stepped = rows.withColumn("_step", step).withColumn("_first", F.first(value).over(w))
        return stepped.withColumn(name, (F.col("_first") + F.sum("_step").over(w)).cast("long")).drop("_step", "_first")
    blocks, w = _blocked(rows, key, order, width)
    inner = F.coalesce(signed(F.col(value) - F.lag(value).over(w), bits), F.lit(0))
    stepped = blocks.withColumn("_step", inner)
    summaries = [F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"), F.sum("_step").alias("_inner")]
    # a block's first number: that of the first block, the steps inside the blocks before it, and those between blocks
    whole = Window.partitionBy(key).orderBy("_b")
    between = F.coalesce(signed(F.col("_first") - F.lag("_last").over(whole), bits), F.lit(0))
    blocks = stepped.groupBy(key, "_b").agg(*summaries).withColumn("_between", between)
    base = F.first("_first").over(_over_blocks(key, True)) + F.coalesce(F.sum("_inner").over(_over_blocks(key)), F.lit(0)) + F.sum("_between").over(_over_blocks(key, True))
    heads = blocks.select(F.col(key).alias("_key"), F.col("_b").alias("_block"), base.alias("_base"))
    both = stepped.join(heads, stepped[key].eqNullSafe(heads["_key"]) & (stepped["_b"] == heads["_block"]))
    return both.withColumn(name, (F.col("_base") + F.sum("_step").over(w)).cast("long")).drop("_key", "_block", "_b", "_step", "_base")


def lagged(rows: DataFrame, key: str, order: str, columns: list[str], width: int | None = None) -> DataFrame:
    """rows with before: a struct of columns of the row before, null at the first."""
    if not width:
        return rows.withColumn("before", F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(order)))
    blocks, w = _blocked(rows, key, order, width)
    carried = F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_carried")
    both = _with_carried(blocks, key, [F.max_by(F.struct(*columns), order).alias("_last")], [carried])
    return both.withColumn("before", F.coalesce(F.lag(F.struct(*columns)).over(w), F.col("_carried"))).drop("_b", "_carried")


def running_count(rows: DataFrame, key: str, order: str, condition: Column, name: str, width: int | None = None) -> DataFrame:
    """rows with the number of rows up to each for which a condition holds."""
    if not width:
        return rows.withColumn(name, F.sum(condition.cast("long")).over(Window.partitionBy(key).orderBy(order)))
    blocks, w = _blocked(rows.withColumn("_one", condition.cast("long")), key, order, width)
    both = _with_carried(blocks, key, [F.sum("_one").alias("_ones")], [F.coalesce(F.sum("_ones").over(_over_blocks(key)), F.lit(0)).alias("_carried")])
    return both.withColumn(name, F.col("_carried") + F.sum("_one").over(w)).drop("_b", "_one", "_carried")


def running_most(rows: DataFrame, key: str, order: str, value: str, name: str, width: int | None = None) -> DataFrame:
    """rows with the largest value of the rows before each, null at the first."""
    if not width:
        return rows.withColumn(name, F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    blocks, w = _blocked(rows, key, order, width)
    both = _with_carried(blocks, key, [F.max(value).alias("_most")], [F.max("_most").over(_over_blocks(key)).alias("_carried")])
    return both.withColumn(name, F.greatest("_carried", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))).drop("_b", "_carried")


def unwrapped(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """packets with seq_ext: 16-bit sequence numbers unwrapped in arrival order."""
    return extended_counter(packets, "stream_id", "arrival_no", "seq16", 16, "seq_ext", cut(packets, "stream_id", width))


def extended(packets: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """packets with ts64: 32-bit media times extended to 64 bits along `order`."""
    return extended_counter(packets, "stream_id", order, "ts32", 32, "ts64", cut(packets, "stream_id", width))


def access_units(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Runs of packets of one media time, in sequence order; a marker also ends one. complete: no sequence number is missing inside."""
    at_once = cut(packets, "stream_id", width)
    rows = lagged(packets, "stream_id", "seq_ext", ["ts64", "marker", "seq_ext"], at_once)
    new = F.coalesce((F.col("ts64") != F.col("before.ts64")) | F.col("before.marker"), F.lit(True))
    marked = rows.withColumn("_new", new).withColumn("_ok", F.col("_new") | (F.col("seq_ext") == F.col("before.seq_ext") + 1)).drop("before")
    numbered = running_count(marked, "stream_id", "seq_ext", F.col("_new"), "au_no", at_once)
    return numbered.groupBy("stream_id", "au_no").agg(F.min("ts64").alias("ts64"), F.count(F.lit(1)).alias("packets"), F.bool_and("_ok").alias("complete"), F.bool_or("marker").alias("marker"))


def sample_durations(units: DataFrame, default: int = 3003, width: int = WIDTH) -> DataFrame:
    """units with duration: ticks to the next unit, 1 at least; the last has the mean of the others, or a default if it is alone."""
    # the row before, in the opposite order, is the next
    back = lagged(units.withColumn("_back", -F.col("au_no")), "stream_id", "_back", ["ts64"], cut(units, "stream_id", width))
    ahead = F.col("before.ts64") - F.col("ts64")
    stepped = back.withColumn("_d", F.when(ahead.isNotNull(), F.greatest(F.lit(1), ahead))).drop("before", "_back")
    means = stepped.groupBy(F.col("stream_id").alias("_stream")).agg(F.floor(F.avg("_d")).alias("_mean"))
    both = stepped.join(means, stepped["stream_id"].eqNullSafe(means["_stream"]))
    return both.withColumn("duration", F.coalesce("_d", "_mean", F.lit(default)).cast("long")).drop("_d", "_stream", "_mean")


def loss_stats(packets: DataFrame, width: int = WIDTH) -> DataFrame:
    """Packets received, expected, missing and late (below a number seen before) of each stream."""
    at_once = cut(packets, "stream_id", width)
    rows = running_most(extended_counter(packets, "stream_id", "arrival_no", "seq16", 16, "seq_ext", at_once), "stream_id", "arrival_no", "seq_ext", "_seen", at_once)
    span = F.max("seq_ext") - F.min("seq_ext") + 1
    late = F.coalesce(F.col("seq_ext") < F.col("_seen"), F.lit(False))
    return rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("received"), span.alias("expected"), (span - F.count_distinct("seq_ext")).alias("missing"), F.count_if(late).alias("out_of_order"), F.sum(F.col("marker").cast("long")).alias("markers"))


def bin_of(v: Column, low: float, high: float, base: float = 1.0, bins: int = BINS) -> Column:
    """Bin of a value: of equal width, or of widths that grow by `base`."""
    part = (v - low) / (high - low)
    if base == 1.0:
        i = F.floor(part * bins)
    else:
        i = F.when(part <= 0, 0).when(part >= 1, bins - 1).otherwise(F.floor(F.log(F.greatest(part, F.lit(1e-300)) * (base**bins - 1) + 1) / F.log(F.lit(base))))
    return F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1)).cast("int")


def bin_centre(i: Column, low: float, high: float, base: float = 1.0, bins: int = BINS) -> Column:
    if base == 1.0:
        return low + (i + 0.5) * ((high - low) / bins)
    edge = lambda k: (F.pow(F.lit(base), k) - 1) / (base**bins - 1) * (high - low)
    return low + 0.5 * (edge(i.cast("double")) + edge(i.cast("double") + 1))


def decayed_histogram(samples: DataFrame, low: float, high: float, base: float = 1.0, key: str = "series") -> DataFrame:
    """The weight of each bin after all samples (key, i from 1, v).

    Every EVERY-th sample decays all bins before it is added, so sample i of N
    weighs (1 - d) * d ** (EVERY * (N // EVERY - i // EVERY)): one pre-aggregated
    sum by bin instead of a walk.
    """
    n = samples.groupBy(key).agg(F.max("i").alias("n"))
    by_turn = samples.groupBy(key, bin_of(F.col("v"), low, high, base).alias("bin"), F.floor(F.col("i") / EVERY).alias("turn")).agg(F.count(F.lit(1)).alias("c"))
    weight = F.sum(F.col("c") * (1 - DECAY) * F.pow(F.lit(DECAY**EVERY), (F.floor(F.col("n") / EVERY) - F.col("turn")).cast("double")))
    return by_turn.join(n, key).groupBy(key, "bin").agg(weight.alias("weight"))


def quantiles(histogram: DataFrame, ps: list[float], low: float, high: float, base: float = 1.0, key: str = "series") -> DataFrame:
    """For each p, the centre of the first bin at which the running weight reaches p of the total."""
    w = Window.partitionBy(key).orderBy("bin")
    rows = histogram.withColumn("cum", F.sum("weight").over(w)).withColumn("total", F.sum("weight").over(Window.partitionBy(key)))
    each = rows.select(key, "bin", "cum", "total", F.explode(F.array(*map(F.lit, ps))).alias("p"))
    return each.where(F.col("cum") >= F.col("p") * F.col("total")).groupBy(key, "p").agg(F.min("bin").alias("bin")).withColumn("quantile", bin_centre(F.col("bin"), low, high, base))


def eroded(blocks: DataFrame) -> DataFrame:
    """Blocks with motion (stream_id, frame_no, bx, by) that have one of four neighbours with motion; neighbours meet by equi-joins."""
    keys = ["stream_id", "frame_no", "bx", "by"]
    near = F.explode(F.array(*[F.struct((F.col("bx") + dx).alias("bx"), (F.col("by") + dy).alias("by")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("n")
    reached = blocks.select("stream_id", "frame_no", near).select("stream_id", "frame_no", "n.*")
    return blocks.join(reached, keys, "left_semi")


def motion_roi(blocks: DataFrame, width: int, height: int) -> DataFrame:
    """Bounding box (unit square) and score (share of blocks) of each frame's motion."""
    n = F.count(F.lit(1))
    return blocks.groupBy("stream_id", "frame_no").agg(n.alias("n_blocks"), (F.min("bx") / width).alias("x0"), (F.min("by") / height).alias("y0"), ((F.max("bx") + 1) / width).alias("x1"), ((F.max("by") + 1) / height).alias("y1"), (n / (F.lit(width * height) + F.lit(1e-7))).alias("score"))


def scene_change(costs: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """Mean flow cost over 5 of each frame, and whether it tells of a new scene (the first two frames of a stream never do)."""
    score = costs.groupBy("stream_id", "frame_no").agg(F.avg(F.greatest(F.lit(0.0), F.col("cost") - 5)).alias("score"))
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_no"))
    return score.withColumn("changed", (F.col("score") > 16 * (1 - sensitivity)) & (n > 2))


def performance_mode(load: Column) -> Column:
    return F.when(load < 0.15, 0).when(load < 0.3, 1).otherwise(2)


def predicted_box(b, flow, w: int, h: int):
    """A box moved by optical flow sampled at five places; flow(ix, iy) gives the S10.5 vector of a grid cell."""
    dx, dy = F.lit(0.0), F.lit(0.0)
    for fx, fy, weight in ((0.5, 0.5, 0.5), (0.35, 0.5, 0.125), (0.65, 0.5, 0.125), (0.5, 0.35, 0.125), (0.5, 0.65, 0.125)):
        x, y = b["x0"] * fx + b["x1"] * (1 - fx), b["y0"] * fy + b["y1"] * (1 - fy)
        cell = lambda v, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), (v * n + 0.5).cast("int")))
        vx, vy = flow(cell(x, w), cell(y, h))
        dx, dy = dx + weight * vx, dy + weight * vy
    # weights are eighths, so the sums are exact in any order; one division rounds
    dx, dy = dx / (4.0 * 32.0 * w), dy / (4.0 * 32.0 * h)
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return {"x0": clip(b["x0"] - dx), "y0": clip(b["y0"] - dy), "x1": clip(b["x1"] - dx), "y1": clip(b["y1"] - dy)}


def predicted_roi(boxes: DataFrame, ratio: float = 0.05) -> DataFrame:
    """The search region of each frame: the cover of all predicted boxes, grown by a share of its size (0.05 at least)."""
    r = boxes.groupBy("stream_id", "frame_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    grow = lambda a, b: ratio * 0.5 * F.greatest(F.lit(0.05), F.col(b) - F.col(a))
    return r.select("stream_id", "frame_no", clip(F.col("x0") - grow("x0", "x1")).alias("x0"), clip(F.col("y0") - grow("y0", "y1")).alias("y0"), clip(F.col("x1") + grow("x0", "x1")).alias("x1"), clip(F.col("y1") + grow("y0", "y1")).alias("y1"))


def stream_rates(frames: DataFrame, seconds: float, low: float = 0.0, high: float = 1.0, base: float = 1.0) -> DataFrame:
    """Of each stream's frames (stream_id, i from 1, latency, skipped): frames that ran, rate over a run of so many seconds, and the 50th and 90th percentile of latency by the decayed histogram, exact to a bin."""
    counts = frames.groupBy("stream_id").agg(F.count_if(~F.col("skipped")).alias("ran"), F.count_if("skipped").alias("skipped"))
    weights = decayed_histogram(frames.select(F.col("stream_id").alias("series"), "i", F.col("latency").alias("v")), low, high, base)
    at = quantiles(weights, [0.5, 0.9], low, high, base).groupBy(F.col("series").alias("stream_id")).agg(F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("p50"), F.max(F.when(F.col("p") == 0.9, F.col("quantile"))).alias("p90"))
    return counts.join(at, "stream_id").withColumn("fps", F.col("ran") / seconds)


def realtime_summary(rates: DataFrame, modes: DataFrame) -> DataFrame:
    """One row over all streams of stream_rates(): rates, mean percentiles, share of frames skipped, and the share of each performance mode (modes: mode 0 to 2, n)."""
    shares = modes.agg(*[(F.sum(F.when(F.col("mode") == k, F.col("n")).otherwise(0)) / (F.sum("n") + F.lit(1e-7))).alias(f"mode{k}") for k in range(3)]).withColumn("_one", F.lit(1))
    skipped = F.sum("skipped") / (F.sum("ran") + F.sum("skipped") + F.lit(1e-7))
    rows = rates.agg(F.count(F.lit(1)).alias("streams"), F.min("fps").alias("fps_min"), F.max("fps").alias("fps_max"), F.sum("fps").alias("fps_total"), F.avg("fps").alias("fps_mean"), F.avg("p50").alias("p50"), F.avg("p90").alias("p90"), skipped.alias("skipped"))
    return rows.withColumn("_one", F.lit(1)).join(shares, "_one").drop("_one")
