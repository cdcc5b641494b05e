"""Hard-negative mining by a Voronoi-partitioned k-nearest-neighbour join.

Vectors become integers, and each gets one more component, so that all have the
length of the longest: then the order of inner products with an anchor is that
of distances from it, and triangle inequalities hold. A bounded sample gives
PIVOTS pivots; every vector belongs to the cell of its nearest pivot, at a
radius. Anchors of neighbouring cells form groups of about GROUP; a cell with
more is split by a hash of the id, so a hot cell is many groups.

A search has two steps. At home, a group meets the vectors of its own cells;
what is found bounds how far its anchors must still look. Then each group and
foreign cell has an interval of radii outside which no vector can serve any of
its anchors (distance to the pivot plus or minus what is needed), and only
vectors inside are sent. Each group's vectors are dealt over slices of about
SLICE by a hash of the id, so every local join has bounded memory, and is exact.

Positives are searched first; their scores then bound the band of negatives,
from below and from above.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, or one of 2**27 or more after scaling (which integers of products
could not hold), take no part; rows that repeat an id are one row, that of the
least label and then the least vector; vectors of other lengths are filled up
with zeros; equal scores are in the order of ids; equal vectors are rows like
others; fewer rows than asked for give what there is; an anchor without
positives or negatives has no row; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm._common import staged, table

#: Pivots, of a sample of the rows with the least hashes of their ids; anchors a group and vectors a slice, about.
PIVOTS, SAMPLE, GROUP, SLICE = 64, 1024, 256, 8192
LARGEST = 1 << 27

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"
_FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "found_id", "score")])


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, q: floor(scale * x) of each component, for rows that take part; one row an id."""
    sound = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST / scale)))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("int"))
    one = sound.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), q.alias("q"))).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n rows of a sample, each the farthest from those before it; equal rows count once."""
    chosen = [0]
    far = np.full(len(sample), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def grouped(counts: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, its first group and its number of groups: cells along a chain of near pivots share a group of at most `most` anchors; a cell with more has its own groups."""
    first, n, group, held = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), -1, 0
    left, now = set(range(len(pivots))), 0
    while left:
        left.discard(now)
        if counts[now] > most:
            n[now] = -(-counts[now] // most)
            first[now], group, held = group + 1, group + n[now], most
        elif group < 0 or held + counts[now] > most:
            group, held = group + 1, counts[now]
            first[now] = group
        else:
            first[now], held = group, held + counts[now]
        if left:
            rest = np.array(sorted(left))
            now = int(rest[((pivots[rest] - pivots[now]) ** 2).sum(1).argmin()])
    return first, n


class Space:
    """What all tasks know: the pivots with their last component, the length of the longest vector, and each cell's groups."""

    def __init__(self, pivots: np.ndarray, longest2: int):
        self.pivots, self.longest2 = pivots.astype(np.float64), float(longest2)
        self.last = np.sqrt(np.maximum(0.0, self.longest2 - (self.pivots**2).sum(1)))
        self.slack = 1e-5 * max(1.0, self.longest2**0.5)

    def away(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances of rows to pivots; an anchor's last component is 0."""
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, self.longest2 - own))
        return np.sqrt(np.maximum(0.0, (own + last**2)[:, None] + self.longest2 - 2 * (x @ self.pivots.T + last[:, None] * self.last)))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from each anchor at which a vector has a score."""
        return np.sqrt(np.maximum(0.0, (x.astype(np.float64) ** 2).sum(1) + self.longest2 - 2 * score))


def vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of 32-bit integers as they were staged."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def _assign(space: Space, dim: int):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("cell", pa.int32()), ("radius", pa.float64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.zeros((part.num_rows, dim), "<i4")
                for row, v in zip(x, part.column("q").to_pylist(), strict=True):
                    row[: len(v)] = v
                away = space.away(x)
                cell = away.argmin(1)
                yield table(schema, vec_id=part.column("vec_id"), label=part.column("label"), cell=cell.astype(np.int32), radius=away[np.arange(len(x)), cell], vec=[row.tobytes() for row in x])

    return run


def _best(scores: np.ndarray, k: int, none) -> list[np.ndarray]:
    """Of each row, the places of its k largest scores that are over `none`, the first of equals."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), none)
    out = []
    for row, bar in zip(scores, least, strict=True):
        at = np.flatnonzero((row >= bar) & (row > none))
        out.append(at[np.argsort(-row[at], kind="stable")[:k]])
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool):
    """Inner products and a value below all: as doubles where those hold them exactly, else as integers."""
    return (a.astype(np.float64) @ b.T.astype(np.float64), -np.inf) if exact else (a.astype(np.int64) @ b.T.astype(np.int64), -(1 << 63) + 1)


def _positives(dim: int, exact: bool, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            a, r, a_id, r_id, a_label, r_label = vectors(left["vec"], dim), vectors(right["vec"], dim), left["anchor_id"].to_numpy(), right["vec_id"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy()
            for label in np.unique(a_label):
                ai, ri = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
                if len(ri):
                    scores, none = _products(a[ai], r[ri], exact)
                    scores[a_id[ai][:, None] == r_id[ri]] = none
                    for i, at in zip(ai, _best(scores, k, none), strict=True):
                        out += [(a_id[i], None, None, r_id[ri[j]], int(s)) for j, s in zip(at, a[i].astype(np.int64) @ r[ri[at]].astype(np.int64).T, strict=True)]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], schema=_FOUND_ARROW)

    return run


def band(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest integer scores from low to high per cent of a positive's."""
    return -(-positive * low // 100), positive * high // 100


def _negatives(dim: int, exact: bool, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("vec_id")
            a, r, a_id, r_id, a_label, r_label = vectors(left["vec"], dim), vectors(right["vec"], dim), left["anchor_id"].to_numpy(), right["vec_id"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy()
            positives = left["positives"].to_pylist()
            for label in np.unique(a_label):
                ai, ri = np.flatnonzero(a_label == label), np.flatnonzero(r_label != label)
                if not len(ri):
                    continue
                scores, none = _products(a[ai], r[ri], exact)
                for place in range(max(len(positives[i]) for i in ai)):
                    with_one = [t for t, i in enumerate(ai) if len(positives[i]) > place]
                    p = [positives[ai[t]][place] for t in with_one]
                    lo, hi = band(np.array([x["score"] for x in p], np.int64), low, high)
                    s = scores[with_one]
                    s = np.where((s >= lo[:, None]) & (s <= hi[:, None]), s, none)
                    for t, x, row, at in zip(with_one, p, s, _best(s, k, none), strict=True):
                        out += [(a_id[ai[t]], x["id"], x["score"], r_id[ri[j]], int(row[j])) for j in at]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(5)], schema=_FOUND_ARROW)

    return run


def _intervals(space: Space, dim: int, home: dict[int, list[int]]):
    """Rows (group, vec, need, ceiling): of each group and foreign cell, the radii within which a vector may have a score of at least `need` (null: any) and at most `ceiling` (null: any) with one of its anchors."""
    schema = pa.schema([("group", pa.int32()), ("cell", pa.int32()), ("inner", pa.float64()), ("outer", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("vec"), dim)
            away = space.away(x, anchors=True)
            of = lambda name, empty: np.array([empty if v is None else v for v in batch.column(name).to_pylist()], np.float64)
            far, near = space.reach(x, of("need", -np.inf))[:, None], space.reach(x, of("ceiling", np.inf))[:, None]
            inner, outer, groups = np.maximum(away - far, near - away), away + far, batch.column("group").to_numpy()
            for g in np.unique(groups):
                mine = groups == g
                lo, hi = inner[mine].min(0), outer[mine].max(0)
                had = held.get(g)
                held[int(g)] = (lo, hi) if had is None else (np.minimum(lo, had[0]), np.maximum(hi, had[1]))
        rows = [(g, c, lo[c] - space.slack, hi[c] + space.slack) for g, (lo, hi) in held.items() for c in range(len(lo)) if g not in home[c]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


class Join:
    """Anchors and vectors of one search, dealt over groups and slices."""

    def __init__(self, rows: DataFrame, space: Space, dim: int, first: np.ndarray, n: np.ndarray, slices: int):
        self.rows, self.space, self.dim, self.slices = rows, space, dim, slices
        self.home = {c: list(range(int(first[c]), int(first[c] + n[c]))) for c in range(len(first))}
        self.groups = int((first + n).max())

    def met(self, anchors: DataFrame, sent: DataFrame, kernel) -> DataFrame:
        """What a kernel finds for anchors among the vectors sent to their groups."""
        left = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))
        right = sent.select("group", F.pmod(F.xxhash64("vec_id"), F.lit(self.slices)).cast("int").alias("slice"), *[F.col(c).alias(c) for c in ("vec_id", "label", "vec")])
        return left.groupBy("group", "slice").cogroup(right.groupBy("group", "slice")).applyInArrow(kernel, _FOUND)

    def at_home(self) -> DataFrame:
        groups = F.lit([self.home[c] for c in range(len(self.home))]).cast("array<array<int>>")
        return self.rows.withColumn("group", F.explode(groups[F.col("cell")]))

    def from_abroad(self, anchors: DataFrame) -> DataFrame:
        """Vectors of other cells that may serve a group, by anchors' need and ceiling."""
        each = anchors.select("group", "vec", "need", "ceiling").mapInArrow(_intervals(self.space, self.dim, self.home), "group int, cell int, inner double, outer double")
        bounds = staged(each.groupBy("group", "cell").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer")), "bounds")
        return self.rows.join(bounds, "cell").where("radius BETWEEN inner AND outer")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each key, as rank: a partial limit in each task comes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor (rows vec_id, label, embedding where `anchor` holds) and each of its best other rows of its label, the best rows of other labels whose scores are from low to high per cent of the positive's."""
    spark = rows.sparkSession
    whole = staged(integers(rows.select("vec_id", "label", "embedding"), scale), "vectors")
    square = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    n, dim, longest2, largest, asked = whole.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square), F.max(F.aggregate("q", F.lit(0), lambda a, x: F.greatest(a, F.abs(x)))), F.count_if(anchor)).first()
    if not asked:
        return spark.createDataFrame([], RESULT)
    dim = max(1, dim)
    sample = np.zeros((SAMPLE, dim), np.int64)
    picked = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").collect()
    for row, r in zip(sample, picked, strict=False):
        row[: len(r.q)] = r.q
    space = Space(spread(sample[: len(picked)], PIVOTS), longest2)
    assigned = staged(whole.mapInArrow(_assign(space, dim), "vec_id long, label long, cell int, radius double, vec binary"), "cells")

    counts = np.zeros(len(space.pivots), np.int64)
    for r in assigned.where(anchor).groupBy("cell").count().collect():
        counts[r[0]] = r[1]
    first, blocks = grouped(counts, space.pivots, GROUP)
    of = lambda x: F.lit(x.tolist()).cast("array<int>")[F.col("cell")]
    group = (of(first) + F.pmod(F.xxhash64("vec_id"), of(blocks))).cast("int")
    anchors = assigned.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec", group.alias("group"))
    join, exact = Join(assigned, space, dim, first, blocks, max(1, -(-n // SLICE))), largest * largest * dim < 1 << 53

    def search(anchors: DataFrame, kernel, k: int, needed, *keys: str) -> DataFrame:
        """Home, then abroad as far as needed(anchors, found at home) says; the k best of each key."""
        found = staged(_ranked(join.met(anchors, join.at_home(), kernel), k, *keys).drop("rank"), "home")
        if join.groups > 1:
            more = join.met(anchors, join.from_abroad(needed(anchors, found)), kernel)
            found = found.unionByName(more)
        return _ranked(found, k, *keys)

    def need_of_positives(anchors: DataFrame, found: DataFrame) -> DataFrame:
        last = found.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("need"))
        return anchors.join(last, "anchor_id", "left").withColumn("ceiling", F.lit(None).cast("long"))

    best = staged(search(anchors, _positives(dim, exact, positives), positives, need_of_positives, "anchor_id"), "positives")
    listed = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("found_id").alias("id"), "score"))).alias("positives"))
    # a negative score has no band
    able = anchors.join(listed, "anchor_id").withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0)
    able = staged(able.withColumn("positives", F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))), "anchors")

    def need_of_negatives(anchors: DataFrame, found: DataFrame) -> DataFrame:
        held = found.groupBy("anchor_id", "positive_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
        each = anchors.select("anchor_id", F.explode("positives").alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("score"))
        floor = F.ceil(F.col("score") * low / 100)
        bound = each.join(held, ["anchor_id", "positive_id"], "left").groupBy("anchor_id").agg(F.min(F.when(F.col("n") >= negatives, F.col("last")).otherwise(floor)).alias("need"), F.floor(F.max("score") * high / 100).alias("ceiling"))
        return anchors.join(bound, "anchor_id")

    found = search(able, _negatives(dim, exact, negatives, low, high), negatives, need_of_negatives, "anchor_id", "positive_id")
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
