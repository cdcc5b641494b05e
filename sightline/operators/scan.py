"""Order-dependent rules as parallel prefix scans: a key with many rows is cut into blocks that run side by side.

Each rule is a Law. Its effect over a block is a function of the state before the
block, and these functions compose: an affine map, a piecewise linear map, a map
over a few states, or a hold that the first rows of a block decide. A scan has
three steps:

1. Rows are dealt by (key, block), sorted, and packed, a row a block, into a
   staged table; only keys with more than `block_rows` rows are cut, by
   quantiles of their order column. This is the one shuffle of the rows.
2. Each block gives its summary; the summaries of a key, a row a block, are
   walked in order, which gives the state before each block.
3. Blocks run from their states, in any order, without a shuffle.

Laws give what the Step of the same name (sightline.operators.steps) gives.
Rows with a null order column come first. Rows that tie in the order columns are
in no defined order, so these must be total.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sightline.sources.shared import new_folder

BLOCK_ROWS = 1 << 16


class Law:
    """A rule along a key's rows. Rows are lists of values by column; n0 is how many rows of the key came before."""

    #: Columns it reads, and those it adds, with their types.
    reads: tuple[str, ...] = ()
    adds: dict[str, str] = {}

    def start(self):
        """The state before a key's first row."""
        raise NotImplementedError

    def summary(self, rows: dict[str, list], n0: int):
        raise NotImplementedError

    def after(self, state, summary):
        """The state after a block, from the state before it and the block's summary."""
        raise NotImplementedError

    def run(self, rows: dict[str, list], n0: int, state) -> dict[str, list]:
        """The added columns."""
        raise NotImplementedError


@dataclass
class RunningMean(Law):
    """An affine map: each sample moves the mean by a rate that falls from 1 by 5 % a sample to 0.01."""

    reads, adds = ("v",), {"mean": "double"}

    def start(self):
        return 0.0

    def _rates(self, n0: int, n: int) -> list[float]:
        return np.maximum(0.01, 0.95 ** np.arange(n0, n0 + n, dtype=np.float64)).tolist()

    def summary(self, rows, n0):
        a, b = 1.0, 0.0
        for v, r in zip(rows["v"], self._rates(n0, len(rows["v"])), strict=True):
            a *= 1 - r
            b += r * (v - b)
        return a, b

    def after(self, state, summary):
        return summary[0] * state + summary[1]

    def run(self, rows, n0, state):
        out = []
        for v, r in zip(rows["v"], self._rates(n0, len(rows["v"])), strict=True):
            state += r * (v - state)
            out.append(state)
        return {"mean": out}


@dataclass
class NoiseFloor(Law):
    """A continuous, growing, piecewise linear map: a floor that falls fast and rises slowly. Its corners are the floors that meet a value exactly; as all pieces contract, few values meet one. Values (and so floors) are from low to high."""

    over: float = 24.0
    alpha: float = 0.9
    beta: float = 0.995
    ramp: int = 16
    low: float = 0.0
    high: float = 255.0
    reads, adds = ("v",), {"floor": "double", "motion": "boolean"}

    def start(self):
        return 0.0

    def _alphas(self, n0: int, n: int) -> Iterator[float]:
        return (self.alpha * min(k, self.ramp) / self.ramp for k in range(n0, n0 + n))

    def summary(self, rows, n0):
        if rows["v"] and not self.low <= min(rows["v"]) <= max(rows["v"]) <= self.high:
            raise ValueError(f"a value is not from {self.low} to {self.high}")
        x = y = np.array([self.low, self.high])
        for v, alpha in zip(rows["v"], self._alphas(n0, len(rows["v"])), strict=True):
            i = int(np.searchsorted(y, v))
            if 0 < i < len(y) and y[i] != v:
                x = np.insert(x, i, x[i - 1] + (x[i] - x[i - 1]) * (v - y[i - 1]) / (y[i] - y[i - 1]))
                y = np.insert(y, i, v)
            k = np.where(y > v, alpha, self.beta)
            y = y * k + v * (1 - k)
            if y[0] == y[-1] and len(y) > 1:
                # all floors have met
                x, y = x[:1], y[:1]
        return x, y

    def after(self, state, summary):
        return float(np.interp(state, *summary))

    def run(self, rows, n0, state):
        floors, motion = [], []
        for v, alpha in zip(rows["v"], self._alphas(n0, len(rows["v"])), strict=True):
            k = alpha if v < state else self.beta
            state = state * k + v * (1 - k)
            floors.append(state)
            motion.append(v > state + self.over)
        return {"floor": floors, "motion": motion}


@dataclass
class MotionSkip(Law):
    """A map over two states: below the lower threshold a row is skipped, from the upper one on it runs, between them it does what the row before did not."""

    after_skip: float = 0.01
    after_run: float = 0.05
    reads, adds = ("area",), {"skipped": "boolean"}

    def start(self):
        return False

    def _walk(self, areas: list[float], state: bool) -> list[bool]:
        a = np.asarray(areas, np.float64)
        low, high = a < self.after_skip, a < self.after_run
        fixed = np.append(True, low == high)
        turns = np.append(0, np.cumsum(low != high))
        value = np.append(state, low)
        last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), 0))
        return (value[last] ^ ((turns - turns[last]) % 2 == 1))[1:].tolist()

    def summary(self, rows, n0):
        ends = [self._walk(rows["area"], s)[-1:] or [s] for s in (False, True)]
        return ends[0][0], ends[1][0]

    def after(self, state, summary):
        return summary[state]

    def run(self, rows, n0, state):
        return {"skipped": self._walk(rows["area"], state)}


class Hold(Law):
    """A state that a row either leaves or replaces by a value of its own.

    The first rows of a block decide: its head ends where no state can have been
    left alone any more. For each row of the head, the summary has the state at
    the block's end if this row is the first to replace it.
    """

    def replaces(self, state, row: tuple) -> bool:
        raise NotImplementedError

    def value(self, row: tuple):
        raise NotImplementedError

    def decided(self, head: list[tuple]) -> Iterator[bool]:
        """After each row, whether every state has been replaced by then."""
        raise NotImplementedError

    def summary(self, rows, n0):
        each = list(zip(*(rows[c] for c in self.reads), strict=True))
        n_head = next((k + 1 for k, done in enumerate(self.decided(each)) if done), len(each))
        # states that are alive, and the rows of the head from which they come; equal states are one from then on
        alive: dict = {}
        for k, row in enumerate(each):
            changed: list[int] = []
            for state in [s for s in alive if self.replaces(s, row)]:
                changed += alive.pop(state)
            if k < n_head:
                changed.append(k)
            if changed:
                alive.setdefault(self.value(row), []).extend(changed)
        ends = {k: state for state, of in alive.items() for k in of}
        return [(each[k], ends[k]) for k in range(n_head)]

    def after(self, state, summary):
        return next((end for row, end in summary if self.replaces(state, row)), state)

    def _steps(self, rows, state) -> Iterator[tuple[bool, tuple]]:
        for row in zip(*(rows[c] for c in self.reads), strict=True):
            new = self.replaces(state, row)
            if new:
                state = self.value(row)
            yield new, row


@dataclass
class Throttle(Hold):
    """Frame-rate limit of the pipeline: a row is kept if it is min_dt or more after the last kept one, jumps back or of over 10 s count as late enough."""

    min_dt: float
    reads, adds = ("t", "has_image"), {"kept": "boolean"}

    def start(self):
        return None

    def replaces(self, state, row):
        t, has_image = row
        return state is None or t < state or t > state + 10.0 or (has_image and t - state + 1e-7 >= self.min_dt)

    def value(self, row):
        return row[0] if row[1] else row[0] - 10.0

    def decided(self, head):
        low, high, shown = np.inf, -np.inf, -np.inf
        for t, has_image in head:
            low, high = min(low, t), max(high, t)
            shown = max(shown, t) if has_image else shown
            yield high - low > 10.001 or shown - low >= self.min_dt + 0.001

    def run(self, rows, n0, state):
        return {"kept": [new and row[1] for new, row in self._steps(rows, state)]}


@dataclass
class DecoderThrottle(Hold):
    """Frame-rate limit of the decoder: rows less than min_dt after the last output are skipped."""

    min_dt: float
    reads, adds = ("t",), {"kept": "boolean"}

    def start(self):
        return 0.0

    def replaces(self, state, row):
        gap = row[0] - state
        return not (0 <= gap <= 10.0 and gap < self.min_dt)

    def value(self, row):
        return row[0]

    def decided(self, head):
        low, high = np.inf, -np.inf
        for (t,) in head:
            low, high = min(low, t), max(high, t)
            yield high - low >= min(self.min_dt, 10.0) + 0.001

    def run(self, rows, n0, state):
        return {"kept": [new for new, _ in self._steps(rows, state)]}


@dataclass
class SourceSwitch(Law):
    """A map over (source, candidate, count): sources that a block doesn't have act alike, so a block with d sources has (d + 2) x (d + 1) x `needed` states to start from."""

    needed: int = 4
    reads, adds = ("ssrc",), {"accepted": "boolean"}

    def start(self):
        return None, 0, 0

    def _next(self, state, ssrc):
        current, candidate, count = state
        if current is None:
            return (ssrc, candidate, count), True
        if ssrc == current:
            return state, True
        candidate, count = (candidate, count + 1) if ssrc == candidate else (ssrc, 1)
        return ((ssrc, candidate, 0), True) if count >= self.needed else ((current, candidate, count), False)

    def summary(self, rows, n0):
        sources = sorted(set(rows["ssrc"]))
        alive = {(a, b, c): [(a, b, c)] for a in (None, "other", *sources) for b in ("other", *sources) for c in range(self.needed)}
        for ssrc in rows["ssrc"]:
            now: dict = {}
            for state, of in alive.items():
                now.setdefault(self._next(state, ssrc)[0], []).extend(of)
            alive = now
        return sources, {start: end for end, of in alive.items() for start in of}

    def after(self, state, summary):
        sources, ends = summary
        current, candidate, count = state
        known = lambda x: x if x is None or x in sources else "other"
        a, b, c = ends[known(current), known(candidate), count]
        return current if a == "other" else a, candidate if b == "other" else b, c

    def run(self, rows, n0, state):
        out = []
        for ssrc in rows["ssrc"]:
            state, ok = self._next(state, ssrc)
            out.append(ok)
        return {"accepted": out}


# the scan itself

_PACKED = "_rows binary, _n long"


def _bytes_of(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _pack(keys: list[str], columns: list[str], schema: pa.Schema):
    """Sorted rows as a row for each (key, block)."""
    of = [*keys, "_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flushed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            one = {c: held[0].column(c).slice(0, 1) for c in of}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([_bytes_of(rows.select(columns))]) if n == "_rows" else pa.array([rows.num_rows]) if n == "_n" else one[n] for n in schema.names], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            # where a key or block is not that of the row before
            new = np.zeros(batch.num_rows - 1, bool)
            for c in of:
                a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
                differ = pc.fill_null(pc.not_equal(a, b), False)
                new |= pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, islice(cuts, 1, None), strict=False):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(c)[0].as_py() != part.column(c)[0].as_py() for c in of):
                    yield flushed()
                held.append(part)
        if held:
            yield flushed()

    return run


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _lists(rows: pa.Table, columns: tuple[str, ...]) -> dict[str, list]:
    return {c: rows[c].to_pylist() for c in columns}


def scanned(df: DataFrame, keys: list[str], order: list[str], law: Law, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with the law's columns. keys, order: column names; the first of order is numeric."""
    spark, columns = df.sparkSession, df.columns
    added = ", ".join(f"{c} {t}" for c, t in law.adds.items())
    kind = StructType([*df.schema.fields, *_parse_datatype_string(added).fields])
    out_schema = to_arrow_schema(kind)

    # keys with more rows than a block; at most one for each block_rows rows
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows)
    most = hot.agg(F.max("_n")).first()[0]
    blocked = df.withColumn("_block", F.lit(0))
    if most:
        n_blocks = -(-most // block_rows)
        named = hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_hot"))
        meets = F.lit(True)
        for i, k in enumerate(keys):
            meets = meets & df[k].eqNullSafe(named[f"_k{i}"])
        marked = df.join(named, meets, "left").select(*columns, "_hot")
        edges = np.array(sorted(set(marked.where("_hot").approxQuantile(order[0], [i / n_blocks for i in range(1, n_blocks)], min(0.01, 0.2 / n_blocks)))), np.float64)

        @F.pandas_udf("int")
        def block_of(x: pd.Series) -> pd.Series:
            return pd.Series(np.where(x.notna(), np.searchsorted(edges, x.fillna(0).to_numpy(np.float64), side="right"), 0).astype(np.int32))

        blocked = marked.withColumn("_block", F.when(F.col("_hot"), block_of(F.col(order[0]).cast("double"))).otherwise(0)).drop("_hot")

    key_fields = [f.simpleString().replace(":", " ", 1) for f in df.select(*keys).schema.fields]
    packed_kind = _parse_datatype_string(", ".join(key_fields) + ", _block int, " + _PACKED)
    dealt = blocked.withColumn("_block", F.col("_block").cast("int")).repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", *order)
    packed = dealt.mapInArrow(_pack(keys, columns, to_arrow_schema(packed_kind)), packed_kind)
    started = pickle.dumps(law.start())

    def ran(rows: DataFrame) -> DataFrame:
        """Rows (_rows, _n0, _state) unpacked, with the law's columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    table = _unpacked(batch.column("_rows")[k].as_py())
                    more = law.run(_lists(table, law.reads), batch.column("_n0")[k].as_py(), pickle.loads(batch.column("_state")[k].as_py()))
                    arrays = [table[c].combine_chunks() if c in columns else pa.array(more[c], out_schema.field(c).type) for c in out_schema.names]
                    yield from pa.Table.from_arrays(arrays, schema=out_schema).to_batches(1 << 14)

        return rows.mapInArrow(run, kind)

    if not most:
        return ran(packed.select("_rows", F.lit(0).cast("long").alias("_n0"), F.lit(started).alias("_state")))

    path = new_folder(spark, "blocks")
    packed.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)
    own = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select(*keys, "_block", "_id", "_n").withColumn("_n0", F.coalesce(F.sum("_n").over(own), F.lit(0)))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(law.summary(_lists(_unpacked(r), law.reads), n0)) for r, n0 in zip(batch.column("_rows").to_pylist(), batch.column("_n0").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, pa.binary())], ["_id", "_summary"])

    path = new_folder(spark, "summaries")
    blocks.select("_id", "_rows").join(places.select("_id", "_n0"), "_id").mapInArrow(summarised, "_id long, _summary binary").write.parquet(path)
    summaries = spark.read.parquet(path)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            found = []
            for key, summary in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("_summary").to_pylist(), strict=True):
                if now is None or key != now:
                    now, state = key, law.start()
                found.append(pickle.dumps(state))
                state = law.after(state, pickle.loads(summary))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_n0"), pa.array(found, pa.binary())], ["_id", "_n0", "_state"])

    walked = places.join(summaries, "_id").repartition(*keys).sortWithinPartitions(*keys, "_block").select(*keys, "_id", "_n0", "_summary")
    path = new_folder(spark, "states")
    walked.mapInArrow(states, "_id long, _n0 long, _state binary").write.parquet(path)
    return ran(blocks.select("_id", "_rows").join(spark.read.parquet(path), "_id").select("_rows", "_n0", "_state"))
