"""Steps over streams with typed state: values, lists and maps in the state store, timers in event time.

A processor reads a key's state once a micro-batch, pushes the key's rows in
order through the same Step that runs in batch, and writes back what changed:
the buffer's places one by one, a tracker's tracks as a list. State has a
schema, so it can be read (spark.read.format("statestore")) and survives a
change of code that keeps it. A key that is silent for `idle_s` of event time is
ended by a timer and forgotten.

The state store must be RocksDB's; running() sees to that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from sightline.operators.fold import Step
from sightline.operators.steps import Reorder
from sightline.operators.trackers import TRACK_COLUMNS, CascadeTracker
from sightline.sources.mp4 import PARTS, Mp4Writer
from sightline.sources.shared import new_folder
from sightline.streaming.drivers import pushed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Processor(StatefulProcessor):
    """Loads a Step from state, pushes rows, saves it."""

    def __init__(self, keys: list[str], order: list[str], names: list[str], idle_s: float = 0.0, at: str = "ts"):
        self.keys, self.order, self.names, self.idle_ms, self.at = keys, order, names, int(idle_s * 1000), at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # when the key's timer goes off
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> Step:
        raise NotImplementedError

    def save(self, step: Step) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def _frame(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        own = dict(zip(self.keys, key, strict=True))
        return pd.DataFrame([{**own, **r} for r in rows], columns=self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable", ignore_index=True)
        step = self.load()
        for out in pushed(step, frame):
            yield self._frame(key, out)
        self.save(step)
        if self.idle_ms:
            due = int(frame[self.at].max().timestamp() * 1000) + self.idle_ms
            had = self.timer.get()[0] if self.timer.exists() else None
            if had is None or due > had:
                if had is not None:
                    self.handle.deleteTimer(had)
                self.handle.registerTimer(due)
                self.timer.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = list(self.ended(self.load()))
        self.timer.clear()
        self.forget()
        yield self._frame(key, out)

    def ended(self, step: Step) -> Iterator[dict]:
        """Rows of a key that its timer ends."""
        yield from step.end()


class Flat(Processor):
    """A Step whose state is some of its fields (with types): one value a key. left: a last row of those fields, marked gone, when the timer ends the key."""

    def __init__(self, make: Callable[[], Step], state: str, *args, left: bool = False, **options):
        super().__init__(*args, **options)
        self.make, self.state, self.left = make, state, left
        self.held = [part.split()[0] for part in state.split(", ")]

    def open(self, handle):
        self.value = handle.getValueState("state", self.state)

    def load(self):
        step = self.make()
        if self.value.exists():
            for name, x in zip(self.held, self.value.get(), strict=True):
                setattr(step, name, x)
        return step

    def save(self, step):
        self.value.update(tuple(getattr(step, n) for n in self.held))

    def forget(self):
        self.value.clear()

    def ended(self, step):
        yield from step.end()
        if self.left:
            yield {**{n: getattr(step, n) for n in self.held}, "gone": True}


class Reordered(Processor):
    """The reorder buffer: its places are a map by slot, of which a micro-batch writes only those that changed."""

    def __init__(self, row: str, *args, **options):
        super().__init__(*args, **options)
        self.row = row
        self.columns = [part.split()[0] for part in row.split(", ")]

    PLACE = {"last": "int", "outside": "int", "last32": "long", "last64": "long", "n": "long"}

    def open(self, handle):
        self.value = handle.getValueState("place", ", ".join(f"{n} {t}" for n, t in self.PLACE.items()))
        self.slots = handle.getMapState("held", "slot int", self.row)

    def load(self):
        step = Reorder()
        if self.value.exists():
            for name, x in zip(self.PLACE, self.value.get(), strict=True):
                setattr(step, name, x)
            step.held = {k[0]: dict(zip(self.columns, x, strict=True)) for k, x in self.slots.iterator()}
        self.before = dict(step.held)
        return step

    def save(self, step):
        for slot in self.before.keys() - step.held.keys():
            self.slots.removeKey((slot,))
        for slot, row in step.held.items():
            if self.before.get(slot) is not row:
                self.slots.updateValue((slot,), tuple(row[c] for c in self.columns))
        self.value.update(tuple(getattr(step, n) for n in self.PLACE))

    def forget(self):
        self.value.clear()
        self.slots.clear()


class Tracked(Processor):
    """The cascade tracker: a list of its tracks, and the next id."""

    def open(self, handle):
        self.next = handle.getValueState("next", "id long")
        self.tracks = handle.getListState("tracks", CascadeTracker.SAVED)

    def load(self):
        step = CascadeTracker()
        if self.next.exists():
            step.restore(self.next.get()[0], list(self.tracks.get()))
        return step

    def save(self, step):
        self.next.update((step.next_id,))
        rows = step.saved()
        if rows:
            self.tracks.put(rows)
        else:
            self.tracks.clear()

    def forget(self):
        self.tracks.clear()

    def ended(self, step):
        for k in step.tracks:
            x0, y0, x1, y1 = map(float, k.box)
            yield {"frame_no": None, "t": k.seen, "track_id": k.id, "state": "gone", "det_id": None, "conf": k.conf, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "observations": k.observations, "missed": k.missed}


class Mp4Parts(Processor):
    """The MP4 writer: what is known of a file as a value, the units of its open fragment as a list."""

    FIXED = {"started": "boolean", "part": "long", "number": "long", "base": "long", "total": "long", "count": "long", "last_ts": "long", "last_key": "boolean", "last": "binary"}

    def __init__(self, codec: str, *args, **options):
        super().__init__(*args, **options)
        self.codec = codec

    def open(self, handle):
        self.value = handle.getValueState("file", ", ".join(f"{n} {t}" for n, t in self.FIXED.items()) + ", vps binary, sps binary, pps binary")
        self.samples = handle.getListState("pending", "data binary, duration long, key boolean")

    def load(self):
        step = Mp4Writer(self.codec)
        if self.value.exists():
            held = list(self.value.get())
            for name, x in zip(self.FIXED, held, strict=False):
                setattr(step, name, x)
            step.last = bytes(step.last)
            step.sets = [bytes(x) if x is not None else None for x in held[len(self.FIXED) :]]
            step.pending = [(bytes(d), n, key) for d, n, key in self.samples.get()]
        return step

    def save(self, step):
        self.value.update((*(getattr(step, n) for n in self.FIXED), *step.sets))
        if step.pending:
            self.samples.put(step.pending)
        else:
            self.samples.clear()

    def forget(self):
        self.value.clear()
        self.samples.clear()


def mp4_parts(units: DataFrame, codec: str, idle_s: float, at: str = "ts") -> DataFrame:
    """Parts of MP4 files from streams of units (stream_id, au_no, ts64, data, and event time): a file ends when its stream is silent for idle_s."""
    schema = "stream_id long, " + PARTS
    return running(units, ["stream_id"], Mp4Parts(codec, ["stream_id"], ["au_no"], _names(schema), idle_s=idle_s, at=at), schema)


def running(stream: DataFrame, keys: list[str], processor: Processor, schema: str, mode: str = "eventTime") -> DataFrame:
    """What a processor gives for a stream (with a watermark, if it has timers)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=_typed(schema), outputMode="Append", timeMode=mode if processor.idle_ms else "None")


def _typed(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def _names(schema: str) -> list[str]:
    return _typed(schema).names


def stepped(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], state: str, schema: str, idle_s: float = 0.0, at: str = "ts", left: bool = False) -> DataFrame:
    """A Step of flat state: drivers.stateful() with typed state. state: its fields that are kept, "name type, ..."."""
    return running(stream, keys, Flat(make, state, keys, order, _names(schema), left=left, idle_s=idle_s, at=at), schema)


def reordered(stream: DataFrame, key: str, order: str, row: str, schema: str, idle_s: float = 0.0, at: str = "ts") -> DataFrame:
    """The reorder buffer's events. row: the columns that wait in it, seq16 and ts32 among them."""
    return running(stream, [key], Reordered(row, [key], [order], _names(schema), idle_s=idle_s, at=at), schema)


def tracked(frames: DataFrame, idle_s: float = 0.0, at: str = "ts") -> DataFrame:
    """The tracks of every frame (stream_id, frame_no, t, dets); a silent stream's tracks leave, in a last row each."""
    return running(frames, ["stream_id"], Tracked(["stream_id"], ["t", "frame_no"], _names(TRACK_COLUMNS), idle_s=idle_s, at=at), TRACK_COLUMNS)


def replayed(rows: DataFrame, order: str, parts: int = 3) -> DataFrame:
    """A batch table as a stream of `parts` micro-batches, by ranges of a column."""
    path = new_folder(rows.sparkSession, "replayed")
    edges = [float(x) for x in rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)]
    bounds = [-np.inf, *edges, np.inf]
    for a, b in zip(bounds, bounds[1:], strict=False):
        part = rows.where((F.col(order) > a) & (F.col(order) <= b)) if a > -np.inf else rows.where(F.col(order) <= b)
        part.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
