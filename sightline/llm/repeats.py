"""Windows of a fixed number of units (bytes or words) that occur more than once in a corpus.

Each window has a minimiser: the least hash among its grams of a few units, the
leftmost of equals. Consecutive windows with the same minimiser form a run, and
equal windows lie in runs with equal minimisers, so runs can be dealt to buckets
by that hash and every bucket decides alone.

1. A scan finds each run's minimiser. Equal runs of a batch are compared byte by
   byte and leave it once, so a passage that many documents share is one run a
   batch. What is shuffled is about 12 bytes a run.
2. A bucket groups runs by minimiser. A minimiser that only one run has cannot
   be in two equal windows: those runs end here. All others go on.
3. Those runs travel as packed strings to their bucket, equal ones too. There the
   strings are sorted, which settles equal runs, and a kernel sorts the windows
   of those that share a minimiser but differ.
4. The covered windows of each document go back to it.

Hashes only decide what is compared: two windows count as equal when their bytes
are. Buckets are as many as the scan has partitions, so their size does not grow
with the input. Rows that repeat a doc_id are one document; where their texts
differ, what is found in any of them applies to each as far as it reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import as_bytes, parts_for, slices, staged, table
from sightline.llm.words import mix, powers, word_hashes

#: doc_id, first window, number of windows.
WINDOWS = np.dtype([("doc", "<i8"), ("start", "<u4"), ("n", "<u4")])
#: The same with a hash of the minimiser, and whether the run was met again in its batch.
RUNS = np.dtype([("h", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u2"), ("again", "u1")])

_ODD = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
#: Bits for a unit's place in a batch, below the hash that orders grams.
_PLACE = 24


class Bytes:
    """A document is its UTF-8 bytes."""

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(texts), np.uint8)
        return flat, np.array([len(t) for t in texts], np.int64)

    def hashes(self, flat: np.ndarray) -> np.ndarray:
        return _TABLE[flat]

    def grams(self, flat: np.ndarray, hashes: np.ndarray, gram: int) -> np.ndarray:
        """Eight bytes at a time."""
        wide = np.ndarray((len(flat) - 7,), "<u8", flat.tobytes(), strides=(1,))
        n = len(flat) - gram + 1
        h = np.zeros(n, np.uint64)
        for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
            h = mix(h * np.uint64(_ODD) + wide[k : k + n])
        return h

    def split(self, text: bytes):
        return text

    def cut(self, units, start: int, end: int) -> bytes:
        return units[start:end]


#: ASCII white space ends a word; all else counts as it is.
_WORDS = bytes(32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))


class Words:
    """A document is its words, unchanged: runs of anything but ASCII white space."""

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(texts, _WORDS)

    def hashes(self, flat: np.ndarray) -> np.ndarray:
        return flat

    def grams(self, flat: np.ndarray, hashes: np.ndarray, gram: int) -> np.ndarray:
        n = len(flat) - gram + 1
        h = np.zeros(n, np.uint64)
        for k in range(gram):
            h = mix(h * np.uint64(_ODD) + flat[k : k + n])
        return h

    def split(self, text: bytes):
        return text.split()

    def cut(self, units, start: int, end: int) -> bytes:
        return b" ".join(units[start:end])


_NONE = np.empty(0, RUNS), np.empty(0, np.uint64), np.empty(0, np.int64)


def runs_of(unit, docs: np.ndarray, texts: list[bytes], size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs (RUNS) of all windows of `size` units in the texts, a hash of each one's content, and its text's number."""
    flat, sizes = unit.units(texts)
    if len(flat) < size:
        return _NONE
    if len(flat) >= 1 << _PLACE and len(texts) > 1:
        half = len(texts) // 2
        left, right = runs_of(unit, docs[:half], texts[:half], size, gram), runs_of(unit, docs[half:], texts[half:], size, gram)
        return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]]), np.concatenate([left[2], right[2] + half])
    bits = max(_PLACE, len(flat).bit_length())
    low = np.uint64((1 << bits) - 1)
    hashes = unit.hashes(flat)
    h = unit.grams(flat, hashes, gram)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    place = (key & low).astype(np.int64)  # of each window's minimiser
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - size + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - size + 1, 0)) - np.maximum(sizes - size + 1, 0), np.maximum(sizes - size + 1, 0)) + (ends - sizes)[doc]
    if not len(doc):
        return _NONE
    at = place[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begin, own = start[first], doc[first]
    # the content's hash: a polynomial over the run, moved to its start
    room = -(-len(flat) // (1 << 19)) + 1 << 19
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(room)[: len(flat)], dtype=np.uint64)])
    content = (total[begin + n + size - 1] - total[begin]) * powers(room, pow(_ODD, -1, 1 << 64))[begin]
    out = np.zeros(len(first), RUNS)
    out["h"], out["doc"], out["start"], out["n"] = h[at[first]], docs[own], begin - (ends - sizes)[own], n
    return out, mix(content + mix(n.astype(np.uint64))), own


def _collapsed(unit, texts: list[bytes], size: int, runs: np.ndarray, content: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal runs of a batch (again is set if there are more), and the others, compared unit by unit."""
    order = np.lexsort((runs["start"], runs["doc"], content, runs["h"]))
    runs, content, own = runs[order], content[order], own[order]
    like = np.zeros(len(runs), bool)
    like[1:] = (runs["h"][1:] == runs["h"][:-1]) & (content[1:] == content[:-1]) & (runs["n"][1:] == runs["n"][:-1])
    at = np.flatnonzero(like)
    if not len(at):
        return runs, runs[:0]
    lead = np.maximum.accumulate(np.where(like, 0, np.arange(len(runs))))
    split: dict[int, object] = {}

    def string(i: int) -> bytes:
        k = int(own[i])
        if k not in split:
            split[k] = unit.split(texts[k])
        start = int(runs["start"][i])
        return unit.cut(split[k], start, start + int(runs["n"][i]) + size - 1)

    held, lead_string = -1, b""
    for i in at.tolist():
        if lead[i] != held:
            held, lead_string = int(lead[i]), string(int(lead[i]))
        like[i] = string(i) == lead_string
    same = np.flatnonzero(like)
    # a document that comes twice is one
    runs["again"][lead[same[(runs["doc"][same] != runs["doc"][lead[same]]) | (runs["start"][same] != runs["start"][lead[same]])]]] = 1
    return runs[~like], runs[like]


def _by_doc(runs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    runs = runs[np.argsort(runs["doc"], kind="stable")]
    cuts = np.flatnonzero(np.diff(runs["doc"])) + 1
    for part in np.split(runs, cuts) if len(runs) else ():
        yield int(part["doc"][0]), part


def _parted(values: np.ndarray, dtype: np.dtype, parts: int) -> Iterator[tuple[int, bytes]]:
    """The rows of each part of the documents (doc % parts), packed: a row a part, not one a document."""
    where = values["doc"] % parts
    order = np.argsort(where, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else ():
        yield int(where[some[0]]), _packed(values[some], dtype)


def _packed(values: np.ndarray, dtype: np.dtype) -> bytes:
    out = np.zeros(len(values), dtype)
    for name in dtype.names:
        out[name] = values[name]
    return out.tobytes()


_PARTS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])


def _columns(runs: np.ndarray) -> bytes:
    """Column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(runs[name]).tobytes() for name in RUNS.names)


def _rows(data: bytes) -> np.ndarray:
    n, at = len(data) // RUNS.itemsize, 0
    out = np.empty(n, RUNS)
    for name in RUNS.names:
        kind = RUNS.fields[name][0]
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _scan(unit, size: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = as_bytes(batch.column("text"))
            found = runs_of(unit, batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), texts, size, gram)
            kept, covered = _collapsed(unit, texts, size, *found)
            where = (mix(kept["h"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            parts = [(b, 0, _columns(np.sort(kept[order[x:y]], order=["doc", "start"]))) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
            parts += [(part, 1, data) for part, data in _parted(covered, WINDOWS, buckets)]
            if parts:
                yield table(_PARTS, **dict(zip(_PARTS.names, zip(*parts, strict=True), strict=True)))

    return run


def _bucket(first_stays: bool, buckets: int):
    """Covered windows (kind 1) and open runs (kind 2), by part of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, covered = [np.empty(0, RUNS)], [np.empty(0, WINDOWS)]
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                (covered if kind else held).append(np.frombuffer(data, WINDOWS) if kind else _rows(data))
        runs = np.concatenate(held)
        runs = runs[np.lexsort((runs["start"], runs["doc"], runs["h"]))]
        h = runs["h"]
        shared = np.zeros(len(h), bool)
        shared[1:] = h[1:] == h[:-1]
        shared[:-1] |= shared[1:].copy()
        if not first_stays:  # met again in its own batch alone
            covered.append(np.frombuffer(_packed(runs[~shared & (runs["again"] > 0)], WINDOWS), WINDOWS))
        rows = [(part, 1, data) for part, data in _parted(np.concatenate(covered), WINDOWS, buckets)]
        rows += [(part, 2, data) for part, data in _parted(runs[shared], RUNS, buckets)]
        if rows:
            yield table(_PARTS, **dict(zip(_PARTS.names, zip(*rows, strict=True), strict=True)))

    return run


def _by_document(dtype: np.dtype, name: str):
    """One row for each document of a part: its rows, packed."""
    schema = pa.schema([("doc_id", pa.int64()), (name, pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, dtype) for batch in batches for x in batch.column("data").to_pylist()]
        rows = [(doc, part.tobytes()) for doc, part in _by_doc(np.concatenate(held))] if held else []
        for k in range(0, len(rows), 5000):
            yield table(schema, **dict(zip(schema.names, zip(*rows[k : k + 5000], strict=True), strict=True)))

    return run


#: Bytes of strings that a task holds to settle equal ones before they leave.
HELD = 32 << 20


def _texts(unit, size: int, buckets: int):
    """The strings of open runs for their buckets (kind 0), equal ones of a task as one, and the windows that those cover (kind 1)."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("runs", pa.binary()), ("texts", pa.list_(pa.binary()))])

    def left(runs: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
        # the representatives of a task are met again elsewhere or not: what covers them is known in their bucket
        first, covered, strings = settled(np.concatenate(runs), texts, first_stays=True)
        where = (mix(first["h"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(buckets + 1))
        rows = [(b, 0, first[at := order[x:y]].tobytes(), [strings[i] for i in at.tolist()]) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
        rows += [(part, 1, data, []) for part, data in _parted(covered, WINDOWS, buckets)]
        return table(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, n = [], [], 0
        for batch in batches:
            for text, data in zip(as_bytes(batch.column("text")), batch.column("open").to_pylist(), strict=True):
                runs = np.frombuffer(data, RUNS)
                units = unit.split(text)
                runs = runs[runs["start"].astype(np.int64) + runs["n"] + size - 1 <= len(units)]
                cut = [unit.cut(units, s, s + k + size - 1) for s, k in zip(runs["start"].tolist(), runs["n"].tolist(), strict=True)]
                held.append(runs)
                strings += cut
                n += sum(map(len, cut))
                if n >= HELD:
                    yield left(held, strings)
                    held, strings, n = [], [], 0
        if strings:
            yield left(held, strings)

    return run


#: Takes runs (RUNS, by minimiser) and their texts; gives run number and place in it of each covered window.
Kernel = Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def _compared(kernel: Kernel, first_stays: bool, buckets: int):
    """Covered windows (kind 1), by part of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, passed = [], [], [np.empty(0, WINDOWS)]
        for batch in batches:
            for kind, data, strings in zip(batch.column("kind").to_pylist(), batch.column("runs").to_pylist(), batch.column("texts").to_pylist(), strict=True):
                (passed if kind else held).append(np.frombuffer(data, WINDOWS if kind else RUNS))
                texts += strings
        runs, covered, texts = settled(np.concatenate(held) if held else np.empty(0, RUNS), texts, first_stays)
        # of a minimiser's strings, those that differ from all others
        h = runs["h"]
        shared = np.zeros(len(h), bool)
        shared[1:] = h[1:] == h[:-1]
        shared[:-1] |= shared[1:].copy()
        runs, texts = runs[shared], [texts[i] for i in np.flatnonzero(shared).tolist()]
        which, place = kernel(runs, texts)
        out = np.zeros(len(which), WINDOWS)
        out["doc"], out["start"], out["n"] = runs["doc"][which], runs["start"][which] + place, 1
        both = np.concatenate([out, np.frombuffer(_packed(covered, WINDOWS), WINDOWS), *passed])
        rows = [(part, 1, data) for part, data in _parted(both, WINDOWS, buckets)]
        if rows:
            yield table(_PARTS, **dict(zip(_PARTS.names, zip(*rows, strict=True), strict=True)))

    return run


def settled(runs: np.ndarray, texts: list[bytes], first_stays: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs and their strings sorted by minimiser, string and place: one of each group of equal strings (the earliest), the runs that equal ones cover, and the strings of the former."""
    by = np.lexsort((runs["start"], runs["doc"], runs["h"])).tolist()
    h = runs["h"].tolist()
    by.sort(key=lambda i: (h[i], texts[i]))  # stable: equal strings stay in order of their places
    runs, texts = runs[by], [texts[i] for i in by]
    hs = runs["h"].tolist()
    same = np.fromiter((i > 0 and hs[i] == hs[i - 1] and texts[i] == texts[i - 1] for i in range(len(texts))), bool, len(texts))
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(runs))))
    at = np.flatnonzero(same)
    runs["again"][lead[at[(runs["doc"][at] != runs["doc"][lead[at]]) | (runs["start"][at] != runs["start"][lead[at]])]]] = 1
    again = np.zeros(len(runs), np.uint8)
    np.maximum.at(again, lead, runs["again"])
    first, covered = runs[~same], runs[same & ((runs["doc"] != runs["doc"][lead]) | (runs["start"] != runs["start"][lead]))]
    if not first_stays:
        covered = np.concatenate([covered, first[again[~same] > 0]])
    return first, covered, [texts[i] for i in np.flatnonzero(~same).tolist()]


def joined(windows: np.ndarray) -> np.ndarray:
    """One document's windows in order, those that follow each other or overlap made one."""
    windows = np.sort(windows, order=["start", "n"])
    ends = np.maximum.accumulate(windows["start"].astype(np.int64) + windows["n"])
    new = np.ones(len(windows), bool)
    new[1:] = windows["start"][1:] > ends[:-1]
    out = windows[new].copy()
    out["n"] = ends[np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)] - out["start"] if len(out) else 0
    return out


def covered_windows(docs: DataFrame, unit, size: int, gram: int, kernel: Kernel, first_stays: bool) -> DataFrame:
    """doc_id, covered (packed WINDOWS) of the documents that have windows which occur elsewhere (first_stays: earlier)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    buckets, packed = parts_for(docs), "bucket int, kind byte, data binary"
    dealt = lambda df: df.repartitionById(buckets, F.col("bucket"))
    found = staged(dealt(texts.mapInArrow(_scan(unit, size, gram, buckets), packed)).mapInArrow(_bucket(first_stays, buckets), packed), "runs")
    still = dealt(found.where("kind = 2")).mapInArrow(_by_document(RUNS, "open"), "doc_id long, open binary")
    strings = texts.join(still, "doc_id").select("text", "open").mapInArrow(_texts(unit, size, buckets), "bucket int, kind byte, runs binary, texts array<binary>")
    more = staged(dealt(strings).mapInArrow(_compared(kernel, first_stays, buckets), packed), "windows")
    return dealt(found.where("kind = 1").unionByName(more)).mapInArrow(_by_document(WINDOWS, "covered"), "doc_id long, covered binary")


def removed_units(covered: bytes | None, n_units: int, size: int) -> np.ndarray:
    """Starts and ends (n x 2) of the units that a document's covered windows cover."""
    if not covered or n_units < size:
        return np.empty((0, 2), np.int64)
    windows = joined(np.frombuffer(covered, WINDOWS))
    starts = windows["start"].astype(np.int64)
    ends = np.minimum(starts + windows["n"] + size - 1, n_units)
    starts, ends = starts[starts < ends], ends[starts < ends]
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1) if len(starts) else np.empty(0, np.int64)
    return np.stack([starts[new], ends[last]], 1)
