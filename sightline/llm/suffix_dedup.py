"""Removal of bytes in 100-byte strings that also start earlier, by suffix sorting with a difference cover.

A suffix array of every byte would take many times the corpus in shuffles and
disk, so the array is partitioned by content: windows that share a minimiser
form a run, runs whose minimiser no other run has cannot repeat and end there
(see repeats.py), and all others travel to their minimiser's bucket. In a bucket
the runs' strings are sorted first, which settles equal runs. Where strings of
one minimiser differ, all their suffixes are sorted with a difference cover: the
triples at places 1 and 2 mod 3 are sorted and named, names are sorted by the
same steps (recursion ends when names are distinct or longer than a window),
the other suffixes are ordered by their first byte and the named one that
follows, and both orders are merged. Adjacent suffixes are then compared over
the length of a window; in each group of equal ones the earliest stays.

Defined cases: a null text is empty; a very long text is a batch of its own; of
equal windows the one of the least doc_id, then place, stays; a text shorter than the length loses
nothing; rows that repeat a doc_id are one document, which is reported for each
row; null doc_ids are neither compared nor cut; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import repeats
from sightline.llm._common import as_bytes, table

LENGTH, GRAM = 100, 32
#: Bytes that are sorted together: more runs do not meet, unless one minimiser has more; small enough for a processor's cache.
CHUNK = 1 << 18


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the keys, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.empty(len(keys), np.int64)
    new[:1] = 1
    np.cumsum(sorted_[1:] != sorted_[:-1], out=new[1:])
    new[1:] += 1
    out = np.empty(len(keys), np.int64)
    out[order] = new
    return out


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of s (integers from 1), true as far as `depth` symbols; suffixes that agree so far may be equal or in either order."""
    n = len(s)
    if n < 3:
        rank = np.empty(n, np.int64)
        rank[sorted(range(n), key=lambda i: s[i:].tolist())] = np.arange(1, n + 1)
        return rank
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = int(s.max()) + 1
    pair = s[:-1] * top + s[1:]
    if top**2 * max(top, n + 2) >= 1 << 63:
        pair[:n] = _ranks(pair[:n])
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    cover = np.concatenate([one, two])
    names = _ranks(pair[cover] * top + s[cover + 2])
    if depth > 3 and int(names.max()) < len(names):
        # a 1 between the halves, below all names, keeps suffixes of the first from running on into the second
        deeper = suffix_order(np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1]), -(-depth // 3))
        names = np.concatenate([deeper[: len(one)], deeper[len(one) + 1 :]])
    r = np.zeros(n + 3, np.int64)
    r[cover] = names
    base = int(names.max()) + 1
    # merge: a suffix of residue 0 meets those of residue 1 by (symbol, rank), those of residue 2 by (two symbols, rank)
    zero_by = np.argsort(s[zero] * base + r[zero + 1], kind="stable")
    at = zero[zero_by]
    zero_one, zero_two = s[at] * base + r[at + 1], pair[at] * base + r[at + 2]
    cover_by = np.argsort(names, kind="stable")
    first = cover_by < len(one)
    in_one, in_two = cover[cover_by[first]], cover[cover_by[~first]]
    one_zero, two_zero = s[in_one] * base + r[in_one + 1], pair[in_two] * base + r[in_two + 2]
    rank = np.empty(n, np.int64)
    rank[at] = np.arange(len(at)) + np.searchsorted(one_zero, zero_one, side="left") + np.searchsorted(two_zero, zero_two, side="left")
    before = np.arange(len(cover_by))
    rank[in_one] = before[first] + np.searchsorted(zero_one, one_zero, side="right")
    rank[in_two] = before[~first] + np.searchsorted(zero_two, two_zero, side="right")
    return rank + 1


def equal_windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, text number and place of each window of `size` bytes that occurs more than once in the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # a separator after each text; windows never reach it
    flat = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    own = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.ones(len(flat), bool)
    inside[begin + sizes] = False
    data = np.frombuffer(b"".join(texts), np.uint8)
    flat[inside] = data.astype(np.int64) + 2
    flat[~inside] = 1
    rank = suffix_order(flat, size)
    place = np.arange(len(flat)) - begin[own]
    window = np.flatnonzero(place + size <= sizes[own])
    window = window[np.argsort(rank[window], kind="stable")]
    raw = np.zeros(len(flat), np.uint8)
    raw[inside] = data
    # adjacent prefixes: eight bytes at a time, while they agree
    wide = np.ndarray((max(0, len(raw) - 7),), "<u8", raw.tobytes(), strides=(1,))
    pairs = np.arange(len(window) - 1)
    same = np.zeros(len(window), bool)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        pairs = pairs[wide[window[pairs] + k] == wide[window[pairs + 1] + k]]
    same[pairs + 1] = True
    group = np.cumsum(~same) - 1
    counts = np.bincount(group, minlength=1) if len(group) else np.zeros(0, np.int64)
    many = counts[group] > 1 if len(group) else np.zeros(0, bool)
    return group[many], own[window[many]], place[window[many]]


def earliest_stay(runs: np.ndarray, texts: list[bytes], grams: tuple[int, ...] = (56, 80)) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of every window that an earlier one equals. Runs meet only within their minimiser, CHUNK bytes at a time; runs of one minimiser that are more are cut by another one, of longer grams."""
    which, places = [], []
    cuts = [0, *(np.flatnonzero(np.diff(runs["h"])) + 1).tolist(), len(runs)]
    lengths = np.cumsum([0, *map(len, texts)])
    start = 0
    while start < len(cuts) - 1:
        end = start + 1
        while end < len(cuts) - 1 and lengths[cuts[end + 1]] - lengths[cuts[start]] <= CHUNK:
            end += 1
        a, b = cuts[start], cuts[end]
        if end == start + 1 and grams and lengths[b] - lengths[a] > 16 * CHUNK:
            which_, places_ = _cut_again(runs[a:b], texts[a:b], grams)
            which.append(which_ + a)
            places.append(places_)
            start = end
            continue
        group, own, place = equal_windows(texts[a:b], LENGTH)
        if len(group):
            begin = runs["start"][a:b][own].astype(np.int64) + place
            order = np.lexsort((begin, runs["doc"][a:b][own], group))
            first = np.ones(len(order), bool)
            first[1:] = group[order][1:] != group[order][:-1]
            late = order[~first]
            which.append(own[late] + a)
            places.append(place[late])
        start = end
    none = np.empty(0, np.int64)
    return np.concatenate(which or [none]), np.concatenate(places or [none])


def _cut_again(runs: np.ndarray, texts: list[bytes], grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """earliest_stay of one minimiser's runs, dealt by their windows' minimisers of longer grams: equal windows share those too."""
    found, _, own = repeats.runs_of(repeats.Bytes(), np.arange(len(texts)), texts, LENGTH, grams[0])
    order = np.lexsort((found["start"], own, found["h"]))
    found, own = found[order], own[order]
    offset = found["start"].astype(np.int64)
    strings = [texts[k][s : s + n + LENGTH - 1] for k, s, n in zip(own.tolist(), offset.tolist(), found["n"].tolist(), strict=True)]
    inner = found.copy()
    inner["doc"], inner["start"] = runs["doc"][own], runs["start"][own] + found["start"]
    which, place = earliest_stay(inner, strings, grams[1:])
    return own[which], offset[which] + place


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        n, removed, kept = [], [], []
        for text, parts in zip(as_bytes(batch.column("text")), batch.column("covered").to_pylist(), strict=True):
            spans = repeats.removed_units(parts, len(text), LENGTH).tolist()
            n.append(len(text))
            removed.append([{"start": a, "end": b} for a, b in spans])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text)
        yield table(schema, doc_id=batch.column("doc_id"), n_bytes=n, removed=removed, kept=kept)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes, end exclusive) and kept (the remaining bytes) of each document."""
    covered = repeats.covered_windows(docs, repeats.Bytes(), LENGTH, GRAM, earliest_stay, first_stays=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(covered, "doc_id", "left")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
