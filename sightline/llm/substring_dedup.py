"""Removal of words in 35-word windows that occur elsewhere, by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hash among their six-word
grams) travel as one packed string, their words with a space between, to the
minimiser's bucket, where strings and then windows are sorted and counted
exactly. A string whose minimiser no other has is not sent (see repeats.py).

Defined cases: a null text has no words; a text of fewer words than a window
loses none; a very long text is a batch of its own; ties do not matter, as all
equal windows go; rows that repeat a doc_id are one document, which is reported for
each row; null doc_ids are neither compared nor cut; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import repeats
from sightline.llm._common import as_bytes, table
from sightline.llm.words import mix

WINDOW, GRAM = 35, 6


#: Windows that are sorted together; those of one minimiser that are more go by parts, by a hash of the window.
TOGETHER = 20_000


def all_go(runs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Run and place of every window that occurs more than once among the runs of its minimiser: sorted, so that equal ones are adjacent."""
    found = [np.empty((0, 2), np.int64)]
    cuts = np.append(0, np.flatnonzero(np.diff(runs["h"])) + 1) if len(runs) else np.zeros(0, np.int64)
    before = np.append(0, np.cumsum(runs["n"].astype(np.int64)))
    ends = np.append(cuts[1:], len(runs))
    k = 0
    while k < len(cuts):
        last = k
        while last + 1 < len(cuts) and before[ends[last + 1]] - before[cuts[k]] <= TOGETHER:
            last += 1
        found.append(_repeated(runs, texts, int(cuts[k]), int(ends[last])))
        k = last + 1
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def _repeated(runs: np.ndarray, texts: list[bytes], a: int, b: int) -> np.ndarray:
    """Run and place of the windows of runs a to b that another one of the same minimiser equals."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known)) for w in t.split(b" ")] for t in texts[a:b]]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((i for w in words for i in w), np.int64, int(sizes.sum()))
    n = sizes - WINDOW + 1
    own = np.repeat(np.arange(b - a), n)
    place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + place
    group = np.append(0, np.cumsum(runs["h"][a + 1 : b] != runs["h"][a : b - 1]))[own]
    parts = -(-len(start) // TOGETHER)
    part = np.zeros(len(start), np.uint64)
    if parts > 1:  # one minimiser: equal windows are of one part
        for k in range(WINDOW):
            part = mix(part + ids[start + k].astype(np.uint64))
        part %= np.uint64(parts)
    out = [np.empty((0, 2), np.int64)]
    for p in range(parts):
        some = np.flatnonzero(part == p)
        rows = np.empty((len(some), 1 + WINDOW), ">u4")
        rows[:, 0], rows[:, 1:] = group[some], ids[start[some, None] + np.arange(WINDOW)]
        order = np.argsort(rows.view(f"S{rows.itemsize * (1 + WINDOW)}").ravel(), kind="stable")
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        twice = np.zeros(len(some), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        some = some[twice]
        out.append(np.stack([own[some] + a, place[some]], 1))
    return np.concatenate(out)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        n, removed, kept = [], [], []
        for text, parts in zip(as_bytes(batch.column("text")), batch.column("covered").to_pylist(), strict=True):
            words = text.split()
            spans = repeats.removed_units(parts, len(words), WINDOW).tolist()
            n.append(len(words))
            removed.append([{"start": a, "end": b} for a, b in spans])
            for a, b in reversed(spans):
                del words[a:b]
            kept.append(b" ".join(words))
        yield table(schema, doc_id=batch.column("doc_id"), n_words=n, removed=removed, kept=kept)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, removed (spans of words, end exclusive) and kept (the remaining words with a space between, UTF-8) of each document."""
    covered = repeats.covered_windows(docs, repeats.Words(), WINDOW, GRAM, all_go, first_stays=False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(covered, "doc_id", "left")
    return rows.mapInArrow(_kept, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept binary")
