"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item's windows (WINDOW consecutive words, or the whole item if it is
shorter) must occur exactly. Every word of a window must then be in the
document, so it is enough to look where its rarest word is: words are ordered
by their document frequency in the corpus, each window's necessary prefix is
its rarest word, and only places of prefix words are candidates. A candidate's
start follows from the word's place in the window (positional bound), must
leave room for the window (length bound), and is verified word by word.

Documents are not shuffled. Frequencies take one pass, for which the benchmark's
vocabulary alone is broadcast (in parts of VOCABULARY words, a pass each, should
it be larger). Windows then go to the executors in blocks of at most BLOCK_BYTES
of item text (one larger item is a block of its own). A block is a few arrays: its
words' numbers end to end, and a place and a hash for each distinct window, about
5 bytes for each byte of item text. One block needs one pass over the documents.
Of several blocks each has a job of its own, which writes its hits and whose
broadcast is dropped before the next begins, so a task and the driver hold one
block whatever the size of the benchmark; the hits then meet by row.

Words: A-Z are lower-cased; a word is a run of ASCII letters, digits and
anything beyond ASCII. Defined cases: null and wordless texts have no words and
match nothing; a very long text is one row like any other; windows of equally
rare words take the one met first; repeated documents or items count each; null item_ids are left
out of item lists; empty tables match nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import as_bytes, staged

WINDOW, BLOCK_BYTES, VOCABULARY = 10, 8 << 20, 2_000_000

_WORD = frozenset([*range(48, 58), *range(97, 123), *range(128, 256)])
#: For each byte what counts for it in a word, or a space.
TO_WORDS = bytes(c if (c := b + 32 if 65 <= b <= 90 else b) in _WORD else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Windows:
    """The distinct windows of a block of items, found by their rarest words (by frequency, the smaller number of equals)."""

    #: Windows that are looked at together while the block is made.
    SOME = 100_000

    def __init__(self, items: list[tuple[int | None, bytes]], frequency: dict[bytes, int], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int32) for _, t in items]
        self.flat = np.concatenate([*texts, np.zeros(0, np.int32)])
        counts = np.array([0, *(frequency.get(w, 0) for w in self.vocabulary)], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        span = np.minimum(sizes, width)
        names = [i for i, _ in items]
        self.groups = [self._group(int(size), begin, sizes, names, np.flatnonzero(span == size), counts) for size in np.unique(span[span > 0])]

    def _rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.flat[at[:, None] + np.arange(size)]

    def _hashes(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h += self.flat[at + k].astype(np.uint64) * np.uint64(pow(seed, k + 1, 1 << 64))
        return h

    def _group(self, size: int, begin: np.ndarray, sizes: np.ndarray, names: list, some: np.ndarray, counts: np.ndarray) -> dict:
        n = sizes[some] - size + 1
        at = np.repeat(begin[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = np.repeat(some, n)
        seed = 0x9E3779B97F4A7C15
        while True:  # until hashes tell all these windows apart
            h = self._hashes(at, size, seed)
            order = np.argsort(h, kind="stable")
            first = np.ones(len(h), bool)
            first[1:] = h[order[1:]] != h[order[:-1]]
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            if all((self._rows(at[order[k : k + self.SOME]], size) == self._rows(at[lead[k : k + self.SOME]], size)).all() for k in range(0, len(h), self.SOME)):
                break
            seed += 2
        which, places = at[order[first]], []
        for k in range(0, len(which), self.SOME):
            rows = self._rows(which[k : k + self.SOME], size)
            place = np.lexsort((rows, counts[rows]), axis=1)[:, 0]
            places.append(np.unique(np.stack([rows[np.arange(len(rows)), place], place], 1), axis=0))
        pairs = np.unique(np.concatenate(places), axis=0)  # (prefix word, place in the window)
        # the items of each distinct window: ids end to end
        group = np.cumsum(first) - 1
        known = np.array([names[i] is not None for i in item[order].tolist()], bool)
        owners = np.unique(np.stack([group[known], np.array([names[i] for i in item[order[known]].tolist()], np.int64)], 1), axis=0)
        return {
            "size": size, "seed": seed, "hashes": h[order[first]], "at": which.astype(np.int32 if len(self.flat) < 1 << 31 else np.int64),
            "first": np.searchsorted(pairs[:, 0], np.arange(len(counts) + 1)).astype(np.int32), "places": pairs[:, 1].astype(np.int8 if size < 128 else np.int32),
            "owned": np.searchsorted(owners[:, 0], np.arange(first.sum() + 1)).astype(np.int32), "items": owners[:, 1],
        }

    def ids(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Starts and ends of the occurrences of windows in a document, and the items they belong to."""
        starts, ends, items = [], [], set()
        known = np.flatnonzero(ids)
        for g in self.groups if len(known) else ():
            size, first = g["size"], g["first"]
            n = first[ids[known] + 1] - first[ids[known]]
            at, n = known[n > 0], n[n > 0]
            if not len(at):
                continue
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[ids[at]], n)
            start = np.repeat(at, n) - g["places"][which]
            start = np.unique(start[(start >= 0) & (start + size <= len(ids))])
            weights = np.array([pow(g["seed"], k + 1, 1 << 64) for k in range(size)], np.uint64)
            for some in np.array_split(start, len(start) // 500_000 + 1):
                rows = ids[some[:, None] + np.arange(size)]
                full = rows.all(axis=1)
                some, rows = some[full], rows[full]
                h = (rows.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                j = np.minimum(np.searchsorted(g["hashes"], h), len(g["hashes"]) - 1)
                same = (self._rows(g["at"][j].astype(np.int64), size) == rows).all(axis=1)
                starts.append(some[same])
                ends.append(some[same] + size)
                for w in np.unique(j[same]).tolist():
                    items.update(g["items"][g["owned"][w] : g["owned"][w + 1]].tolist())
        none = np.empty(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(ends or [none]), items


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = {w for t in as_bytes(batch.column("text")) for w in words_of(t)}
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary())], ["word"])


def _counted(vocabulary: Broadcast):
    """Documents that have each word of the benchmark, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(vocabulary.value)}
        counts = np.zeros(len(number) + 1, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                counts[list({*map(number.get, words_of(text), repeat(len(number)))})] += 1
        some = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["word", "n"])

    return run


def frequencies(docs: DataFrame, benchmark: DataFrame, part: int = VOCABULARY) -> DataFrame:
    """word, n: documents that have each word of the benchmark (staged; words that none has are left out)."""
    spark = docs.sparkSession
    words = staged(benchmark.select("text").mapInArrow(_distinct_words, "word binary").distinct(), "vocabulary")
    parts = -(-words.count() // part) or 1
    out = None
    for k in range(parts):
        some = sorted(bytes(r.word) for r in words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).collect())
        counts = docs.select("text").mapInArrow(_counted(spark.sparkContext.broadcast(some)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        named = spark.createDataFrame([(some[r.word], r.n) for r in counts.collect()], "word binary, n long")
        out = named if out is None else out.unionByName(named)
    return staged(out, "frequencies")


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


_FOUND = {"_n_words": pa.int64(), "_hits": _HITS, "_items": pa.list_(pa.int64())}


def _matched(windows: Broadcast, names: list[str], text: str, all_rows: bool = True):
    """Rows with what a block's windows find in them; without all_rows only those in which they find something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            n_words, hits, items = [], [], []
            for body in as_bytes(batch.column(text)):
                ids = w.ids(body)
                starts, ends, found = w.find(ids)
                n_words.append(len(ids))
                items.append(sorted(found))
                hits.append(_joined(list(zip(starts.tolist(), ends.tolist(), strict=True))))
            more = {c: pa.array(x, _FOUND[c]) for c, x in (("_n_words", n_words), ("_hits", hits), ("_items", items))}
            out = pa.RecordBatch.from_arrays([more[c] if c in more else batch.column(c) for c in names], names)
            yield out if all_rows else out.filter(pa.array([bool(h) for h in hits]))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_row, _hits, _items) of several blocks, each row's spans joined."""
    for batch in batches:
        hits = [_joined([(h["start"], h["end"]) for h in x]) for x in batch.column("_hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(hits, _HITS), pa.array([sorted(set(x)) for x in batch.column("_items").to_pylist()], _FOUND["_items"])], ["_row", "_hits", "_items"])


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, those that touch or overlap made one."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """doc_id, n_words, hits (spans of words, end exclusive) and items (ids of items with a window that occurs) of each document.

    With carry, all columns of docs, and the results as _n_words, _hits, _items.
    """
    spark = docs.sparkSession
    texts = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    span = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    known = frequencies(docs, items)

    def windows(block: DataFrame, frequency: DataFrame) -> Broadcast:
        counts = {bytes(r.word): r.n for r in frequency.collect()}
        return spark.sparkContext.broadcast(Windows([(r.item_id, r.text.encode()) for r in block.collect()], counts, width))

    if blocks == 1:
        kind = T.StructType([*texts.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_hits", span), T.StructField("_items", T.ArrayType(T.LongType()))])
        rows = texts.mapInArrow(_matched(windows(items, known), kind.names, "text"), kind)
    else:
        # rows are numbered, and the numbers written: several jobs read them
        numbered = staged(texts.withColumn("_row", F.monotonically_increasing_id()), "rows")
        found = []
        for k in range(blocks):
            block = staged(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), "block")
            held = windows(block, known.join(block.select("text").mapInArrow(_distinct_words, "word binary").distinct(), "word"))
            hits = numbered.select("_row", "text").mapInArrow(_matched(held, ["_row", "_hits", "_items"], "text", all_rows=False), T.StructType().add("_row", "long").add("_hits", span).add("_items", T.ArrayType(T.LongType())))
            found.append(staged(hits, "hits"))
            held.unpersist(blocking=True)
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        met = every.groupBy("_row").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.flatten(F.collect_list("_items")).alias("_items"))
        joined = numbered.join(met.mapInArrow(_merged, met.schema), "_row", "left").drop("_row")
        words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
        rows = joined.withColumns({"_n_words": F.size(words).cast("long"), "_hits": F.coalesce("_hits", F.array().cast(span)), "_items": F.coalesce("_items", F.array().cast("array<bigint>"))})
        rows = rows.select(*texts.columns, "_n_words", "_hits", "_items")
    return rows if carry else rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["start"])
