"""How quality filters interact: what each removes alone, after others, and in every order.

Documents are measured from Arrow's own buffers: a table of byte classes gives
words, capitals, symbols and code points of a whole batch, prefix sums at the
documents' offsets give each document's counts, and no word becomes a Python
object. Distinct words are counted by sorting each document's word hashes;
neighbours of equal hash are compared byte by byte, and a document in which two
words share a hash is counted again from its words themselves.

A document leaves the scan as its id, its part, a bit for each filter that it
fails and a digest of its text; repeated texts are then found from the least id
of each digest, labels join by id, and all else is sums over distinct
(part, bits, labels): at most 128 rows a part, whatever the corpus.

Defined cases: a null or empty text has no words (it fails A, and E if a smaller
id has such a text too); a null doc_id neither fails E nor makes another fail
it, and has no label; rows that repeat a doc_id are documents each, and equal
texts of one doc_id don't fail E by each other; a document has a label if any
row of labels for it says so; a null source is the part ''; very long texts are
counted like others, in batches of their own; an empty table gives no rows;
columns beside doc_id, text and source are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm._common import slices, staged, table
from sightline.llm.words import _GOLDEN, _TABLE, mix, powers

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))

MEASURED = "doc_id long, part string, n_words long, n_distinct long, n_chars long, n_capitals long, n_symbols long, failures int, digest binary"


def _class_of(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_WORD = ~_class_of(b" \t\n\x0b\f\r")
_CAPITAL = _class_of(bytes(range(65, 91)))
_SYMBOL = _class_of(b"#$%&*|")
_HEAD = ~_class_of(bytes(range(0x80, 0xC0)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a column of texts, as Arrow holds them; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros follow the last."""
    return np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, so many or more."""
    room = 1 << max(16, (size - 1).bit_length())
    return powers(room), powers(room, pow(_GOLDEN, -1, 1 << 64))


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct words of each document."""
    if not len(starts):
        return np.zeros(len(counts), np.int64)
    # a word's hash is a difference of prefix sums, moved to place 0
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[starts + lengths] - sums[starts]) * down[starts])
    bits = np.uint64(max(1, len(counts)).bit_length())
    doc = np.repeat(np.arange(len(counts)), counts)
    keys = doc.astype(np.uint64) << (np.uint64(64) - bits) | hashes >> bits
    order = np.argsort(keys)
    keys = keys[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    left, right = order[same], order[same + 1]
    out = counts - np.bincount(doc[left], minlength=len(counts))
    # hashes only propose: words of equal hash are compared, their first eight bytes at once
    size = lengths[left]
    mask = (np.uint64(1) << (np.minimum(size, 7) * 8).astype(np.uint64)) - np.uint64(1)
    mask[size > 7] = np.uint64(0xFFFFFFFFFFFFFFFF)
    eights = _eights(data)
    wrong = (size != lengths[right]) | ((eights[starts[left]] ^ eights[starts[right]]) & mask != 0)
    long = np.flatnonzero(~wrong & (size > 8))
    rest = size[long] - 8
    at = np.arange(int(rest.sum())) + np.repeat(8 - np.cumsum(rest) + rest, rest)
    differs = data[np.repeat(starts[left[long]], rest) + at] != data[np.repeat(starts[right[long]], rest) + at]
    for d in {*doc[left[wrong]].tolist(), *doc[np.repeat(left[long], rest)[differs]].tolist()}:
        out[d] = len(set(data[offsets[d] : offsets[d + 1]].tobytes().split()))
    return out


def counted(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, distinct words, code points, capitals and symbols of each document between its offsets."""
    within = _WORD[data]
    opens = within.copy()
    opens[1:] &= ~within[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    opens[heads] = within[heads]

    def per_document(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n_words = per_document(opens)
    starts = np.flatnonzero(opens)
    # a word ends before the next byte that isn't of a word, or before the next document
    closes = np.ones(len(data), bool)
    closes[:-1] = ~within[1:]
    closes[heads[heads > 0] - 1] = True
    lengths = np.flatnonzero(closes & within) + 1 - starts
    return n_words, _distinct(data, starts, lengths, n_words, offsets), per_document(_HEAD[data]), per_document(_CAPITAL[data]), per_document(_SYMBOL[data])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), *[(n, pa.int64()) for n in ("n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols")], ("failures", pa.int32()), ("digest", pa.binary())])
    for batch in slices(batches, "text", 2 << 20):
        offsets, data = buffers(batch.column("text"))
        words, distinct, chars, capitals, symbols = counted(offsets, data)
        failures = A * (words < 50) + B * (100 * distinct < 65 * words) + C * (100 * capitals > 5 * chars) + D * (symbols > 0)
        view = memoryview(data)
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield table(schema, doc_id=batch.column("doc_id"), part=batch.column("part"), n_words=words, n_distinct=distinct, n_chars=chars, n_capitals=capitals, n_symbols=symbols, failures=failures.astype(np.int32), digest=digests)


def measured(docs: DataFrame) -> DataFrame:
    """Counts, failure bits of A to D and digest of each document (doc_id, text, source); one scan, no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")).mapInArrow(_measure, MEASURED)


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows of measured() with the bit of E: a smaller doc_id has the same text.

    The least id of each digest comes from a pre-aggregated minimum, however
    many rows share it, and meets its row by an equi-join on digest and id.
    """
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    known = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "digest"], "left")
    failed = known.withColumn("failures", F.col("failures").bitwiseOR(F.when(F.col("_first"), 0).otherwise(E))).drop("_first")
    return failed.unionByName(rows.where("doc_id IS NULL"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic; false where a document has no label."""
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(says, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return known.unionByName(rows.where("doc_id IS NULL").withColumns({c: F.lit(False) for c in ("good", "toxic")}))


def cells(rows: DataFrame) -> DataFrame:
    """n documents of each part, set of failures and labels."""
    return rows.groupBy("part", "failures", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does in each place of each order of all filters, from cells().

    A filter's work depends only on which filters came before it, so each part's
    cells meet the 5 x 16 pairs of a filter and a set before it; the orders then
    look their steps up.
    """
    n = len(filters)
    sets = [(1 << k, before) for k in range(n) for before in range(1 << n) if not before >> k & 1]
    weight = {before: factorial(bin(before).count("1")) * factorial(n - 1 - bin(before).count("1")) for _, before in sets}
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(b).alias("before"), F.lit(weight[b]).cast("long").alias("weight")) for f, b in sets])
    each = counts.select("*", F.explode(pairs).alias("s")).select("part", "failures", "good", "toxic", "n", "s.*")
    own, earlier = F.col("failures").bitwiseAND(F.col("f")) != 0, F.col("failures").bitwiseAND(F.col("before")) != 0
    removed = own & ~earlier
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    states = each.groupBy("part", "f", "before", "weight").agg(
        total(~own & ~earlier).alias("kept"),
        total(removed).alias("removed"),
        total(own & earlier).alias("redundant"),
        total(F.col("failures") == F.col("f")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    states = states.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "f")))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, 1 << k, before))
            before |= 1 << k
    # n! x n rows, known beforehand
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, before int")
    return states.join(F.broadcast(orders), ["f", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over docs (doc_id, text, source) and labels (doc_id, quality, toxic). Texts are read once; ids, bits and digests are staged."""
    rows = staged(measured(docs).select("doc_id", "part", "failures", "digest"), "measured")
    return interactions(cells(with_labels(with_repeats(rows).drop("digest"), labels)))
