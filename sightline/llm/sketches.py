"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of all hashes (and the
least one, so that only an empty text has an empty sketch). A large document
keeps more hashes than a small one, at the same rate, so the share of the
smaller sketch found in the other estimates how much of the smaller document
lies in the larger, however unequal they are. Sketches merge by union: the
sketch of two texts is the merge of theirs, without the texts.

Shingles are SHINGLE consecutive code points, so scripts without spaces have as
many as others; a shorter text is one shingle. A fingerprint is its hashes in
ascending order, DIGITS hexadecimal digits each, so hashes(), merged() and
containment() are column expressions over the string.

Defined cases: null is an empty text, its fingerprint ''; of two empty
fingerprints the likeness is 1, of one and another 0; equal texts have equal
fingerprints; very long texts have long fingerprints, nothing is cut; the next
document of the last is the first, of a lone document itself; documents are in
ascending (doc_id, text), null ids first, so rows that repeat an id follow each
other in the order of their texts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import parts_for, slices, table
from sightline.llm.words import mix

SHINGLE = 16
#: One of so many hashes is kept.
FRACTION = 32
#: Hashes are written with 40 bits; those below the threshold begin with the bits that FRACTION fixes.
DIGITS, _DROPPED = 10, np.uint64(24)
_LIMIT = np.uint64((1 << 64) // FRACTION)
#: Fills up a text that is shorter than a shingle; no character.
_FILL = "\U0010ffff"


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash that begins at each code point of some texts that lie end to end, whether it is of a whole shingle, and where each text begins. By doubling: a hash of 2m points from those of its halves."""
    texts = [t.ljust(SHINGLE, _FILL) for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    factor = 0x9E3779B97F4A7C15
    m = 1
    while m < SHINGLE:
        h[:-m] = h[:-m] * np.uint64(factor) + h[m:]
        factor = factor * factor % (1 << 64)
        m *= 2
    whole = np.ones(len(h), bool)
    ends = np.cumsum(sizes)
    whole[(ends[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return mix(h), whole, ends - sizes


def sketch(texts: list[str]) -> list[np.ndarray]:
    """Ascending distinct kept hashes (DIGITS digits of them) of each text."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    if not some:
        return out
    hashes, whole, starts = shingle_hashes([texts[i] for i in some])
    hashes[~whole] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.flatnonzero(hashes < _LIMIT)
    own = np.searchsorted(starts, at, side="right") - 1
    few = np.flatnonzero(np.bincount(own, minlength=len(some)) == 0)
    own, kept = np.append(own, few), np.append(hashes[at], np.minimum.reduceat(hashes, starts)[few]) >> _DROPPED
    order = np.lexsort((kept, own))
    own, kept = own[order], kept[order]
    new = np.append(True, (kept[1:] != kept[:-1]) | (own[1:] != own[:-1]))
    for i, x in zip(some, np.split(kept[new], np.searchsorted(own[new], np.arange(1, len(some)))), strict=True):
        out[i] = x
    return out


def written_out(hashes: np.ndarray) -> str:
    """A fingerprint of ascending hashes."""
    return "".join(f"{x:0{DIGITS}x}" for x in hashes.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller of two documents in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def hashes(fingerprint: Column) -> Column:
    """A fingerprint's hashes, as an array of strings."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of both documents together (shingles across their border aside)."""
    both = F.array_sort(F.array_union(hashes(a), hashes(b)))
    # a least hash above the threshold stays only while nothing is below it
    low = F.filter(both, lambda x: x < F.lit(f"{int(_LIMIT >> _DROPPED):0{DIGITS}x}"))
    return F.array_join(F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1)), "")


def containment(a: Column, b: Column) -> Column:
    """likeness() of two fingerprints."""
    x, y = hashes(a), hashes(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise((F.size(x) == F.size(y)).cast("double"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each document (doc_id, text); one scan, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield table(schema, doc_id=batch.column("doc_id"), n_chars=[len(t) for t in texts], fingerprint=[written_out(x) for x in sketch(texts)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def edited(text: str, after: str) -> str:
    """text, its last half (rounded down) replaced by as many code points of the text after it, or all of those."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc_id, text) in order; a guest follows its part's last document and has no row itself."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    last = None  # part, guest, doc_id, text and sketch of the row before
    for batch in slices(batches, "text", 2 << 20):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        rows = list(zip(batch.column("part").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), texts, sketch(texts), strict=True))
        rows = [*([last] if last else []), *rows]
        last = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1]]
        if not pairs:
            continue
        changed = [edited(a[3], b[3]) for a, b in pairs]
        of = sketch(changed)
        yield table(
            schema,
            doc_id=[a[2] for a, _ in pairs], n_chars=[len(a[3]) for a, _ in pairs], edited_sha256=[hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            fingerprint=[written_out(a[4]) for a, _ in pairs], edited_fingerprint=[written_out(x) for x in of],
            near_edited=[likeness(a[4], x) for (a, _), x in zip(pairs, of, strict=True)], near_next=[likeness(a[4], b[4]) for a, b in pairs],
        )


def neighbours_compared(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness, and that to the next document's.

    Documents are dealt by ranges of doc_id, and sorted within them, in one
    shuffle; a range's first document, found from ids alone, also goes to the
    end of the range before it as a guest, so no range needs another.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = parts or parts_for(docs)
    edges = np.array(sorted({int(x) for x in docs.approxQuantile("doc_id", [i / n for i in range(1, n)], min(0.01, 0.2 / n))}) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # null ids come first
        known = ids.notna()
        return pd.Series(np.where(known, np.searchsorted(edges, ids.where(known, 0).astype(np.int64), side="right"), 0).astype(np.int32))

    dealt = docs.withColumn("part", range_of("doc_id"))
    # a row a range: whether it has a null id, and its least id
    firsts = dealt.groupBy("part").agg(F.max(F.col("doc_id").isNull()).alias("null"), F.min("doc_id").alias("first")).orderBy("part").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], COMPARED)
    heads = [(None if r.null else r.first, firsts[k - 1].part) for k, r in enumerate(firsts)]
    known = [(i, p) for i, p in heads if i is not None]
    of_null = next((p for i, p in heads if i is None), 0)
    ids, hosts = F.lit([i for i, _ in known]).cast("array<bigint>"), F.lit([p for _, p in known]).cast("array<int>")
    is_head = F.array_contains(ids, F.col("doc_id")) | (F.col("doc_id").isNull() & F.lit(len(known) < len(heads)))
    guests = docs.where(is_head).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    host = F.when(F.col("doc_id").isNull(), F.lit(of_null)).otherwise(F.try_element_at(hosts, F.array_position(ids, F.col("doc_id")).cast("int")))
    guests = guests.select(host.cast("int").alias("part"), F.lit(True).alias("guest"), "doc_id", "text")
    rows = dealt.select("part", F.lit(False).alias("guest"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(guests)
    ordered = rows.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")
    return ordered.mapInArrow(_compare, COMPARED)
