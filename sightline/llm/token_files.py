"""Token-ID files: one concatenated id array, with Elias-Fano document boundaries.

A file set holds blocks in ascending doc_id order. A block is a row of a
Parquet container (so any store Spark writes to will do, and Spark's commit
protocol covers lost tasks): the ids of its documents end to end, and two
Elias-Fano sequences, the documents' start offsets and their ids. Both take
about 2 + log2(range / documents) bits an entry; select(i) finds the i-th
without decoding the rest.

Defined cases: a null text has the end id alone; a null doc_id comes first and
is kept; documents of equal doc_id are ordered by their ids' bytes; an empty
table gives an empty file set; a very long text is a block of its own; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm._common import as_bytes, new_path, slices, table
from sightline.llm.tokens import crc32_of_ids, encoder

#: A block ends with the document that brings it to so many ids, or so many documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 13

ENCODED = "part int, doc_id long, ids binary"
BLOCKS = "part int, block long, ids_before long, n_docs int, n_null int, n_ids long, width int, first_doc long, doc_ids binary, starts binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers from 0 to below 2**63, in about 2 + log2(range / length) bits each."""

    EVERY = 128
    HEAD = struct.Struct("<QBQ")

    def __init__(self, data: bytes):
        self.n, self.low_bits, n_high = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self._low = np.frombuffer(data, np.uint8, (self.n * self.low_bits + 7) // 8, at)
        at += len(self._low)
        self._high = np.frombuffer(data, np.uint8, (n_high + 7) // 8, at)
        at += len(self._high)
        self._marks = np.frombuffer(data, "<u4", -(-self.n // self.EVERY), at)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls.HEAD.pack(n, low_bits, len(high)) + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes() + at[:: cls.EVERY].astype("<u4").tobytes()

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value: from the mark before it, count ones in the high bits; then add its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._marks[i // self.EVERY]), i % self.EVERY
        byte = at // 8
        left += bin(int(self._high[byte]) & ((1 << at % 8) - 1)).count("1")
        while (ones := bin(int(self._high[byte])).count("1")) <= left:
            left -= ones
            byte += 1
        at = byte * 8 + int(np.flatnonzero(np.unpackbits(self._high[byte : byte + 1], bitorder="little"))[left])
        first = i * self.low_bits
        bits = np.unpackbits(self._low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :][: self.low_bits]
        return (at - i) << self.low_bits | sum(int(b) << k for k, b in enumerate(bits))

    def select_all(self, at: np.ndarray) -> np.ndarray:
        """select() of many places at once: from each one's mark, whole bytes of high bits are passed by their counts, then bits of one byte."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(at)
        mark = self._marks[at // self.EVERY].astype(np.int64)
        byte = mark // 8
        # ones before the byte of the mark, and the one that is looked for, counted from there
        left = at % self.EVERY + _ONES[self._high[byte] & ((1 << (mark % 8)) - 1).astype(np.uint8)]
        on = np.arange(len(at))
        while len(on):
            ones = _ONES[self._high[byte[on]]]
            on, ones = on[ones <= left[on]], ones[ones <= left[on]]
            left[on] -= ones
            byte[on] += 1
        high = byte * 8 + _PLACE_OF[self._high[byte], left] - at
        first = at * self.low_bits
        low = np.zeros(len(at), np.int64)
        for k in range(self.low_bits):
            bit = first + k
            low |= (self._low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return high << self.low_bits | low


#: Ones of each byte, and where its k-th one is.
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
_PLACE_OF = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


def _encode(path: str, end_id: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.width).tobytes()
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        edges = np.array(bounds, np.int64)
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id")
            at = np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(), side="right")
            yield table(schema, part=at.astype(np.int32), doc_id=ids, ids=[enc.encode(x) + end for x in as_bytes(batch.column("text"))])

    return run


def _blocks(width: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.binary()), ("starts", pa.binary()), ("ids", pa.binary())])

    def block(part: int, number: int, before: int, docs: list, texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // width for x in texts], np.int64)
        known = np.array([d for d in docs if d is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        gaps = (known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)).astype(np.int64)
        return table(schema, part=[part], block=[number], ids_before=[before], n_docs=[len(docs)], n_null=[len(docs) - len(known)], n_ids=[int(sizes.sum())], width=[width], first_doc=[first], doc_ids=[EliasFano.encode(gaps)], starts=[EliasFano.encode(np.cumsum(sizes) - sizes)], ids=[b"".join(texts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, held, part, number, before = [], [], 0, 0, 0, 0
        for batch in batches:
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if docs and (p != part or held >= BLOCK_IDS or len(docs) >= BLOCK_DOCS or (docs[0] is not None and d - docs[0] >= 1 << 62)):
                    yield block(part, number, before, docs, texts)
                    number, before = (number + 1, before + held) if p == part else (0, 0)
                    docs, texts, held = [], [], 0
                part = p
                docs.append(d)
                texts.append(x)
                held += len(x) // width
        if docs:
            yield block(part, number, before, docs, texts)

    return run


def _even_bounds(docs: DataFrame, n: int, cells: int = 4) -> list[int]:
    """Bounds of at most n doc_id ranges with about as many bytes of text each: `cells` times as many ranges of equal counts, weighed and joined."""
    k = n * cells
    edges = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / k for i in range(1, k)], min(0.01, 0.2 / k))})
    if not edges:
        return []
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(np.array(edges, np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(held.value, batch.column(0).fill_null(-(1 << 63)).to_numpy(), side="right")
            np.add.at(total, at, batch.column(1).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "bytes"])

    sized = docs.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long"))
    rows = sized.mapInArrow(weigh, "cell long, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()
    weight = np.zeros(len(edges) + 1, np.int64)
    weight[[r.cell for r in rows]] = [r.bytes for r in rows]
    share = np.cumsum(weight)[:-1] * n // max(1, int(weight.sum()))
    return [e for e, a, b in zip(edges, share, np.append(-1, share[:-1]), strict=True) if a > b and a > 0]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int, n_files: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes their blocks in ascending doc_id order.

    The doc_id ranges of the files come from a quantile sketch over doc_id and
    the bytes of text in each of its cells, so texts are encoded once, and only
    ids are shuffled.
    """
    n = n_files or max(1, docs.rdd.getNumPartitions())
    bounds = _even_bounds(docs, n) if n > 1 else []
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer, end_id, bounds), ENCODED)
    encoded = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    encoded.mapInArrow(_blocks(encoder(tokenizer).width.itemsize), BLOCKS).write.option("compression", "zstd").parquet(path)


def _documents(base: dict[int, int], with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                starts = EliasFano(row["starts"]).select_all(np.arange(row["n_docs"]))
                ends = np.append(starts[1:], row["n_ids"])
                known = (EliasFano(row["doc_ids"]).select_all(np.arange(row["n_docs"] - row["n_null"])).astype(np.uint64) + np.uint64(row["first_doc"] & (1 << 64) - 1)).astype(np.int64)
                each = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                more = {"ids": [x.astype("<u4").tobytes() for x in each]} if with_ids else {}
                yield table(schema, doc_id=[None] * row["n_null"] + known.tolist(), start=starts + (row["ids_before"] + base[row["part"]]), n_tokens=ends - starts, ids_crc32=[crc32_of_ids(x) for x in each], **more)

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, as little-endian unsigned 32-bit integers) of each document in the files.

    The ids before each file's first come from one sum a file (as many rows as
    files reach the driver).
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    base, so_far = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect())):
        base[part], so_far = so_far, so_far + n
    return blocks.mapInArrow(_documents(base, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_places(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """rank, doc_id, start, ids of the documents of certain ranks (places: rank, counted from 0 in ascending doc_id order): a block's select finds each, and no other document is unpacked.

    Blocks' first ranks are a running sum of a row a block, by file; a rank meets
    its block by an equi-join on its number of BLOCK_DOCS documents.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_docs"), F.sum("n_ids")).collect()))
    base, docs_before, ids_before = {}, 0, 0
    for part, n_docs, n_ids in sizes:
        base[part] = docs_before, ids_before
        docs_before, ids_before = docs_before + n_docs, ids_before + n_ids
    if not base:
        return spark.createDataFrame([], "rank long, doc_id long, start long, ids binary")
    from pyspark.sql import Window

    of = lambda k: F.create_map(*[F.lit(x).cast("long") for p, b in base.items() for x in (p, b[k])])
    part = F.col("part").cast("long")
    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("part", "block", "n_docs").withColumn("first_rank", F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + of(0)[part])
    cells = F.explode(F.sequence(F.floor(F.col("first_rank") / BLOCK_DOCS), F.floor((F.col("first_rank") + F.col("n_docs") - 1) / BLOCK_DOCS))).alias("cell")
    wanted = places.select(F.col("rank").cast("long").alias("rank"), F.floor(F.col("rank") / BLOCK_DOCS).alias("cell")).join(heads.select("*", cells), "cell").where("rank >= first_rank AND rank < first_rank + n_docs")
    each = wanted.groupBy("part", "block").agg(F.min("first_rank").alias("first_rank"), F.collect_list("rank").alias("ranks"))
    rows = blocks.join(each, ["part", "block"]).withColumn("ids_before", F.col("ids_before") + of(1)[part])
    schema = pa.schema([("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                starts, names, width = EliasFano(r["starts"]), EliasFano(r["doc_ids"]), r["width"]
                out = []
                for rank in r["ranks"]:
                    i = rank - r["first_rank"]
                    a, b = starts.select(i), starts.select(i + 1) if i + 1 < r["n_docs"] else r["n_ids"]
                    name = None if i < r["n_null"] else names.select(i - r["n_null"]) + r["first_doc"]
                    out.append((rank, name, r["ids_before"] + a, np.frombuffer(r["ids"], f"<u{width}", b - a, a * width).astype("<u4").tobytes()))
                yield table(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))

    return rows.select("n_docs", "n_null", "n_ids", "width", "first_doc", "doc_ids", "starts", "ids", "ids_before", "first_rank", "ranks").mapInArrow(run, "rank long, doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs to a new file set in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path)
