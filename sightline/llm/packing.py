"""Best-fit packing by hierarchical residual packing.

Documents become token ids with an end id; only longer ones are cut to pieces
of the sequence length. Nodes of a bounded number of pieces pack best-fit
(largest first). A node emits its nearly full sequences; the others go up a
tree as items of their fill, several nodes to one, where best fit runs again,
until one node is left, which emits all. After best fit, at most one sequence of
a node is half empty or more (two such would have been one), and of two others
none can join. So what a node can still give to others is that one, and room for
the at most FAN_IN such sequences that meet at each level above: it passes up
its emptiest FAN_IN a level, which take whatever any of its sequences could,
and emits the rest. A node so gets FAN_IN * (1 + FAN_IN * levels) sequences at
most, the root too, whatever the input.

Defined cases: a null text is empty (one piece: the end id); repeated rows are
packed as often as they come; a very long text is cut, one text at a time; an
empty table gives no rows; other columns are ignored. Ties are broken by doc_id, then piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import as_bytes, slices, staged, table
from sightline.llm.tokens import crc32_of_ids, encoder

#: Pieces a leaf packs; nodes that meet in one; a sequence with so many free places or fewer is emitted at once.
LEAF_PIECES, FAN_IN, NEARLY_FULL = 131_072, 16, 24

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
CARRIED = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
PLACED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, done boolean, sequence_id long, offset long, fill long"


def _pieces(path: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.width).tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for d, x in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids = np.frombuffer(enc.encode(x) + end, enc.width)
                rows += [(d, k, a, len(p := ids[a : a + capacity]), crc32_of_ids(p), p.tobytes()) for k, a in enumerate(range(0, len(ids), capacity))]
            yield table(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    return run


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids of each piece of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, taken in the order given, and each bin's fill: the fullest bin that still takes an item gets it."""
    free: dict[int, list[int]] = {}
    some, bins, places, fills = 0, [], [], []
    for size in sizes:
        above = some >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins.append(b)
        places.append(fills[b])
        fills[b] += size
        if room > size:
            free.setdefault(room - size, []).append(b)
            some |= 1 << room - size
    return bins, places, fills


def pack_node(rows: pa.Table, level: int, node: int, capacity: int, room: int, last: bool) -> pa.Table:
    """Packs a node's items (rows of one sequence_id stay together) and says which sequences are done. room: sequences over half full that it passes up."""
    rows = rows.sort_by([("fill", "descending"), ("sequence_id", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
    fill, own, offset = (rows.column(c).to_numpy() for c in ("fill", "sequence_id", "offset"))
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (own[1:] < 0)  # below 0: a piece that is in no sequence yet
    item = np.cumsum(new) - 1
    bins, places, fills = (np.array(x, np.int64) for x in best_fit(fill[new].tolist(), capacity))
    done = np.ones(len(fills), bool)
    if not last:
        emptiest = np.argsort(fills, kind="stable")[: room + 1]
        done[emptiest] = capacity - fills[emptiest] <= NEARLY_FULL
    b = bins[item]
    put = {"done": done[b], "sequence_id": (level << 58) + (node << 24) + b, "offset": offset + places[item], "fill": fills[b]}
    for name, values in put.items():
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
    return rows


def _packer(level: int, capacity: int, room: int, last: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pack_node(rows.drop_columns(["node"]), level, key[0].as_py(), capacity, room, last)

    return run


def pack(pieces: DataFrame, capacity: int, leaf_pieces: int = LEAF_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """sequence_id and offset of each piece; row tells pieces apart (length is at most the capacity)."""
    items = pieces.select(*CARRIED, F.lit(False).alias("done"), F.lit(-1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").cast("long").alias("fill"))
    nodes = max(1, -(-pieces.count() // leaf_pieces))
    levels, n = 0, nodes
    while n > 1:
        n, levels = -(-n // fan_in), levels + 1
    items = items.withColumn("node", F.pmod(F.xxhash64("row"), F.lit(nodes)))
    level, out = 0, None
    while True:
        last = nodes == 1
        placed = items.groupBy("node").applyInArrow(_packer(level, capacity, fan_in * (levels - level), last), PLACED)
        if not last or level:
            placed = staged(placed, "packed")
        done = placed.where("done")
        out = done if out is None else out.unionByName(done)
        if last:
            return out.select(*CARRIED, "sequence_id", "offset")
        nodes, level = -(-nodes // fan_in), level + 1
        # the node of the level below is in its sequence ids
        items = placed.where("NOT done").withColumn("node", F.pmod(F.shiftright("sequence_id", 24).bitwiseAND((1 << 34) - 1), F.lit(nodes)))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The pieces (staged, with their ids and a row number) and the places of all of them."""
    pieces = staged(cut(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces, pack(pieces, capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, each of one capacity at most."""
    both = places.join(pieces.select("row", "ids"), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
