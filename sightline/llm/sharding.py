"""Sharding by extendible hashing.

A document hashes to 60 bits. The directory is indexed by hash prefixes; a
bucket over the byte limit splits on the next bit, others do not, until every
shard fits. Splitting works on sums by prefix (pre-aggregated, a fixed number
of prefix bits a round), so no shard's rows meet in one task, and only
documents of buckets that are still too large go to the next round.

Defined cases: a bucket of one hash value can't split further; it is cut to
pages instead. A document of over half the limit is a page; the others, in
doc_id order, go to a page by the half of the limit in which their running size
begins, so that no page exceeds the limit unless it is one document that does.
A very long text is a document like any other. A null text has 0 bytes; null
doc_ids hash as an empty text; equal ids share a bucket, and ties of id and size
are in any order, as their rows are equal; repeated rows count each; an empty
table gives no shards; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm._common import staged

#: Bits of the hash; prefix bits that the first round looks at beyond those that shards of even size would need.
BITS, AHEAD = 60, 4


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def shards(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_bytes, and of its shard: depth, prefix, page, shard (name), shard_bytes, shard_docs."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.col("doc_id")).alias("h"))
    pending, out, above = staged(sized, "sized"), None, 0
    total = pending.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(BITS, (total // limit).bit_length() + AHEAD)
    while True:
        cell = F.shiftright("h", BITS - depth).alias("cell")
        leaves = staged(_leaves(pending, cell, limit, above, depth), "leaves")
        placed = pending.withColumn("cell", cell).join(leaves, "cell")
        out = placed if out is None else out.unionByName(placed)
        if leaves.where("depth IS NULL").isEmpty():
            return _paged(out.where("depth IS NOT NULL"), limit)
        pending = staged(placed.where("depth IS NULL").select("doc_id", "n_bytes", "h"), "unplaced")
        above, depth = depth, min(BITS, depth + 8)


def _leaves(rows: DataFrame, cell: Column, limit: int, above: int, depth: int) -> DataFrame:
    """The shard of each cell (prefix of `depth` bits): the shallowest bucket over it that fits, null if none does. Buckets down to `above` bits are known to be too large."""
    cells = rows.groupBy(cell).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    at = cells.select("*", F.explode(F.sequence(F.lit(above + 1 if above else 0), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    buckets = at.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))
    leaf = F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_docs"))
    over = at.select("cell", "depth", "prefix").join(buckets, ["depth", "prefix"])
    return over.groupBy("cell").agg(F.min(leaf).alias("leaf")).select("cell", "leaf.*")


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """Shards of one hash value that exceed the limit become pages, odd ones of a document each, even ones by running size; all others are page 0."""
    rows = rows.select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes", "shard_docs")
    whole = rows.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    own = Window.partitionBy("depth", "prefix", "large").orderBy("doc_id", "n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = Window.partitionBy("depth", "prefix", "page")
    paged = rows.where(F.col("shard_bytes") > limit).withColumn("large", 2 * F.col("n_bytes") > limit)
    paged = paged.withColumn("page", F.when(F.col("large"), 2 * F.row_number().over(own) - 1).otherwise(2 * F.floor(2 * before / limit)).cast("long")).drop("large")
    paged = paged.withColumn("shard_bytes", F.sum("n_bytes").over(page)).withColumn("shard_docs", F.count(F.lit(1)).over(page))
    name = F.concat_ws(".", F.when(F.col("depth") == 0, F.lit("-")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), "0")), F.col("page").cast("string"))
    return whole.unionByName(paged).select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", "page", name.alias("shard"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, limit: int, path: str) -> None:
    """Writes the documents' rows under path/shard=<name>/, one folder a shard."""
    placed = shards(docs, limit).select(F.col("doc_id").alias("_doc"), "shard").distinct()
    docs.join(placed, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc"))).drop("_doc").repartition("shard").write.partitionBy("shard").parquet(path)
