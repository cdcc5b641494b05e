"""Near-duplicate classes by ProbMinHash, banding and verification.

A document's shingles (five words, lower-cased) weigh 1 + log2 of their count.
Each shingle is a Poisson process with its weight as rate; every arrival goes to
a random component of the signature, which keeps the earliest. A shingle stops
as soon as its next arrival is later than all components' (early termination).
Two signatures agree in a component with the chance of the texts' probability
Jaccard similarity. A text that repeats shingles is also signed with all weights
1, which agrees with the chance of the sets' Jaccard similarity (where nothing
repeats, both signatures are one). Documents that agree in a whole band of either
are candidates, which are verified on their shingle sets: Jaccard similarity of
at least SIMILAR.

Exact copies are one node from the start. A bucket of a band links its members
with its first and last one (stars, so a bucket of a third of all rows gives
about two candidates a row and is no group in any task); after verification,
buckets whose members are still in several classes are tried again with one
member of each class, while rounds find enough links. Members of the buckets
that then still hold several classes are joined exactly (`crossing`): no pair of
two classes in a bucket is left untested. BANDS x ROWS finds a pair
at 0.8 with 99.8 %, at 0.9 with all but 1 in 10**7.

Verification takes the shingle sets, not their weights: copies that repeat a
line a different number of times are still copies. Weights decide candidates,
and sets do where a text repeats anything.

Defined cases: null and wordless texts are never linked; a text of fewer than
five words is one shingle; a very long text is signed in a batch of its own;
equal texts are one class, ties of class ids go to the least doc_id; rows that
repeat a doc_id are one document, of the least class that any of its texts has;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm._common import as_bytes, few, slices, staged, table
from sightline.llm.components import components
from sightline.llm.decontam import TO_WORDS
from sightline.llm.words import mix, word_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 6
#: A round of stars is followed by another one while so large a share of its pairs is linked; the exact join does the rest.
WORTHWHILE = 0.1
#: The largest list of ids that is broadcast (8 bytes each); a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and count of each distinct shingle, by document and hash."""
    flat, sizes = word_hashes(texts, TO_WORDS)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    n, h = len(flat), np.zeros(len(flat), np.uint64)
    left = np.repeat(ends, sizes) - np.arange(n)  # words from here to the text's end
    for k in range(width):
        more = mix(h[: n - k] * _GOLDEN + flat[k:] + np.uint64(1))
        h[: n - k] = np.where(left[: n - k] > k, more, h[: n - k])
    whole = left >= width
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    whole[(ends - sizes)[short]] = True
    doc, h = doc[whole], h[whole]
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m winning shingles) of documents with at least one shingle; doc must be sorted."""
    earliest, winner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    latest = np.full(n_docs, np.inf)
    at, time, step = np.arange(len(h)), np.zeros(len(h)), 0
    while len(at):
        step += 1
        u = mix(h[at] + np.uint64(step * int(_GOLDEN) & (1 << 64) - 1))
        time = time - np.log(((u >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32) / weight[at]
        slot = doc[at] * m + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = time == earliest[slot]
        winner[slot[won]] = h[at[won]]
        own = doc[at]
        alive = own[np.flatnonzero(np.diff(own, prepend=-1))]
        latest[alive] = earliest.reshape(n_docs, m)[alive].max(axis=1)
        on = time < latest[own]
        at, time = at[on], time[on]
    return winner.reshape(n_docs, m)


def _signed(bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))])

    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def banded(signatures: np.ndarray) -> np.ndarray:
        sig = signatures.reshape(len(signatures), bands, rows)
        key = np.broadcast_to(salt, (len(sig), bands))
        for k in range(rows):
            key = mix(key * _GOLDEN + sig[:, :, k])
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(few(batches), "text", 2 << 20):
            texts = as_bytes(batch.column("text"))
            doc, h, count = shingles(texts)
            n = np.bincount(doc, minlength=len(texts))
            some = np.flatnonzero(n)
            number = np.cumsum(n > 0) - 1
            own = number[doc]
            repeats = np.unique(own[count > 1])
            among = np.flatnonzero(np.isin(own, repeats))
            weighted = prob_minhash(own, h, 1 + np.log2(count), len(some), bands * rows)
            plain = prob_minhash(np.searchsorted(repeats, own[among]), h[among], np.ones(len(among)), len(repeats), bands * rows)
            sizes = np.full(len(some), bands)
            sizes[repeats] *= 2
            ends = np.append(0, np.cumsum(sizes))
            keys, places = np.empty(ends[-1], np.uint64), np.arange(bands)
            keys[ends[:-1, None] + places] = banded(weighted)
            keys[ends[repeats, None] + bands + places] = banded(plain)
            ids = batch.column("doc_id").take(pa.array(some))
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
            yield table(schema, doc_id=ids, digest=[xxhash.xxh3_128_digest(texts[i]) for i in some.tolist()], n=n[some].astype(np.int32), bands=flat)

    return run


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest (of the text), n (distinct shingles), bands (a key each; those of the plain signature too where a shingle repeats) of each document that has words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(_signed(bands, rows), "doc_id long, digest binary, n int, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in slices(few(batches), "text", 2 << 20):
        texts = as_bytes(batch.column("text"))
        doc, h, _ = shingles(texts)
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
        yield table(schema, id=batch.column("doc_id"), shingles=pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64))))


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and the distinct shingles of the documents in `ids` (distinct doc_id)."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    # rows that repeat a doc_id make equal sets, or sets of which one links
    return staged(texts.mapInArrow(_sets, "id long, shingles array<long>"), "shingle-sets")


def linked(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `similar`."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have a Jaccard similarity of at least `similar`."""
    ids = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "candidates")
    return linked(pairs, sets_of(ids, docs), similar)


def crossing(rest: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """All pairs (a, b) of documents of different classes (rest: rep, root) with a Jaccard similarity of at least `similar`.

    A prefix-filtered join: shingles of one class only cannot be shared, so they
    come first in a text's order, then the others, rare ones first. A pair must
    share a shingle within the first of both texts, few enough that the rest can
    still reach the overlap it needs (fewer in the shorter text, the indexed
    side). Classes meet by shingle before their members do, so that members of
    one class are never paired.
    """
    sets = sets_of(staged(rest.select(F.col("rep").alias("doc_id")).distinct(), "rest-ids"), docs)
    at_least = lambda share, n: F.ceil(share * n - 1e-9)
    half = similar / (1 + similar)
    each = sets.join(rest.select(F.col("rep").alias("id"), "root").distinct(), "id").select("id", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    met = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "df")
    own = each.join(met, "h").groupBy("id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    own = own.withColumn("m", F.size("common")).withColumn("probed", F.col("m") - at_least(similar, F.col("n")) + 1).where("probed > 0")
    first = own.select("id", "root", "n", "m", F.posexplode(F.slice("common", F.lit(1), F.col("probed").cast("int"))).alias("k", "e"))
    # at: places before this shingle in the text's order; those that only its class has come first
    first = staged(first.select("id", "root", "n", F.col("e.h").alias("h"), (F.col("n") - F.col("m") + F.col("k")).alias("at"), (F.col("k") <= F.col("m") - at_least(2 * half, F.col("n"))).alias("indexed")), "prefixes")
    x = first.where("indexed").select("h", F.col("root").alias("r"), F.col("id").alias("a"), F.col("n").alias("p"), F.col("at").alias("i"))
    y = first.select("h", F.col("root").alias("s"), F.col("id").alias("b"), F.col("n").alias("q"), F.col("at").alias("j"))
    near = lambda x, y: F.least(*x) >= at_least(half, y)
    # two classes meet in a shingle only if their members' extremes could be a pair
    xs = x.groupBy("h", "r").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.max(F.col("p") - F.col("i")).alias("pr"))
    ys = y.groupBy("h", "s").agg(F.min("q").alias("q0"), F.max("q").alias("q1"), F.max(F.col("q") - F.col("j")).alias("qr"))
    meet = xs.join(ys, "h").where("r <> s AND p0 <= q1").where(F.col("p1") >= at_least(similar, F.col("q0"))).where(near(("pr", "qr"), F.col("p0") + F.greatest("p0", "q0")))
    meet = staged(meet.select("h", "r", "s"), "meeting")
    both = meet.join(x, ["h", "r"]).join(y, ["h", "s"]).where("p <= q").where(near((F.col("p") - F.col("i"), F.col("q") - F.col("j")), F.col("p") + F.col("q")))
    pairs = staged(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crossing")
    return linked(pairs, sets, similar)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (node, root) after more links (a, b): components of the classes that the links join, and of nodes that were alone."""
    to = lambda end: F.coalesce(f"{end}_root", end).alias(end)
    ends = links.select("a", "b").join(roots.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b", "left")
    above = staged(components(ends.select(to("a"), to("b"))), "above")
    alone = above.join(roots, "node", "left_anti")
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return staged(moved.unionByName(alone), "roots")


def classes(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), kept (the one of the class) of each document."""
    sig = staged(signed(docs, bands, rows), "signatures")
    texts = staged(sig.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    keyed = texts.select("rep", "n", F.explode(F.array_distinct("bands")).alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max(F.struct("rep", "n")).alias("hi"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    # joins below read staged tables on both sides, so that Spark can split a key that many rows share
    members = staged(keyed.join(staged(shared, "shared"), "key"), "buckets")
    fits = lambda x, y: F.least(x, y) >= similar * F.greatest(x, y)
    pair = lambda other: F.struct(F.least("rep", f"{other}.rep").alias("a"), F.greatest("rep", f"{other}.rep").alias("b"), fits(F.col("n"), F.col(f"{other}.n")).alias("fits"))
    tried = members.select(F.explode(F.array(pair("lo"), pair("hi"))).alias("p")).select("p.*").where("fits AND a <> b").drop("fits").distinct()
    tried = staged(tried, "pairs")
    roots, again, members = staged(components(verified(tried, docs, similar)), "roots"), 0, members.select("key", "rep", "n")
    while True:
        # what goes on: buckets whose members are in several classes
        named = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        several = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key", "least")
        named = staged(named.join(staged(several, "several"), "key"), "open")
        members, again = named.select("key", "rep", "n"), again + 1
        # their least class meets one member of each other class, chosen anew each round
        each = named.groupBy("key", "root").agg(F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "key", F.lit(again))).alias("m"), F.first("least").alias("least"))
        lo = each.where("root = least").select("key", F.col("m").alias("lo"))
        more = each.where("root <> least").join(lo, "key").select(F.least("m.rep", "lo.rep").alias("a"), F.greatest("m.rep", "lo.rep").alias("b"), fits(F.col("m.n"), F.col("lo.n")).alias("fits")).where("fits").drop("fits").distinct()
        more = staged(more.join(tried, ["a", "b"], "left_anti"), "more-pairs")
        found = staged(verified(more, docs, similar), "more-links")
        n_found = found.count()
        if n_found:
            roots = merged(roots, found)
        if not n_found or n_found < WORTHWHILE * more.count():
            break
        tried = tried.unionByName(more)
    # what is left: every two members of different classes in a bucket are compared or ruled out
    named = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = staged(named.join(staged(several, "several"), "key").select("rep", "root").distinct(), "rest")
    if not rest.isEmpty():
        found = staged(crossing(rest, docs, similar), "rest-links")
        if not found.isEmpty():
            roots = merged(roots, found)
    reps = staged(texts.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("class_id")), "classes")
    own = sig.select("doc_id", "digest").join(reps, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(own, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
