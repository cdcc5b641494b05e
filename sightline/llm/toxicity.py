"""Toxic spans and document scores by a linear-chain conditional random field.

The chain has two states a word, clean and toxic. A word's features are itself,
its first four to seven letters and its last four.
Documents carry labels, words don't, so words are labelled first: features that
are far more frequent in toxic training documents than chance allows (a G test
over document counts, near copies counted once) seed the toxic words of those
documents. The field is fitted to these labels by gradient ascent on the
conditional likelihood, with an L1 penalty that leaves most weights at zero.

Forward-backward marginals then give each word's chance of being toxic. Between
words whose features have no weight all factors are the same, so the recursion
crosses such gaps in one step by a power of the 2x2 matrix; the result is the
same and long texts cost no more than their few weighted words. A document's
score is a logistic function of the marginals' sum and largest value, fitted on
the training documents; offending words are those with a marginal over a half.

The fit is on a bounded sample of labelled rows and runs on the driver: at most
TRAIN_TOXIC + TRAIN_CLEAN documents (the least hashes of doc_id, so the same rows
for the same table), whole texts each, as many as have TRAIN_BYTES together; the
seeds come from all their words, and the field is fitted to at most MOST_SEGMENTS
stretches of SEGMENT words of them, taken evenly from those with a seed word (half
of them at most) and from the others. Everything else covers all documents, in
one scan without a shuffle.

Defined cases: a very long text is one row like any other; null and wordless texts score as having no toxic word; without
labels of both kinds no word is toxic and every score is the share of toxic
labels; repeated rows get the same score; equal doc_ids among the labels count
once (toxic if any is); an empty table gives no rows; columns that clash with
the results' names are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm._common import as_bytes, few
from sightline.llm.decontam import words_of
from sightline.llm.tokens import _Memory

#: The fit's bounds: documents of each label, bytes of their texts, words of a training sequence, sequences.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES, SEGMENT, MOST_SEGMENTS = 1500, 4500, 64 << 20, 48, 9_000
FEATURE_BITS, ROUNDS, STEP, L1 = 22, 50, 0.3, 2e-5
#: A G statistic that chance reaches about once in 10**6 features.
SEED_G = 24.0
#: Most of a seed's frequency in clean documents, as a share of that in toxic ones.
SEED_SHARE = 0.1
THRESHOLD = 0.7

#: Beside the word itself: its first so many letters, and its last four, where the word is longer than that.
PREFIXES = (4, 5, 6, 7)
_FEATURES = len(PREFIXES) + 2


def features(word: bytes) -> list[str]:
    """The features of a word, each named by its kind and letters; empty for a part as long as the word or longer."""
    letters = word.decode("utf-8", "replace")
    n = len(letters)
    return ["w" + letters, *(f"{k}{letters[:k]}" if n > k else "" for k in PREFIXES), "e" + letters[-4:] if n > 4 else ""]


def _hashed(names: list[str]) -> list[int]:
    size = (1 << FEATURE_BITS) - 1
    return [zlib.crc32(x.encode()) & size or 1 if x else 0 for x in names]


@dataclass
class Model:
    """weights: of features, for the toxic state; moves: log factors of state pairs; bias: of the toxic state; link: intercept, slopes of log(1 + sum of marginals) and of the largest marginal."""

    weights: dict[str, float]
    moves: np.ndarray
    bias: float
    link: tuple[float, ...]

    def memory(self) -> _Memory:
        """What the features of each word add to the bias, kept for words met before; for one task, which drops it."""
        get = self.weights.get
        return _Memory(lambda word: sum([get(f, 0.0) for f in features(word)]), 300_000)

    def score(self, extra: np.ndarray) -> tuple[float, np.ndarray]:
        """The document's score and the places of its offending words."""
        at, p = gap_marginals(extra, self.bias, self.moves)
        z = sum(w * x for w, x in zip(self.link, evidence(p, len(extra)), strict=True))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z)))), at[p > 0.5]


def emissions(memory: _Memory, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memory.__getitem__, words), np.float64, len(words))


def evidence(p: np.ndarray, n_words: int) -> tuple[float, ...]:
    """What a document's score is made of: a constant, the marginals' sum, the largest, and their share of all words."""
    if not len(p):
        return 1.0, 0.0, 0.0, 0.0
    total = float(p.sum())
    return 1.0, math.log1p(total), float(p.max()), math.log1p(100 * total / n_words)


def gap_marginals(extra: np.ndarray, bias: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and toxic marginals of the words with weights, by forward-backward over a chain whose words mostly have none.

    A state vector crosses a word as v -> (v @ M) * f, with f = 1 for clean and
    exp(bias + extra) for toxic. Words without extra share one matrix, whose
    powers come from its eigenvalues, so only words with extra take a step.
    """
    at = np.flatnonzero(extra)
    if not len(at):
        return at, np.empty(0)
    m = np.exp(moves)
    plain = m * np.array([1.0, np.exp(bias)])
    t, d = (plain[0, 0] + plain[1, 1]) / 2, (plain[0, 0] - plain[1, 1]) / 2
    root = float(np.sqrt(max(d * d + plain[0, 1] * plain[1, 0], 1e-300)))
    high, ratio = t + root, (t - root) / (t + root)
    p0, p1, p2, p3 = plain.ravel().tolist()

    def crossing(n: np.ndarray):
        """plain ** n, scaled by its largest eigenvalue: (I (1 + r)/2 + (plain - t I) (1 - r) / (2 root)), r = ratio ** n."""
        r = np.power(abs(ratio), n) * np.where((n % 2 == 1) & (ratio < 0), -1.0, 1.0)
        x, y = (1 + r) / 2, (1 - r) / (2 * root)
        return (x + (p0 - t) * y).tolist(), (p1 * y).tolist(), (p2 * y).tolist(), (x + (p3 - t) * y).tolist()

    gaps = np.diff(at, prepend=-1) - 1
    g00, g01, g10, g11 = crossing(gaps)
    toxic = np.exp(np.clip(bias + extra[at], -30, 30)).tolist()
    m00, m01, m10, m11 = m.ravel().tolist()
    k = len(at)
    forward = [(0.0, 0.0)] * k
    c, x = 1.0, 0.0  # as after a clean word
    for i in range(k):
        c, x = c * g00[i] + x * g10[i], c * g01[i] + x * g11[i]
        c, x = c * m00 + x * m10, (c * m01 + x * m11) * toxic[i]
        s = c + x
        c, x = c / s, x / s
        forward[i] = (c, x)
    after = np.append(gaps[1:], len(extra) - 1 - at[-1])
    g00, g01, g10, g11 = crossing(after)
    out = np.empty(k)
    c, x = 1.0, 1.0  # the backward vector after the last word
    for i in range(k - 1, -1, -1):
        c, x = g00[i] * c + g01[i] * x, g10[i] * c + g11[i] * x
        a, b = forward[i][0] * c, forward[i][1] * x
        out[i] = b / (a + b)
        c, x = m00 * c + m01 * toxic[i] * x, m10 * c + m11 * toxic[i] * x
        s = c + x
        c, x = c / s, x / s
    return at, out


def _dense(emit: np.ndarray, mask: np.ndarray, moves: np.ndarray):
    """Log likelihood parts of sequences (rows) by forward-backward: marginals of toxic, expected moves, log partition."""
    n, steps = emit.shape
    m = np.exp(moves)
    f = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], -1)
    alpha, scale = np.empty((steps, n, 2)), np.ones((steps, n))
    v = np.tile([1.0, 0.0], (n, 1))
    for t in range(steps):
        new = (v @ m) * f[:, t]
        s = new.sum(1)
        v = np.where(mask[:, t, None], new / s[:, None], v)
        scale[t] = np.where(mask[:, t], s, 1.0)
        alpha[t] = v
    beta = np.ones((n, 2))
    marginal, moved = np.zeros((n, steps)), np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        on = mask[:, t, None]
        both = alpha[t] * beta
        marginal[:, t] = np.where(mask[:, t], both[:, 1] / both.sum(1), 0)
        before = alpha[t - 1] if t else np.tile([1.0, 0.0], (n, 1))
        ahead = f[:, t] * beta / scale[t][:, None]
        joint = before[:, :, None] * m * ahead[:, None, :]
        moved += np.where(on[:, :, None], joint / joint.sum((1, 2), keepdims=True), 0).sum(0)
        beta = np.where(on, ahead @ m.T, beta)
    return marginal, moved, np.log(scale).sum()


def _is_copy(words: list[bytes], seen: set[tuple[int, int]]) -> bool:
    """Whether a text shares either of two least hashes of word triples with one in `seen`, to which it is added."""
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    marks = {(s, min(zlib.crc32(p, s) for p in parts)) for s in (1, 2)}
    found = not marks.isdisjoint(seen)
    seen |= marks
    return found


def fit(texts: Iterable[bytes], labels: list[int], toxic_share: float | None = None) -> Model:
    """The model of labelled documents; toxic_share is that of all labels, if these are chosen unevenly. A text is read once and kept as word numbers."""
    y = np.array(labels, np.int64)
    share = float(np.clip(toxic_share if toxic_share is not None else (y.mean() if len(y) else 0.0), 0.0, 1.0))
    none = Model({}, np.zeros((2, 2)), -5.0, (float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0.0, 0.0, 0.0))
    if not 0 < y.sum() < len(y):
        return none
    known: dict[bytes, int] = {}
    ids, keep, seen = [], np.ones(len(y), bool), set()
    for i, text in enumerate(texts):
        words = words_of(text)
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        keep[i] = not _is_copy(words, seen)
    del seen
    each = np.fromiter((h for w in known for h in _hashed(features(w))), np.int32, len(known) * _FEATURES).reshape(-1, _FEATURES)
    size = 1 << FEATURE_BITS
    counts = np.zeros((2, size), np.int32)
    for i in np.flatnonzero(keep):
        counts[y[i], np.unique(each[np.unique(ids[i])])] += 1
    counts[:, 0] = 0
    n1, n0 = max(1, int(y[keep].sum())), max(1, int((1 - y[keep]).sum()))
    some = np.flatnonzero(counts[1] >= 3)
    a, b = counts[1][some].astype(float), counts[0][some].astype(float)
    e1 = (a + b) * n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (a * np.log(a / e1) + np.where(b > 0, b * np.log(b / (a + b - e1)), 0))
    seeds = some[(g >= SEED_G) & (b / n0 <= SEED_SHARE * a / n1)]
    is_seed = np.zeros(size, bool)
    is_seed[seeds] = True
    seed_word = is_seed[each].any(axis=1)
    if not seed_word.any():
        return none
    del counts, is_seed
    model, extra = _fit_field(ids, each, seed_word, y, list(known))
    x = np.array([evidence(gap_marginals(extra[ws], model.bias, model.moves)[1], len(ws)) for ws in ids])
    w, ridge = np.zeros(x.shape[1]), np.array([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    sample = y.mean()
    w[0] += np.log(share / (1 - share)) - np.log(sample / (1 - sample)) if 0 < share < 1 else 0.0
    model.link = tuple(w.tolist())
    return model


def _fit_field(ids: list[np.ndarray], each: np.ndarray, seed_word: np.ndarray, y: np.ndarray, known: list[bytes]) -> tuple[Model, np.ndarray]:
    """Weights, moves and bias of the field on segments of the documents: all that hold a seed word, and others up to MOST_SEGMENTS. Also what each known word adds to the bias."""
    held, rest = [], []
    for i, ws in enumerate(ids):
        for k in range(0, len(ws), SEGMENT):
            part = ws[k : k + SEGMENT]
            toxic = seed_word[part] & (y[i] == 1)
            (held if toxic.any() or seed_word[part].any() else rest).append((part, toxic))
    held = held[:: -(-len(held) // (MOST_SEGMENTS // 2))]
    rest = rest[:: max(1, -(-len(rest) // (MOST_SEGMENTS - len(held))))]
    parts = held + rest
    n = len(parts)
    word, tag, mask = np.zeros((n, SEGMENT), np.int64), np.zeros((n, SEGMENT), bool), np.zeros((n, SEGMENT), bool)
    for r, (part, toxic) in enumerate(parts):
        word[r, : len(part)], tag[r, : len(part)], mask[r, : len(part)] = part, toxic, True
    used, inside = np.unique(word, return_inverse=True)
    inside = inside.reshape(word.shape)
    named, feature = np.unique(each[used], return_inverse=True)
    feature = feature.reshape(-1, _FEATURES)
    zero = np.flatnonzero(named == 0)
    weight, slope = np.zeros(len(named)), np.full(len(named), 1e-8)
    bias, moves = -3.0, np.zeros((2, 2))
    before = np.concatenate([np.zeros((n, 1), bool), tag[:, :-1]], 1)
    seen_moves = np.array([[(mask & (before == i) & (tag == j)).sum() for j in (False, True)] for i in (False, True)], float)
    tokens = mask.sum()
    small = np.full(5, 1e-8)
    for _ in range(ROUNDS):
        emit = (weight[feature].sum(1))[inside] + bias
        marginal, moved, _ = _dense(emit, mask, moves)
        gap = np.where(mask, tag - marginal, 0)
        by_word = np.bincount(inside.ravel(), gap.ravel(), len(used))
        grad = np.zeros(len(named))
        for k in range(_FEATURES):
            grad += np.bincount(feature[:, k], by_word, len(named))
        grad /= tokens
        slope += grad * grad
        rate = STEP / np.sqrt(slope)
        weight = weight + rate * grad
        weight = np.sign(weight) * np.maximum(abs(weight) - rate * L1, 0)
        weight[zero] = 0
        other = np.append(((seen_moves - moved) / tokens).ravel(), gap.sum() / tokens)
        small += other * other
        step = STEP * other / np.sqrt(small)
        moves, bias = np.clip(moves + step[:4].reshape(2, 2), -5, 5), bias + step[4]
    heavy = dict(zip(named[some := np.flatnonzero(abs(weight) > 1e-3)].tolist(), weight[some].tolist(), strict=True))
    rows = np.flatnonzero(np.isin(each, list(heavy)).any(axis=1))
    weights = {name: heavy[h] for r in rows for name, h in zip(features(known[r]), each[r].tolist(), strict=True) if h in heavy}
    extra = np.zeros(len(known))
    extra[rows] = [sum([weights.get(f, 0.0) for f in features(known[r])]) for r in rows]
    return Model(weights, moves, float(bias), (0.0,) * 4), extra


def held_out(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model to a bounded sample of the labelled documents that are not held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_TOXIC).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("n").alias("n")).collect()
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        total += r.n or 0
        if total <= TRAIN_BYTES:
            kept.append((r.doc_id, r.toxic))
    kept = docs.sparkSession.createDataFrame(kept, "doc_id long, toxic int")
    # of rows that repeat a doc_id, the least text
    rows = texts.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text or ""))
    labels_, rows = [r.toxic for r in rows], rows[::-1]
    # each text is let go once it is read
    return fit(((rows.pop().text or "").encode() for _ in labels_), labels_, share)


_WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _scored(model: Broadcast, names: list[str], spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        memory = m.memory()
        for batch in few(batches):
            scores, offending = [], []
            for text in as_bytes(batch.column("text")):
                score, places = m.score(emissions(memory, words_of(text)))
                scores.append(score)
                if spans:
                    offending.append(_offsets(text, places.tolist()))
            more = [pa.array(offending, kind)] if spans else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64()), *more], [*names, "score", *(["spans"] if spans else [])])

    return run


def _offsets(text: bytes, places: list[int]) -> list[dict]:
    """Code-point offsets of words by their place in the text."""
    if not places:
        return []
    wanted, out = set(places), []
    for k, w in enumerate(_WORD.finditer(text)):
        if k in wanted:
            start = len(text[: w.start()].decode("utf-8", "replace"))
            out.append({"start": start, "end": start + len(w[0].decode("utf-8", "replace"))})
    return out


def scored(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """docs with a score (0 to 1) and the spans of its offending words (code points, end exclusive)."""
    docs = docs.drop("score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields]).add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    return docs.mapInArrow(_scored(shared, docs.columns, spans), schema)
