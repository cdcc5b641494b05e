"""Filter audit, fingerprints and hard negatives against brute force, with nulls, odd texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from sightline.llm import filter_audit, negatives, queries, sketches

DOCS = "doc_id long, text string, source string, n_chars long, good boolean, failures int, part string, digest binary"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gámma", "DELTA", "x#y", "straightforwardly", "straightforwardlx"]) for _ in range(n))
    same, varied = say(80), " ".join(f"word{i}" for i in range(70))
    texts = [None, "", " \n\t", "a", "é" * 40, same, same, varied, varied, varied, "ABC " * 60, "A\x85B C\xa0D " * 30, "=" * 900, say(20_000), "\U0001f600" * 31, "a b\x00c\x1fd " * 20]
    texts += [say(rng.randrange(1, 120)) for _ in range(30)] + [" ".join(f"{k}w{i}" for i in range(60)) for k in range(6)]
    rows = [(i, t, rng.choice(["p", "q", None, "hot", "hot"]), 3, True, 7, "part", b"d") for i, t in enumerate(texts)]
    rows += [(None, same, "p", 1, False, 1, "x", b""), (None, None, "q", 1, False, 1, "x", b""), (5, same, "hot", 1, False, 1, "x", b""), (5, same, "hot", 1, False, 1, "x", b""), (7, "other text of seven", "p", 1, False, 1, "x", b"")]
    return rows


LABELS = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 50, 2)] + [(6, None, None), (4, 1, 0), (None, 1, 1), (10_000, 1, 1)]


def audited(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    parts = {}
    for i, t, source, *_ in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts.setdefault(source or "", []).append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out, total = {}, {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                kept = [d for d in left if f not in d[0]]
                out[part, order, step] = [len(kept), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
                left = kept
    return {(p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_filter_audit(spark, table, monkeypatch, collide):
    if collide:  # all hashes are one: bytes decide
        monkeypatch.setattr(filter_audit, "mix", lambda x: x * np.uint64(0))
        column = pa.array([r[1] for r in table])
        got = filter_audit.counted(*filter_audit.buffers(column.slice(2, 40)))
        assert [tuple(map(int, x)) for x in zip(*got, strict=True)] == [(len(words(t)), len(set(words(t))), len(t), len(re.findall("[A-Z]", t)), len(re.findall(r"[#$%&*|]", t))) for t in ((r[1] or "") for r in table[2:42])]
        return
    docs = spark.createDataFrame(table, DOCS).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(rows) == 600 * 4 and set(rows) == audited(table, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {r[7] for r in filter_audit.audit(docs, labels.limit(0)).collect()} == {0}


def test_prefix_sums_count_what_python_counts():
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choices(" ab\nA#é\x85\x1c", k=rng.choice([0, 1, 2, 9, 60]))) for _ in range(rng.randrange(1, 9))]
        got = filter_audit.counted(*filter_audit.buffers(pa.array(texts)))
        assert [tuple(map(int, x)) for x in zip(*got, strict=True)] == [(len(words(t)), len(set(words(t))), len(t), t.count("A"), t.count("#")) for t in texts]


def plain_sketch(text):
    if not text:
        return []
    k = sketches.SHINGLE
    each = {int(sketches.shingle_hashes([text[i : i + k]])[0][0]) for i in range(max(1, len(text) - k + 1))}
    kept = [h for h in each if h < (1 << 64) // sketches.FRACTION] or [min(each)]
    return sorted({h >> 24 for h in kept})


def near(a, b):
    return len(set(a) & set(b)) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def compared(rows):
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = map(plain_sketch, (t, e, after))
        spell = lambda s: "".join(f"{x:010x}" for x in s)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), spell(a), spell(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_fingerprints_of_neighbours(spark, table, parts):
    rows = [r for r in table if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sketches.neighbours_compared(docs, parts)
    assert sorted(map(tuple, got.collect()), key=repr) == compared(rows)


def test_fingerprints_of_few_documents(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sketches.neighbours_compared(docs([])).count() == 0
    for rows in ([(4, "one lone document that is its own neighbour")], [(None, "x" * 40), (None, "y" * 41)], [(2, None), (1, "a short one"), (2, "")], [(9, "same text in both of them"), (8, "same text in both of them")]):
        assert sorted(map(tuple, sketches.neighbours_compared(docs(rows), 3).collect()), key=repr) == compared(rows)


def test_sketches_estimate_containment_and_merge(spark):
    rng = random.Random(2)
    # random words, so that places share no shingle by chance
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    small, large = text(400), text(20_000)
    held = large[:60_000] + small[: len(small) // 2] + large[60_000:]
    pair = spark.createDataFrame([(0, small), (1, held), (2, large), (3, small + " " + large), (4, "tiny"), (5, "")], "doc_id long, text string")
    fp = {r.doc_id: r.fingerprint for r in sketches.fingerprints(pair).collect()}
    a = [plain_sketch(t) for t in (small, held, large)]
    assert abs(near(a[0], a[1]) - 0.5) < 0.12 and near(a[0], a[2]) < 0.02 and near(a[1], a[2]) > 0.97
    both = spark.createDataFrame([(fp[0], fp[1], fp[2], fp[3], fp[4], fp[5])], "a string, b string, c string, d string, e string, f string")
    F = sketches.F
    one = both.select(*[sketches.containment(F.col(x), F.col(y)) for x, y in ("ab", "ac", "ff", "af")], sketches.merged(F.col("a"), F.col("c")), sketches.merged(F.col("e"), F.col("f")), sketches.merged(F.col("e"), F.col("a"))).first()
    assert one[:4] == (near(a[0], a[1]), near(a[0], a[2]), 1.0, 0.0) and one[5] == fp[4] and one[6] == fp[0]
    # all shingles of the joined text but those across the border
    spelled = lambda x: {x[k : k + 10] for k in range(0, len(x), 10)}
    assert spelled(one[4]) <= spelled(fp[3]) and len(spelled(fp[3])) - len(spelled(one[4])) <= 16


def mined(rows, every=4, k=5, m=3):
    kept = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, (label, q) in kept.items():
        if i % every:
            continue
        scored = sorted((-dot(q, r), j, other == label) for j, (other, r) in kept.items() if j != i)
        for s, j, _ in [x for x in scored if x[2]][:k]:
            p = -s
            found = [(-t, n) for t, n, same in scored if not same and 50 * p <= 100 * -t <= 95 * p][:m]
            out |= {(i, j, rank, n, p, t) for rank, (t, n) in enumerate(found, 1)}
    return out


ROWS = "vec_id long, label int, embedding array<float>, cell int, score long, rank int"


def vectors_of(rng, n, dim=6, labels=3):
    centres = rng.normal(size=(5, dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(5)] + 0.3 * rng.normal(size=dim)
        out.append([i, int(rng.integers(labels)), (v / np.linalg.norm(v)).astype(np.float32).tolist(), 1, 2, 3])
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    rows = vectors_of(rng, 400)
    for i in range(100, 220):  # a hot vector
        rows[i][2] = rows[100][2]
    rows[5][2] = [float("nan")] * 6
    rows[6][2], rows[8][1], rows[9][2] = None, None, [1.0, None, 0.0, 0.0, 0.0, 0.0]
    rows[12][2], rows[16][2], rows[20][2] = [float("inf")] + [0.0] * 5, [0.0] * 6, [0.5, 0.25]
    rows += [[24, 0, rows[24][2], 1, 2, 3], [24, 2, rows[25][2], 1, 2, 3], [None, 1, rows[1][2], 1, 2, 3], rows[40], rows[44]]
    if small:
        for name, value in (("PIVOTS", 12), ("SAMPLE", 40), ("GROUP", 7), ("SLICE", 90)):
            monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = negatives.mined(df, negatives.F.col("vec_id") % 4 == 0)
    assert {tuple(r) for r in got.collect()} == mined(rows) and got.count() == len(mined(rows))
    assert negatives.mined(df.limit(0), negatives.F.col("vec_id") % 4 == 0).count() == 0
    assert negatives.mined(df.where("vec_id < 2"), negatives.F.col("vec_id") % 4 == 0).count() == 0


def test_bounds_send_less_and_lose_nothing(spark, monkeypatch):
    for name, value in (("PIVOTS", 16), ("SAMPLE", 200), ("GROUP", 10), ("SLICE", 1000)):
        monkeypatch.setattr(negatives, name, value)
    sent = []
    inner = negatives.Join.from_abroad
    monkeypatch.setattr(negatives.Join, "from_abroad", lambda self, anchors: sent.append((out := inner(self, anchors)).count() / self.rows.count() / (self.groups - 1)) or out)
    rng = np.random.default_rng(4)
    rows = []
    for c in range(20):  # clusters far from each other
        middle = 4 * rng.normal(size=12)
        rows += [[c * 30 + i, int(rng.integers(2)), (middle + 0.2 * rng.normal(size=12)).astype(np.float32).tolist(), 1, 2, 3] for i in range(30)]
    got = negatives.mined(spark.createDataFrame(rows, ROWS), negatives.F.col("vec_id") % 4 == 0)
    assert {tuple(r) for r in got.collect()} == mined(rows)
    assert len(sent) == 2 and sent[0] < 0.5


def test_products_of_large_integers_are_exact():
    a = np.array([[(1 << 27) - 1, 1, -((1 << 27) - 1)]], "<i4")
    b = np.array([[(1 << 27) - 1, 1, 3], [5, 7, 11]], "<i4")
    scores, _ = negatives._products(a, b, False)
    assert scores.tolist() == [[sum(x * y for x, y in zip(a[0].tolist(), r.tolist(), strict=True)) for r in b]]


def test_groups_cover_all_cells_once():
    rng = np.random.default_rng(1)
    counts, pivots = rng.integers(0, 30, 40), rng.normal(size=(40, 3))
    counts[7] = 1000
    first, n = negatives.grouped(counts, pivots, 50)
    assert n[7] == 20 and all(n[np.arange(40) != 7] == 1)
    held = {}
    for c in range(40):
        for g in range(first[c], first[c] + n[c]):
            held[g] = held.get(g, 0) + counts[c] / n[c]
    assert sorted(held) == list(range(max(held) + 1)) and max(held.values()) <= 50


def test_queries_read_whole_tables(spark, table, tmp_path):
    spark.createDataFrame(table, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {tuple(r) for r in queries.op13_filter_audit(spark, str(tmp_path)).collect()} == audited(table, LABELS)
    assert sorted(map(tuple, queries.op12_fingerprints(spark, str(tmp_path)).drop("none").collect()), key=repr) == compared(table)
    rows = vectors_of(np.random.default_rng(9), 300, 8, 10)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [[i, (label + 1) % 10 if i % 7 == 0 else label, v] for i, label, v, *_ in rows]
    assert {tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect()} == mined(moved, 50)
