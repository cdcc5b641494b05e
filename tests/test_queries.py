"""Every query against its SQL at the smallest scale, and known values at the next."""

import math

import duckdb
import numpy as np
import pytest

from sightline.operators import matching
from sightline.plans import fixtures as fx
from sightline.plans.queries import ORACLE, QUERIES, det, pkt

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TINY}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, TINY)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, TINY).count() > 0


def test_half_floats_of_all_rows_and_elements(spark, tmp_path):
    edge = np.array([0.0, -0.0, 1e-8, 2.0**-25, 6e-8, 5e-5, 2.0**-14, 0.1, 1 + 2.0**-11, 1 + 3 * 2.0**-11, 65504, 65519, 65520, 1e6, -1e6, 3e38, np.inf, -np.inf], np.float32)
    vectors = {0: np.resize(edge, 64), 1: (np.arange(64, dtype=np.float32) + np.float32(0.5)) / np.float32(8192), 2: np.linspace(-3, 3, 64, dtype=np.float32)}
    spark.createDataFrame([(k, x.tolist(), 0) for k, x in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with np.errstate(over="ignore"):
        want = {k: x.astype(np.float16).astype(np.float32).tobytes() for k, x in vectors.items()}
    got = QUERIES["half_floats_all"](spark, str(tmp_path)).collect()
    assert {r.vec_id: np.array(r.half, np.float32).tobytes() for r in got} == want
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect()}
    got = QUERIES["half_floats_all"](spark, TINY).collect()
    assert len(got) == len(rows) and all(r.half == np.array(rows[r.vec_id], np.float32).astype(np.float16).tolist() for r in got)


def test_cosine_search_meets_all_rows(spark):
    from sightline.functions import vectors as v

    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {int(i): ids[np.argsort(-(u @ u[k]), kind="stable")[:3]].tolist() for k, i in enumerate(ids) if i % 50 == 0}
    got = {}
    for r in sorted(QUERIES["cosine_search"](spark, TINY).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want and any(i >= 20 for found in want.values() for i in found[1:])
    e = spark.read.parquet(f"{TINY}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert {(r.query_id, r.rank, r.vec_id) for r in v.searched(asked, e.repartition(3), 3, block=4).collect()} == {(i, k + 1, f) for i, found in want.items() for k, f in enumerate(found)}


def hourly(spark, make):
    return fx.view(spark, SMALL, lambda engine, events: make(engine, events, hourly=True))


def test_fixture_checksums(spark):
    total = lambda df, e: df.selectExpr(e).first()[0]
    assert total(hourly(spark, fx.det), "sum(det_id * frame_no)") == 23974139546
    assert total(hourly(spark, fx.gt), "sum(gt_id * frame_no)") == 154416831
    assert total(hourly(spark, fx.hyp), "sum(track_id * frame_no)") == 1409404014
    assert total(pkt(spark, SMALL), "sum(seq16 * arrival_no)") == 49821125396


def test_known_suppression(spark):
    kept = matching.suppress(hourly(spark, fx.det), 0.45).selectExpr("count(*)", "sum(det_id)").first()
    assert tuple(kept) == (9801, 49052073)


def test_known_tracking_metrics(spark):
    rows = {r.stream_id: r for r in matching.mota_summary(hourly(spark, fx.hyp), hourly(spark, fx.gt)).collect()}
    want = {0: (635, 1430, 1209, 87, 221, 76, 76, 30, 8, 0, 731469, 872434), 1: (641, 1515, 1269, 105, 246, 76, 76, 31, 7, 0, 718152, 872059), 2: (621, 1453, 1219, 107, 234, 74, 74, 27, 10, 0, 714384, 871198), 3: (611, 1407, 1180, 97, 227, 74, 74, 29, 8, 0, 717129, 869121)}
    for k, w in want.items():
        r = rows[k]
        assert (r.frames, r.n_gt, r.matches, r.fp, r.misses, r.switches, r.fragmentations, r.mostly_tracked, r.partly_tracked, r.mostly_lost, round(r.mota * 1e6), round(r.motp * 1e6)) == w
        assert (r.missed, r.fp_tracks) == (0, 0)


def test_entry_without_the_training_data_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_partitioning_and_order_do_not_matter(spark):
    from sightline.operators import steps
    from sightline.operators.fold import ordered_scan

    d = det(spark, TINY)
    for f in (lambda x: matching.suppress(x, 0.45), lambda x: matching.fuse(x), lambda x: ordered_scan(x.selectExpr("stream_id", "det_id AS frame_no", "conf AS area"), ["stream_id"], ["frame_no"], steps.MotionSkip, "stream_id long, frame_no long, skipped boolean")):
        one, many = f(d.coalesce(1)), f(d.orderBy("conf").repartition(7))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_engines():
    assert set(fx.ENGINES) == {"spark", "duckdb"}
