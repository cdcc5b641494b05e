"""One query for each operator, on the fixture views, and DuckDB SQL for the same rows.

Floats leave as floor(x * 1e6 + 0.5), so that both engines give equal integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions import vectors as v
from sightline.operators import matching as m
from sightline.operators import series as s
from sightline.operators import scan, steps
from sightline.operators.fold import ordered_scan
from sightline.plans import fixtures as fx

#: Rows of a key beyond which its series is cut into blocks, small enough that streams of the test tables are; scan.BLOCK_ROWS is what long series take.
SCAN_ROWS = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def q6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


def q(expr: str, name: str) -> str:
    return f"CAST(floor(({expr}) * 1e6 + 0.5) AS BIGINT) AS {name}"


def boxed(b: dict[str, Column]) -> list[Column]:
    return [q6(b[k]).alias(k) for k in g.SIDES]


def det(spark, d):
    return fx.view(spark, d, fx.det)


def gt(spark, d):
    return fx.view(spark, d, fx.gt)


def hyp(spark, d):
    return fx.view(spark, d, fx.hyp)


def pkt(spark, d):
    return fx.view(spark, d, fx.pkt)


def sample(spark, d):
    return fx.view(spark, d, fx.sample)


def clock(spark, d):
    return fx.view(spark, d, fx.clock)


def embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


DET, GT, HYP, PKT, SAMPLE, CLOCK = (f"({f('duckdb')})" for f in (fx.det, fx.gt, fx.hyp, fx.pkt, fx.sample, fx.clock))
_CLIP = "greatest(0.0, least(1.0, {}))".format


def _overlap(a: str, b: str) -> tuple[str, str]:
    return f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))", f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


def _iou(a: str, b: str) -> str:
    w, h = _overlap(a, b)
    return f"(CASE WHEN {w} < 0 OR {h} < 0 THEN 0.0::DOUBLE ELSE {w} * {h} / ({_area(a)} + {_area(b)} - {w} * {h}) END)"


def _iou_nms(a: str, b: str) -> str:
    w, h = _overlap(a, b)
    inter = f"(greatest(0.0::DOUBLE, {w}) * greatest(0.0::DOUBLE, {h}))"
    return f"({inter} / ({_area(a)} + {_area(b)} - {inter} + 1e-7::DOUBLE))"


# projections and filters


@query(f"""SELECT det_id, cl, {q('conf', 'conf')}, {', '.join(q(e, n) for e, n in (('cx - w / 2', 'x0'), ('cy - h / 2', 'y0'), ('cx + w / 2', 'x1'), ('cy + h / 2', 'y1')))}
FROM (SELECT det_id, cl, conf, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h FROM {DET} d) t WHERE conf > 0.5""")
def det_decode(spark, d):
    """Rows of centre and size that are sure enough, as corners."""
    raw = det(spark, d).selectExpr("det_id", "cl", "conf", "(x0 + x1) / 2 AS cx", "(y0 + y1) / 2 AS cy", "x1 - x0 AS w", "y1 - y0 AS h")
    return raw.where("conf > 0.5D").select("det_id", "cl", q6(F.col("conf")).alias("conf"), *boxed(g.corners(*map(F.col, ("cx", "cy", "w", "h")))))


@query("SELECT det_id, " + ", ".join(q(_CLIP(f"{o} + {c} * {k}"), c) for c, o, k in (("x0", 0.1, 1.2), ("y0", 0.05, 1.1), ("x1", 0.1, 1.2), ("y1", 0.05, 1.1))) + f" FROM {DET} d")
def det_scale_clip(spark, d):
    """P2"""
    return det(spark, d).select("det_id", *boxed(g.scaled(g.box(), 1.2, 1.1, 0.1, 0.05)))


@query("SELECT det_id, " + ", ".join(q(_CLIP(f"({c} - {o}) * {k}"), c) for c, o, k in (("x0", 0.1, 1.25), ("y0", 0.05, 1.5), ("x1", 0.1, 1.25), ("y1", 0.05, 1.5))) + f" FROM {DET} d")
def det_offset_scale(spark, d):
    """P3"""
    return det(spark, d).select("det_id", *boxed(g.unscaled(g.box(), 1.25, 1.5, 0.1, 0.05)))


@query("SELECT det_id, " + ", ".join(q(_CLIP(f"{o} + {c} * ({e} - {o})"), c) for c, o, e in (("x0", 0.2, 0.7), ("y0", 0.1, 0.9), ("x1", 0.2, 0.7), ("y1", 0.1, 0.9))) + f" FROM {DET} d")
def det_unmap_roi(spark, d):
    """P4"""
    return det(spark, d).select("det_id", *boxed(g.unmapped(g.box(), {"x0": F.lit(0.2), "y0": F.lit(0.1), "x1": F.lit(0.7), "y1": F.lit(0.9)})))


@query(f"SELECT det_id, ['person', 'face', 'vehicle'][cl + 1] AS name, {q('(x1 - x0) * (y1 - y0) * conf', 'clip_quality')} FROM {DET} d WHERE cl IN (0, 1)")
def class_names(spark, d):
    """P7, P17, F2"""
    names = F.array(*map(F.lit, ("person", "face", "vehicle")))
    return det(spark, d).where("cl IN (0, 1)").select("det_id", names[F.col("cl")].alias("name"), q6(g.clip_quality(g.box(), F.col("conf"))).alias("clip_quality"))


_POSE = [(0.5, 0.1), (0.45, 0.08), (0.55, 0.08), (0.2, 0.5), (1.1, 0.5)]
_POSE_SQL = "[" + ", ".join(f"{{'x': x0 + (x1 - x0) * {a}, 'y': y0 + (y1 - y0) * {b}, 'conf': ((det_id * 31 + {j} * 17) % 100) / 100.0::DOUBLE}}" for j, (a, b) in enumerate(_POSE)) + "]"


def points(shift: float = 0.0) -> Column:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.array(*[F.struct((F.col("x0") + w * (a + shift)).alias("x"), (F.col("y0") + h * b).alias("y"), (F.pmod(F.col("det_id") * 31 + j * 17, F.lit(100)) / 100.0).alias("conf")) for j, (a, b) in enumerate(_POSE)])


@query(f"""WITH p AS (SELECT *, {_POSE_SQL} AS pts FROM {DET} d), k AS (SELECT *, list_filter(pts, lambda z: z.conf > 0.05) AS sure FROM p)
SELECT det_id, {q('conf + 0.004 * list_sum(list_transform(pts, lambda z: z.conf))', 'sure')}, {q('least(x0, list_min(list_transform(sure, lambda z: z.x)))', 'x0')},
{q('least(y0, list_min(list_transform(sure, lambda z: z.y)))', 'y0')}, {q('greatest(x1, list_max(list_transform(sure, lambda z: z.x)))', 'x1')}, {q('greatest(y1, list_max(list_transform(sure, lambda z: z.y)))', 'y1')} FROM k""")
def pose_box(spark, d):
    """P8"""
    rows = det(spark, d).withColumn("pts", points())
    return rows.select("det_id", q6(g.pose_confidence(F.col("conf"), F.col("pts"))).alias("sure"), *boxed(g.pose_box(g.box(), F.col("pts"))))


_ROI = f"(SELECT stream_id, frame_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {DET} d GROUP BY stream_id, frame_no)"


def frame_roi(spark, d):
    return det(spark, d).groupBy("stream_id", "frame_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(f"SELECT stream_id, frame_no, {', '.join(q(c, c) for c in g.SIDES)}, {q('(x1 - x0) * (y1 - y0)', 'area')} FROM {_ROI} r")
def roi_union(spark, d):
    """P13, A7"""
    return frame_roi(spark, d).select("stream_id", "frame_no", *boxed(g.box()), q6(g.area(g.box())).alias("area"))


def _shift(a: str, b: str, n: str) -> tuple[str, str]:
    start, end = f"(({a} + {b}) * 0.5 - {n} * 0.5)", f"(({a} + {b}) * 0.5 + {n} * 0.5)"
    end1 = f"(CASE WHEN {start} < 0 THEN {end} - {start} ELSE {end} END)"
    return f"(CASE WHEN {end1} > 1 THEN greatest({start}, 0.0) - ({end1} - 1) ELSE greatest({start}, 0.0) END)", f"least({end1}, 1.0)"


_NW, _NH = "greatest(x1 - x0, (y1 - y0) * 0.5625)", "greatest(y1 - y0, (x1 - x0) / 0.5625)"
_ASPECT = {"x0": _shift("x0", "x1", _NW)[0], "x1": _shift("x0", "x1", _NW)[1], "y0": _shift("y0", "y1", _NH)[0], "y1": _shift("y0", "y1", _NH)[1]}


@query("SELECT det_id, " + ", ".join(q(f"CASE WHEN {_NW} > 1 OR {_NH} > 1 THEN {0 if c[1] == '0' else 1} ELSE {_ASPECT[c]} END", c) for c in g.SIDES) + f" FROM {DET} d")
def roi_aspect(spark, d):
    """P14"""
    return det(spark, d).select("det_id", *boxed(g.to_aspect(g.box(), 0.5625)))


@query(f"""WITH c AS (SELECT det_id, CAST(trunc(x0 * 1279) AS INT) AS ax, CAST(ceil(x1 * 1279) AS INT) AS bx, CAST(trunc(y0 * 719) AS INT) AS ay, CAST(ceil(y1 * 719) AS INT) AS bz FROM {DET} d),
e AS (SELECT det_id, greatest(0, ax - ax % 2) AS x0, least(1279, bx + bx % 2) AS x1, greatest(0, ay - ay % 2) AS y0, least(719, bz + bz % 2) AS y1 FROM c)
SELECT det_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x0 + least(greatest(0, x1 - x0), 1279 - x0) AS INT) AS x1, CAST(y0 + least(greatest(0, y1 - y0), 719 - y0) AS INT) AS y1 FROM e""")
def crop_rounding(spark, d):
    """P15"""
    c = g.crop_pixels(g.box(), 1279, 719)
    return det(spark, d).select("det_id", *[c[k].alias(k) for k in g.SIDES])


@query(f"""WITH i AS (SELECT det_id, CAST(100 + det_id % 1900 AS INT) AS w, CAST(80 + det_id * 7 % 1300 AS INT) AS h FROM {DET} d),
a AS (SELECT *, CASE WHEN w > 1280 THEN 1280 ELSE w END AS rw, CASE WHEN w > 1280 THEN h * 1280 // w ELSE h END AS rh FROM i),
b AS (SELECT *, CASE WHEN rh > 720 THEN rw * 720 // rh ELSE rw END AS rw2, least(rh, 720) AS rh2 FROM a),
c AS (SELECT *, (rw2 + 16) - (rw2 + 16) % 32 AS rw3, (rh2 + 16) - (rh2 + 16) % 32 AS rh3 FROM b),
e AS (SELECT *, CASE WHEN rw3 > 1280 THEN rw3 - 32 ELSE rw3 END AS rw4, CASE WHEN rh3 > 720 THEN rh3 - 32 ELSE rh3 END AS rh4 FROM c)
SELECT det_id, CAST(CASE WHEN rw4 > 1152 AND w >= 1280 THEN 1280 ELSE rw4 END AS INT) AS fit_w, CAST(CASE WHEN rh4 > 648 AND h >= 720 THEN 720 ELSE rh4 END AS INT) AS fit_h FROM e""")
def fit_size(spark, d):
    """P16"""
    w, h = (100 + F.col("det_id") % 1900).cast("int"), (80 + F.col("det_id") * 7 % 1300).cast("int")
    fw, fh = g.fit_size(F.col("w"), F.col("h"), 1280, 720, stretch=10, round_w=32, round_h=32)
    return det(spark, d).select("det_id", w.alias("w"), h.alias("h")).select("det_id", fw.alias("fit_w"), fh.alias("fit_h"))


_CELLS = """CASE WHEN x1 > x0 AND y1 > y0 AND x0 < 1 AND y0 < 1 AND x1 > 0 AND y1 > 0 THEN
  flatten(list_transform(range(CAST(least(floor(greatest(y0, 0) * 8), 7) AS INT), CAST(greatest(ceil(least(y1, 1) * 8) - 1, 0) AS INT) + 1), lambda r:
    list_transform(range(CAST(least(floor(greatest(x0, 0) * 8), 7) AS INT), CAST(greatest(ceil(least(x1, 1) * 8) - 1, 0) AS INT) + 1), lambda c: r * 8 + c))) ELSE [] END"""


@query(f"""SELECT det_id, CAST(len(c) AS INT) AS n_cells, CAST(list_sum(c) AS BIGINT) AS cell_sum, CAST(coalesce(list_sum(list_transform(c, lambda k: 1::HUGEINT << CAST(k AS INT))), 0)
 - CASE WHEN list_contains(c, 63) THEN 18446744073709551616 ELSE 0 END AS BIGINT) AS mask FROM (SELECT det_id, {_CELLS} AS c FROM {DET} d) t""")
def mask_cells(spark, d):
    """P18"""
    rows = det(spark, d).select("det_id", g.cells(g.box()).alias("c"), g.cell_mask(g.box()).alias("mask"))
    return rows.select("det_id", F.size("c").alias("n_cells"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("cell_sum"), "mask")


@query(f"SELECT stream_id, frame_no, det_id AS id, 'det' AS side FROM {DET} d UNION ALL SELECT stream_id, frame_no, gt_id, 'gt' FROM {GT} g")
def detections_append(spark, d):
    """P19"""
    a = det(spark, d).select("stream_id", "frame_no", F.col("det_id").alias("id"), F.lit("det").alias("side"))
    return a.unionByName(gt(spark, d).select("stream_id", "frame_no", F.col("gt_id").alias("id"), F.lit("gt").alias("side")))


@query("SELECT stream_id, frame_no, " + ", ".join(q(_CLIP(f"{c} {'-' if c[1] == '0' else '+'} 0.05 * 0.5 * greatest(0.05, {c[0]}1 - {c[0]}0)"), c) for c in g.SIDES) + f" FROM {_ROI} r")
def search_roi(spark, d):
    """P20: the last step, over boxes that were predicted"""
    return s.predicted_roi(det(spark, d)).select("stream_id", "frame_no", *boxed(g.box()))


# joins and matching

_PAIRS = f"{DET} a JOIN {DET} b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND a.det_id < b.det_id"


def det_pairs(spark, d):
    return m.sides(det(spark, d), det(spark, d), "det_id", "det_id", ["cl"]).where("a_id < b_id")


@query(f"SELECT a.det_id AS a_id, b.det_id AS b_id, {q(_iou('a', 'b'), 'iou')} FROM {_PAIRS} WHERE {_iou('a', 'b')} > 0")
def iou_pairs(spark, d):
    """J3"""
    return det_pairs(spark, d).withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where("iou > 0").select("a_id", "b_id", q6(F.col("iou")).alias("iou"))


@query(f"SELECT a.det_id AS a_id, b.det_id AS b_id, {q(_iou_nms('a', 'b'), 'iou')} FROM {_PAIRS} AND a.cl = b.cl WHERE {_iou_nms('a', 'b')} > 0.45")
def iou_pairs_nms_eps(spark, d):
    """J4"""
    rows = det_pairs(spark, d).where("a_cl = b_cl").withColumn("iou", g.iou_suppression(g.box("a_"), g.box("b_"))).where("iou > 0.45D")
    return rows.select("a_id", "b_id", q6(F.col("iou")).alias("iou"))


_WP, _HP = "((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 640 + 1)", "((least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 640 + 1)"
_AP = lambda t: f"((({t}.x1 - {t}.x0) * 640 + 1) * (({t}.y1 - {t}.y0) * 640 + 1))"


@query(f"SELECT a.det_id AS a_id, b.det_id AS b_id, {q(f'{_WP} * {_HP} / ({_AP("a")} + {_AP("b")} - {_WP} * {_HP})', 'iou')} FROM {_PAIRS} WHERE {_WP} > 0 AND {_HP} > 0")
def iou_pairs_pixels(spark, d):
    """J5"""
    return det_pairs(spark, d).withColumn("iou", g.iou_pixels(g.box("a_"), g.box("b_"))).where("iou > 0").select("a_id", "b_id", q6(F.col("iou")).alias("iou"))


@query(f"""WITH c AS (SELECT stream_id, frame_no, det_id, cl, unnest({_CELLS}) AS cell FROM {DET} d)
SELECT DISTINCT a.stream_id, a.frame_no, a.det_id AS a_id, b.det_id AS b_id FROM c a JOIN c b USING (stream_id, frame_no, cell) WHERE a.cl = 0 AND b.cl = 1""")
def mask_candidates(spark, d):
    """J1"""
    rows = det(spark, d)
    return m.mask_candidates(rows.where("cl = 0"), rows.where("cl = 1"), "det_id", "det_id")


def _greedy(pairs: str, order: str, columns: str, clash: str) -> str:
    """Recursive CTEs: `pairs` (k: its frame's key) in order; each taken unless it clashes with one in the list so far."""
    fields = ", ".join(f"'{c}': r.{c}" for c in columns.split(", "))
    return f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order}) AS rn FROM ({pairs}) p),
fold AS (SELECT k, CAST(1 AS BIGINT) AS n, [{{{fields}}}] AS kept FROM ranked r WHERE rn = 1
 UNION ALL SELECT f.k, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda z: {clash})) > 0 THEN f.kept ELSE list_append(f.kept, {{{fields}}}) END
 FROM fold f JOIN ranked r ON r.k = f.k AND r.rn = f.n + 1),
last AS (SELECT k, max_by(kept, n) AS kept FROM fold GROUP BY k), chosen AS (SELECT k, unnest(kept, recursive := true) FROM last)"""


_ONE = "z.a_id = r.a_id OR z.b_id = r.b_id"
_KEY = "{0}.stream_id * 1000000 + {0}.frame_no".format
_HG = f"SELECT {_KEY('a')} AS k, a.track_id AS a_id, b.gt_id AS b_id, {_iou('a', 'b')} AS score FROM {HYP} a JOIN {GT} b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no"


@query(_greedy(f"SELECT * FROM ({_HG}) t WHERE score >= 0.3", "a_id, score DESC, b_id", "a_id, b_id, score", _ONE) + f" SELECT k // 1000000 AS stream_id, k % 1000000 AS frame_no, a_id, b_id, {q('score', 'score')} FROM chosen")
def greedy_match(spark, d):
    """J2, J6, J9, U1"""
    rows = m.match_boxes(hyp(spark, d), gt(spark, d), "track_id", "gt_id", 0.3)
    return rows.select("stream_id", "frame_no", "a_id", "b_id", q6(F.col("score")).alias("score"))


_FACE = "[" + ", ".join(f"{{'x': x0 + (x1 - x0) * ({a} + {{0}}), 'y': y0 + (y1 - y0) * {b}, 'conf': ((det_id * 31 + {j} * 17) % 100) / 100.0::DOUBLE}}" for j, (a, b) in enumerate(_POSE)) + "]"
_SP = f"({_area('b')} * 0.53)"
_TERM = f"exp(-((z.a.x - z.b.x) * (z.a.x - z.b.x) + (z.a.y - z.b.y) * (z.a.y - z.b.y)) / (2.0 * {_SP} * z.s * z.s * 4 + 1e-7))"
_OKS_PAIRS = f"""SELECT a.k, a.det_id AS a_id, b.det_id AS b_id, list_sum(list_transform(list_filter([{', '.join(f"{{'a': a.p[{j + 1}], 'b': b.p[{j + 1}], 's': {sc}}}" for j, sc in enumerate(g.FACE_SCALES))}],
 lambda z: z.b.conf > 0.3), lambda z: {_TERM})) / (len(list_filter(b.p, lambda z: z.conf > 0.3)) + 1e-7) AS score
FROM (SELECT *, {_KEY('d')} AS k, {_FACE.replace('{0}', '0.0')} AS p FROM {DET} d WHERE cl = 0) a JOIN (SELECT *, {_KEY('d')} AS k, {_FACE.replace('{0}', '0.002')} AS p FROM {DET} d WHERE cl = 0) b
 ON a.k = b.k WHERE {_iou('a', 'b')} >= 0.1"""


@query(_greedy(f"SELECT * FROM ({_OKS_PAIRS}) t WHERE score >= 0.1", "a_id, score DESC, b_id", "a_id, b_id, score", _ONE) + f" SELECT k // 1000000 AS stream_id, k % 1000000 AS frame_no, a_id, b_id, {q('score', 'score')} FROM chosen")
def oks_match(spark, d):
    """J7, J8"""
    people = det(spark, d).where("cl = 0")
    a, b = people.withColumn("p", points()), people.withColumn("p", points(0.002))
    near = g.iou(g.box("a_"), g.box("b_")) >= 0.1
    score = F.when(near, g.point_similarity(F.col("a_p"), F.col("b_p"), g.FACE_SCALES, g.area(g.box("b_")))).otherwise(0.0)
    return m.match_boxes(a, b, "det_id", "det_id", 0.1, score, ["p"]).select("stream_id", "frame_no", "a_id", "b_id", q6(F.col("score")).alias("score"))


_W, _H = _overlap("a", "b")
_IOMA = f"(CASE WHEN {_W} <= 0 OR {_H} <= 0 THEN 0.0 ELSE {_W} * {_H} / least({_area('a')}, {_area('b')}) END)"
_PF = f"SELECT {_KEY('a')} AS k, a.det_id AS a_id, b.det_id AS b_id, b.conf AS b_conf, {_IOMA} AS score FROM {DET} a JOIN {DET} b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND a.cl = 0 AND b.cl = 1"


@query(_greedy(f"SELECT * FROM ({_PF}) t WHERE score >= 0.3", "a_id, score DESC, b_id", "a_id, b_id, b_conf", _ONE) + f" SELECT d.det_id, d.cl, c.b_id AS face_id, {q('c.b_conf', 'face_conf')} FROM {DET} d LEFT JOIN chosen c ON c.a_id = d.det_id WHERE d.cl <> 1")
def face_person_fuse(spark, d):
    """J10, J11"""
    return m.fuse(det(spark, d)).select("det_id", "cl", "face_id", q6(F.col("sub_conf")).alias("face_conf"))


@query(f"SELECT DISTINCT stream_id, track_id FROM {HYP} h UNION SELECT DISTINCT stream_id, gt_id * 10 FROM {GT} g")
def track_union(spark, d):
    """Ids of both sides, once"""
    a = hyp(spark, d).select("stream_id", "track_id").distinct()
    b = gt(spark, d).select("stream_id", (F.col("gt_id") * 10).alias("track_id")).distinct()
    return m.tracks_joined(a, b)


@query(f"SELECT DISTINCT h.stream_id, h.track_id FROM {HYP} h WHERE NOT EXISTS (SELECT 1 FROM {GT} g WHERE g.stream_id = h.stream_id AND g.gt_id * 10 = h.track_id)")
def track_difference(spark, d):
    """J14, A6"""
    b = gt(spark, d).select("stream_id", (F.col("gt_id") * 10).alias("track_id")).distinct()
    return m.tracks_without(hyp(spark, d).select("stream_id", "track_id").distinct(), b)


#: Tracks, and a second tracker's of the same objects: a little aside, and seen for one frame less, as many, or one more.
_TWICE = f"""a AS (SELECT stream_id, frame_no, track_id, x0, y0, x1, y1, frame_no - min(frame_no) OVER (PARTITION BY stream_id, track_id) AS age FROM {HYP} h),
h AS (SELECT * FROM a UNION ALL SELECT stream_id, frame_no, track_id + 1000000, x0 + (x1 - x0) * 0.02 * (track_id % 17), y0, x1 + (x1 - x0) * 0.02 * (track_id % 17), y1, age + track_id // 10 % 3 - 1 FROM a)"""


@query(f"""WITH {_TWICE},
p AS (SELECT a.stream_id, a.frame_no, CASE WHEN a.age > b.age THEN b.track_id ELSE a.track_id END AS gone FROM h a JOIN h b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND a.track_id < b.track_id WHERE {_iou('a', 'b')} > 0.7)
SELECT h.stream_id, h.frame_no, h.track_id FROM h WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.stream_id = h.stream_id AND p.frame_no = h.frame_no AND h.track_id = gone)""")
def duplicate_tracks(spark, d):
    """Of two tracks on one place the one seen for a shorter time goes, the first of equals"""
    first = F.min("frame_no").over(Window.partitionBy("stream_id", "track_id"))
    one = hyp(spark, d).withColumn("age", F.col("frame_no") - first).select("stream_id", "frame_no", "track_id", *g.SIDES, "age")
    aside = (F.col("x1") - F.col("x0")) * 0.02 * (F.col("track_id") % 17)
    two = one.withColumns({"x0": F.col("x0") + aside, "x1": F.col("x1") + aside, "age": F.col("age") + F.floor(F.col("track_id") / 10) % 3 - 1, "track_id": F.col("track_id") + 1_000_000})
    h = one.unionByName(two)
    return h.select("stream_id", "frame_no", "track_id").join(m.duplicate_tracks(h), ["stream_id", "frame_no", "track_id"], "left_anti")


# aggregations

_DK = f"(SELECT *, (stream_id * 1000000 + frame_no) * 8 + cl AS k FROM {DET} d)"
_NMS = _greedy(f"SELECT * FROM {_DK} e", "conf DESC, det_id", "det_id, conf, x0, y0, x1, y1", f"{_iou_nms('z', 'r')} > 0.45")


@query(_NMS + f" SELECT k // 8 // 1000000 AS stream_id, k // 8 % 1000000 AS frame_no, CAST(k % 8 AS INT) AS cl, det_id, {q('conf', 'conf')} FROM chosen")
def nms(spark, d):
    """A1, O1"""
    return m.suppress(det(spark, d), 0.45).select("stream_id", "frame_no", "cl", "det_id", q6(F.col("conf")).alias("conf"))


@query(_NMS + " SELECT k // 8 // 1000000 AS stream_id, k // 8 % 1000000 AS frame_no, CAST(k % 8 AS INT) AS cl, det_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conf DESC, det_id) AS r FROM chosen) t WHERE r <= 2")
def nms_topk(spark, d):
    """A2, A3, O7"""
    return m.suppress(det(spark, d), 0.45, most=2).select("stream_id", "frame_no", "cl", "det_id")


_MOTA = _greedy(f"SELECT * FROM ({_HG}) t WHERE score >= 0.5", "score DESC, a_id, b_id", "a_id, b_id, score", _ONE) + f""",
frames AS (SELECT k, row_number() OVER (PARTITION BY k // 1000000 ORDER BY k) AS frame_index FROM (SELECT {_KEY('h')} AS k FROM {HYP} h UNION SELECT {_KEY('g')} FROM {GT} g) u),
matched AS (SELECT c.*, c.k // 1000000 AS stream_id, frame_index, lag(a_id) OVER w AS before, lag(frame_index) OVER w AS at_ FROM chosen c JOIN frames USING (k) WINDOW w AS (PARTITION BY c.k // 1000000, b_id ORDER BY frame_index)),
marked AS (SELECT *, coalesce(before <> a_id, FALSE) AS switched, coalesce(before <> a_id AND frame_index - at_ > 1, FALSE) AS fragmented FROM matched),
counts AS (SELECT k, k // 1000000 AS stream_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_hyp, 0) AS n_hyp, coalesce(n, 0) AS matches, coalesce(t, 0) AS total_iou, coalesce(sw, 0) AS switches, coalesce(fr, 0) AS fragmentations
 FROM frames LEFT JOIN (SELECT {_KEY('g')} AS k, count(*) AS n_gt FROM {GT} g GROUP BY 1) g USING (k) LEFT JOIN (SELECT {_KEY('h')} AS k, count(*) AS n_hyp FROM {HYP} h GROUP BY 1) h USING (k)
 LEFT JOIN (SELECT k, count(*) AS n, sum(score) AS t, count_if(switched) AS sw, count_if(fragmented) AS fr FROM marked GROUP BY k) c USING (k)),
objects AS (SELECT stream_id, gt_id, count(*) AS frames, count(c.b_id) AS matched FROM {GT} g LEFT JOIN chosen c ON c.k = {_KEY('g')} AND c.b_id = g.gt_id GROUP BY stream_id, gt_id),
quality AS (SELECT *, CASE WHEN matched / frames::DOUBLE >= 0.8 THEN 'MT' WHEN matched / frames::DOUBLE >= 0.2 THEN 'PT' ELSE 'ML' END AS quality FROM objects)"""


@query(_MOTA + " SELECT stream_id, k % 1000000 AS frame_no, CAST(matches AS BIGINT) AS matches, CAST(n_hyp - matches AS BIGINT) AS fp, CAST(n_gt - matches AS BIGINT) AS misses, CAST(switches AS BIGINT) AS switches, CAST(fragmentations AS BIGINT) AS fragmentations FROM counts")
def mota_frame_counts(spark, d):
    """A4, J20"""
    return m.mota_frames(hyp(spark, d), gt(spark, d)).select("stream_id", "frame_no", "matches", "fp", "misses", "switches", "fragmentations")


_SUMMARY = """SELECT {by}CAST(count(*) AS BIGINT) AS frames, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(n_hyp - matches) AS BIGINT) AS fp, CAST(sum(n_gt - matches) AS BIGINT) AS misses,
 CAST(sum(switches) AS BIGINT) AS switches, CAST(sum(fragmentations) AS BIGINT) AS fragmentations, """ + ", ".join((q("sum(matches) / sum(n_gt)::DOUBLE", "recall"), q("sum(matches) / sum(n_hyp)::DOUBLE", "precision"), q("1 - sum(n_gt - matches + n_hyp - matches + switches) / sum(n_gt)::DOUBLE", "mota"), q("sum(total_iou) / sum(matches)", "motp"), q("2 * sum(matches) / (sum(n_gt) + sum(n_hyp))::DOUBLE", "idf1"))) + " FROM counts"  # fmt: skip
_OBJECTS = "SELECT {by}CAST(count(*) AS BIGINT) AS objects, CAST(count_if(quality = 'MT') AS BIGINT) AS mostly_tracked, CAST(count_if(quality = 'PT') AS BIGINT) AS partly_tracked, CAST(count_if(quality = 'ML') AS BIGINT) AS mostly_lost, CAST(count_if(matched = 0) AS BIGINT) AS missed FROM quality"
_LOST = f"SELECT {{by}}CAST(count(*) AS BIGINT) AS fp_tracks FROM (SELECT DISTINCT stream_id, track_id FROM {HYP} h EXCEPT SELECT k // 1000000, a_id FROM chosen) e"


def _measures(rows: DataFrame) -> DataFrame:
    return rows.select([q6(F.col(c)).alias(c) if c in ("recall", "precision", "mota", "motp", "idf1") else F.col(c) for c in rows.columns])


@query(_MOTA + f" SELECT a.*, o.* EXCLUDE (stream_id), coalesce(l.fp_tracks, 0) AS fp_tracks FROM ({_SUMMARY.format(by='stream_id, ')} GROUP BY stream_id) a JOIN ({_OBJECTS.format(by='stream_id, ')} GROUP BY stream_id) o USING (stream_id) LEFT JOIN ({_LOST.format(by='stream_id, ')} GROUP BY stream_id) l USING (stream_id)")
def mota_by_stream(spark, d):
    """A4-A6 of each stream"""
    return _measures(m.mota_summary(hyp(spark, d), gt(spark, d)))


@query(_MOTA + f" SELECT * FROM ({_SUMMARY.format(by='')}) a, ({_OBJECTS.format(by='')}) o, ({_LOST.format(by='')}) l")
def mota_summary(spark, d):
    """A5, D19 over all streams"""
    return _measures(m.mota_summary(hyp(spark, d), gt(spark, d), by=[]))


@query(_MOTA + " SELECT stream_id, gt_id, frames, matched, quality FROM quality")
def mota_track_quality(spark, d):
    """A5: mostly and partly tracked, mostly lost"""
    return m.mota_objects(hyp(spark, d), gt(spark, d))


@query(_MOTA + " SELECT stream_id, frame_index, a_id AS track_id, b_id AS gt_id, fragmented FROM marked WHERE switched")
def id_switches(spark, d):
    """W1"""
    return m.mota_matches(hyp(spark, d), gt(spark, d)).where("switched").select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("a_id").alias("track_id"), F.col("b_id").alias("gt_id"), "fragmented")


@query(_MOTA + " SELECT 'all' AS what, CAST((SELECT count(*) FROM objects) AS BIGINT) AS truths, CAST((SELECT count(DISTINCT (stream_id, b_id)) FROM marked) AS BIGINT) AS matched_truths" + f", CAST((SELECT count(DISTINCT (stream_id, track_id)) FROM {HYP} h) AS BIGINT) AS seen_tracks")
def distinct_ids(spark, d):
    """A6"""
    h, t = hyp(spark, d), gt(spark, d)
    one = lambda df, name, *c: df.agg(F.count_distinct(*c).alias(name)).withColumn("what", F.lit("all"))
    return one(t, "truths", "stream_id", "gt_id").join(one(m.mota_matches(h, t), "matched_truths", "stream_id", "b_id"), "what").join(one(h, "seen_tracks", "stream_id", "track_id"), "what")


_D, _K10 = s.DECAY, s.DECAY**s.EVERY


def _hist(base: float) -> str:
    part = "(v - 0.0) / 250.0"
    i = f"floor({part} * 40)" if base == 1.0 else f"CASE WHEN {part} <= 0 THEN 0 WHEN {part} >= 1 THEN 39 ELSE floor(ln({part} * {base**40 - 1!r} + 1) / ln({base}::DOUBLE)) END"
    return f"""WITH n AS (SELECT series, max(i) AS n FROM {SAMPLE} s GROUP BY series), b AS (SELECT series, i, CAST(least(greatest({i}, 0), 39) AS INT) AS bin FROM {SAMPLE} s),
h AS (SELECT series, bin, sum({1 - _D!r}::DOUBLE * pow({_K10!r}::DOUBLE, n // 10 - i // 10)) AS weight FROM b JOIN n USING (series) GROUP BY series, bin)"""


@query(_hist(1.0) + f" SELECT series, bin, {q('weight', 'weight')} FROM h")
def decayed_hist(spark, d):
    """A10"""
    return s.decayed_histogram(sample(spark, d), 0.0, 250.0).select("series", "bin", q6(F.col("weight")).alias("weight"))


@query(_hist(1.1) + f" SELECT series, bin, {q('weight', 'weight')} FROM h")
def decayed_hist_exponential(spark, d):
    """A10, bins that grow"""
    return s.decayed_histogram(sample(spark, d), 0.0, 250.0, 1.1).select("series", "bin", q6(F.col("weight")).alias("weight"))


@query(_hist(1.0) + f", c AS (SELECT series, bin, sum(weight) OVER (PARTITION BY series ORDER BY bin) AS cum, sum(weight) OVER (PARTITION BY series) AS total FROM h) SELECT series, {q('p', 'p')}, CAST(min(bin) AS INT) AS bin, {q('(min(bin) + 0.5) * 6.25', 'quantile')} FROM c, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS p) t WHERE cum >= p * total GROUP BY series, p")
def hist_quantiles(spark, d):
    """A11"""
    rows = s.quantiles(s.decayed_histogram(sample(spark, d), 0.0, 250.0), [0.1, 0.5, 0.9], 0.0, 250.0)
    return rows.select("series", q6(F.col("p")).alias("p"), "bin", q6(F.col("quantile")).alias("quantile"))


def _walk(source: str, key: str, order: str, start: str, step: str, out: str, where: str = "TRUE") -> str:
    """Recursive CTE over a key's rows in order; state columns in `start` (from row r) and `step` (from state f and row r)."""
    return f"""WITH RECURSIVE r0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source} s0),
fold AS (SELECT r.*, {start} FROM r0 r WHERE rn = 1 UNION ALL SELECT r.*, {step} FROM fold f JOIN r0 r ON {' AND '.join(f'r.{c} = f.{c}' for c in key.split(', '))} AND r.rn = f.rn + 1) SELECT {out} FROM fold WHERE {where}"""


@query(_walk(SAMPLE, "series", "i", "r.v::DOUBLE AS mean, greatest(0.01, 0.95)::DOUBLE AS rate", "f.mean + f.rate * (r.v - f.mean), greatest(0.01::DOUBLE, f.rate * 0.95::DOUBLE)", f"series, i, {q('mean', 'mean')}"))
def running_mean(spark, d):
    """A12"""
    rows = scan.scanned(sample(spark, d), ["series"], ["i"], scan.RunningMean(), SCAN_ROWS)
    return rows.select("series", "i", q6(F.col("mean")).alias("mean"))


@query(f"""SELECT f.stream_id, CAST(count(*) AS BIGINT) AS frames, CAST(sum(n) AS BIGINT) AS detections, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, {q('avg(n)', 'mean')}, {q('avg(area)', 'mean_area')}
FROM (SELECT stream_id, frame_no, count(*) AS n, avg((x1 - x0) * (y1 - y0)) AS area FROM {DET} d GROUP BY 1, 2) f GROUP BY 1""")
def stream_rollup(spark, d):
    """Two levels of pre-aggregated counts"""
    f = det(spark, d).groupBy("stream_id", "frame_no").agg(F.count(F.lit(1)).alias("n"), F.avg(g.area(g.box())).alias("area"))
    return f.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("detections"), F.min("n").alias("least"), F.max("n").alias("most"), q6(F.avg("n")).alias("mean"), q6(F.avg("area")).alias("mean_area"))


@query(f"SELECT n AS batch, CAST(count(*) AS BIGINT) AS batches, CAST(CASE WHEN n / 32.0 < 0.15 THEN 0 WHEN n / 32.0 < 0.3 THEN 1 ELSE 2 END AS INT) AS mode FROM (SELECT count(*) AS n FROM {DET} d GROUP BY stream_id, frame_no) f GROUP BY n")
def batch_sizes(spark, d):
    """A18, A24"""
    f = det(spark, d).groupBy("stream_id", "frame_no").agg(F.count(F.lit(1)).alias("batch"))
    return f.groupBy("batch").agg(F.count(F.lit(1)).alias("batches")).withColumn("mode", s.performance_mode(F.col("batch") / 32.0))


# vectors and audio

_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_UNIT = lambda a: f"list_transform({a}, lambda x: x::DOUBLE / sqrt({_DOT(a, a)}))"


@query(f"SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS i, CAST(floor(unnest(u) * 1e6 + 0.5) AS BIGINT) AS x FROM (SELECT vec_id, {_UNIT('embedding')} AS u FROM embeddings) t")
def l2_norm(spark, d):
    """F4, F5"""
    u = embeddings(spark, d).select("vec_id", F.posexplode(v.l2_normalized(F.col("embedding"))).alias("i", "x"))
    return u.select("vec_id", "i", q6(F.col("x")).alias("x"))


@query(f"""WITH m AS (SELECT label, list(mu ORDER BY i) AS e FROM (SELECT label, i, avg(x) AS mu FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings) z GROUP BY 1, 2) y GROUP BY 1),
s AS (SELECT a.vec_id, b.label AS prompt_id, {_DOT(_UNIT('a.embedding'), _UNIT('b.e'))} AS c FROM embeddings a, m b)
SELECT vec_id, CAST(r AS INT) AS rank, CAST(prompt_id AS BIGINT) AS prompt_id, {q('c', 'cosine')} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, prompt_id) AS r FROM s) t WHERE r <= 3""")
def cosine_topk(spark, d):
    """Every vector against a table of prompts, one for each label (the mean of its vectors)"""
    e = embeddings(spark, d)
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mu"))
    prompts = mean.groupBy(F.col("label").alias("prompt_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda p: p["mu"]).alias("embedding"))
    return v.nearest(e, prompts, 3).select("vec_id", "rank", "prompt_id", q6(F.col("cosine")).alias("cosine"))


@query(f"""WITH u AS (SELECT vec_id, {_UNIT('embedding')} AS u FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT('a.u', 'b.u')} AS c FROM u a, u b WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, {q('c', 'cosine')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS r FROM s) t WHERE r <= 3""")
def cosine_search(spark, d):
    """Every vector whose id is divisible by 50 against all vectors"""
    e = embeddings(spark, d)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return v.searched(queries, e, 3).select("query_id", "rank", "vec_id", q6(F.col("cosine")).alias("cosine"))


@query(f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings), mean AS (SELECT label, i, sum(x) / (count(*) + 1e-7) AS mu FROM e GROUP BY 1, 2),
c AS (SELECT vec_id, list(x - mu ORDER BY i) AS c FROM e JOIN mean USING (label, i) GROUP BY vec_id), u AS (SELECT vec_id, {_UNIT('c')} AS u FROM c) SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS i, CAST(floor(unnest(u) * 1e6 + 0.5) AS BIGINT) AS x FROM u""")
def reid_centered(spark, d):
    """F6, J22"""
    rows = v.centered(embeddings(spark, d), "embedding", ["label"])
    return rows.select("vec_id", F.posexplode("centered").alias("i", "x")).select("vec_id", "i", q6(F.col("x")).alias("x"))


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), p AS (SELECT vec_id, i, 1 / (1 + exp(-greatest(-50, least(50, x)))) AS p FROM e)
SELECT vec_id, CAST(r AS INT) AS rank, CAST(i AS INT) AS class, {q('p', 'prob')} FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM p) t WHERE r <= 5""")
def softmax_top(spark, d):
    """F8, O6, W7"""
    return v.top_k(embeddings(spark, d), ["vec_id"], "embedding", 5).select("vec_id", "rank", "class", q6(F.col("prob")).alias("prob"))


#: 360 logits of each vector: its 64 values, repeated with a growing weight.
_LOGITS = "list_transform(range(0, 360), lambda i: embedding[i % 64 + 1]::DOUBLE * (1 + 0.125::DOUBLE * (i // 64)))"
_SOFT = f"SELECT vec_id, i, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM (SELECT vec_id, unnest({_LOGITS}) AS x, unnest(range(0, 360)) AS i FROM embeddings) t"


def logits(spark, d):
    e = F.transform(F.sequence(F.lit(0), F.lit(359)), lambda i: F.col("embedding")[F.pmod(i, F.lit(64))].cast("double") * (1 + F.floor(i / 64) * F.lit(0.125)))
    return embeddings(spark, d).select("vec_id", e.alias("logits"))


@query(f"WITH p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ({_SOFT}) s) SELECT vec_id, {q('sum(p * 0.25 * (i % 5))', 'quality')} FROM p GROUP BY vec_id")
def fiqa_quality(spark, d):
    """A14, on all 360 = 3 * 2 * 3 * 2 * 2 * 5 cells"""
    return logits(spark, d).select("vec_id", q6(v.fiqa_quality(F.col("logits"))).alias("quality"))


@query(f"""WITH p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ({_SOFT}) s), a(axis, inner_, k) AS (VALUES (0, 120, 3), (1, 60, 2), (2, 20, 3), (3, 10, 2), (4, 5, 2), (5, 1, 5))
SELECT vec_id, CAST(axis AS INT) AS axis, CAST(i // inner_ % k AS INT) AS cell, {q('sum(p)', 'p')} FROM p, a GROUP BY vec_id, axis, i // inner_ % k""")
def fiqa_marginals(spark, d):
    """All six axes"""
    soft = logits(spark, d).select("vec_id", v.softmax(F.col("logits")).alias("p"))
    axes = F.array(*[v.marginal(F.col("p"), k, v.FIQA_AXES) for k in range(6)])
    each = soft.select("vec_id", F.posexplode(axes).alias("axis", "m")).select("vec_id", "axis", F.posexplode("m").alias("cell", "p"))
    return each.select("vec_id", "axis", "cell", q6(F.col("p")).alias("p"))


@query(f"SELECT vec_id, {q('list_sum(list_transform(range(1, 65), lambda i: least(1, 1.2 * abs(embedding[i]::DOUBLE)) * ((i % 4) * 0.5 + 0.1))) / list_sum(list_transform(range(1, 65), lambda i: (i % 4) * 0.5 + 0.1))', 'score')} FROM embeddings")
def attr_score(spark, d):
    """A16"""
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return embeddings(spark, d).select("vec_id", q6(v.attribute_score(a, [(i % 4) * 0.5 for i in range(1, 65)])).alias("score"))


_E2 = "list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))"


@query(f"SELECT vec_id, {q('list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))', 'peak')}, {q(_E2, 'energy')}, {q(f'sqrt({_E2} / 64)', 'rms')}, {q(f'-0.691 + 10 * log10({_E2} / 64)', 'lufs')} FROM embeddings")
def audio_levels(spark, d):
    """A13, D14"""
    levels = v.audio_levels(F.col("embedding"))
    return embeddings(spark, d).select("vec_id", *[q6(c).alias(n) for n, c in levels.items()])


@query(f"SELECT vec_id, CAST(f AS INT) AS frame, {q('(embedding[f * 4 + 1]::DOUBLE + embedding[f * 4 + 2]::DOUBLE) / 2', 'left_')}, {q('(embedding[f * 4 + 3]::DOUBLE + embedding[f * 4 + 4]::DOUBLE) / 2', 'right_')} FROM embeddings, range(0, 16) r(f)")
def channel_mix(spark, d):
    """four channels to two"""
    out = embeddings(spark, d).select("vec_id", v.remixed(F.col("embedding"), 4, 2).alias("o"))
    return out.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda f: F.struct(F.col("o")[f * 2].alias("l"), F.col("o")[f * 2 + 1].alias("r")))).alias("frame", "x")).select("vec_id", "frame", q6(F.col("x.l")).alias("left_"), q6(F.col("x.r")).alias("right_"))


_FQ = "p[1].conf * 0.5 + p[2].conf * 0.5"
_IOD = "sqrt((p[2].x - p[1].x) * (p[2].x - p[1].x) + (p[2].y - p[1].y) * (p[2].y - p[1].y))"
_FQ_SQL = f"""SELECT *, ({_FQ}) AS eyes, (({_FQ}) + p[3].conf + (p[4].conf + p[5].conf) * 0.5) / 3 AS overall, {_IOD} AS apart, abs(atan2(p[2].y - p[1].y, p[2].x - p[1].x)) / (30.0 * 3.141592653589793 / 180.0) AS tilt, abs(p[3].x - (p[1].x + p[2].x) * 0.5) / {_IOD} AS off_ FROM (SELECT *, {_POSE_SQL} AS p FROM {DET} d) t"""


@query(f"SELECT det_id, {q('CASE WHEN overall < 0.1 THEN 0 ELSE greatest(0, least(1, least(1, apart * 1.5) * eyes * CASE WHEN tilt >= 1 THEN 0.1 ELSE 1 - tilt END * CASE WHEN off_ >= 1 THEN 0.1 ELSE 1 - off_ END * overall * greatest(0, (conf - 0.75) / 0.15))) END', 'quality')} FROM ({_FQ_SQL}) z")
def face_quality(spark, d):
    """F1"""
    return det(spark, d).withColumn("p", points()).select("det_id", q6(g.face_quality(F.col("p"), F.col("conf"))).alias("quality"))


_NX, _NY = "((p[3].x - x0) / (x1 - x0) - 0.5)", "((p[3].y - y0) / (y1 - y0) - 0.5)"
_BF = f"0.3 * (p[1].conf + p[2].conf + p[3].conf + p[4].conf + p[5].conf) / 5 + 0.4 * greatest(0, 1 - 2 * sqrt({_NX} * {_NX} + {_NY} * {_NY})) + 0.3 * greatest(0, 1 - 2 * abs(((p[1].x - x0) / (x1 - x0) + (p[2].x - x0) / (x1 - x0)) / 2 - 0.5))"


@query(f"SELECT det_id, {q(f'CASE WHEN len(list_filter(p, lambda z: z.conf < 0.7)) > 0 THEN 0 ELSE greatest(0, least(1, {_BF})) END', 'score')} FROM (SELECT *, list_transform({_POSE_SQL}, lambda z: {{'x': z.x, 'y': z.y, 'conf': 0.6 + z.conf * 0.4}}) AS p FROM {DET} d) t")
def best_face_score(spark, d):
    """F3"""
    p = F.transform(points(), lambda x: F.struct(x["x"].alias("x"), x["y"].alias("y"), (F.lit(0.6) + x["conf"] * 0.4).alias("conf")))
    return det(spark, d).withColumn("p", p).select("det_id", q6(g.best_face(F.col("p"), g.box())).alias("score"))


# windows, packets, motion


@query(f"""WITH w AS (SELECT *, first_value(seq16) OVER o AS f, coalesce((((seq16 - lag(seq16) OVER o + 32768) % 65536) + 65536) % 65536 - 32768, 0) AS st FROM {PKT} p WINDOW o AS (PARTITION BY stream_id ORDER BY arrival_no))
SELECT stream_id, arrival_no, CAST(f + sum(st) OVER (PARTITION BY stream_id ORDER BY arrival_no) AS BIGINT) AS seq_ext FROM w""")
def seq_unwrap(spark, d):
    """W2"""
    return s.unwrapped(pkt(spark, d), SCAN_ROWS // 4).select("stream_id", F.col("arrival_no").cast("long").alias("arrival_no"), "seq_ext")


_EXT = f"""WITH w AS (SELECT *, first_value(ts32) OVER o AS f, coalesce((((ts32 - lag(ts32) OVER o + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648, 0) AS st FROM {PKT} p WINDOW o AS (PARTITION BY stream_id ORDER BY seq_no)),
x AS (SELECT stream_id, seq_no AS seq_ext, marker, CAST(f + sum(st) OVER (PARTITION BY stream_id ORDER BY seq_no) AS BIGINT) AS ts64 FROM w)"""


@query(_EXT + " SELECT stream_id, seq_ext AS seq_no, ts64 FROM x")
def ts_extend(spark, d):
    """W3"""
    return s.extended(pkt(spark, d), "seq_no", SCAN_ROWS // 4).select("stream_id", "seq_no", "ts64")


_AU = _EXT + """, n AS (SELECT *, coalesce(ts64 <> lag(ts64) OVER o OR lag(marker) OVER o, TRUE) AS new_, lag(seq_ext) OVER o AS pv FROM x WINDOW o AS (PARTITION BY stream_id ORDER BY seq_ext)),
u AS (SELECT *, CAST(sum(CASE WHEN new_ THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq_ext) AS BIGINT) AS au_no FROM n),
a AS (SELECT stream_id, au_no, min(ts64) AS ts64, count(*) AS packets, bool_and(new_ OR seq_ext = pv + 1) AS complete, bool_or(marker) AS marker FROM u GROUP BY 1, 2)"""


def units(spark, d):
    return s.access_units(s.extended(pkt(spark, d), "seq_no").withColumn("seq_ext", F.col("seq_no")))


@query(_AU + " SELECT * FROM a")
def au_assemble(spark, d):
    """W4, W5, R7"""
    return units(spark, d)


@query(_AU + ", g AS (SELECT stream_id, au_no, greatest(1, lead(ts64) OVER (PARTITION BY stream_id ORDER BY au_no) - ts64) AS dd, row_number() OVER (PARTITION BY stream_id ORDER BY au_no DESC) AS r FROM a) SELECT stream_id, au_no, CAST(CASE WHEN r = 1 THEN coalesce(floor(avg(CASE WHEN r > 1 THEN dd END) OVER (PARTITION BY stream_id)), 3003) ELSE dd END AS BIGINT) AS duration FROM g")
def sample_durations(spark, d):
    """W6, K2"""
    return s.sample_durations(units(spark, d)).select("stream_id", "au_no", "duration")


@query(f"""WITH w AS (SELECT *, max(seq_no) OVER (PARTITION BY stream_id ORDER BY arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {PKT} p)
SELECT stream_id, count(*) AS received, max(seq_no) - min(seq_no) + 1 AS expected, max(seq_no) - min(seq_no) + 1 - count(DISTINCT seq_no) AS missing, CAST(count_if(coalesce(seq_no < seen, FALSE)) AS BIGINT) AS out_of_order, CAST(sum(CASE WHEN marker THEN 1 ELSE 0 END) AS BIGINT) AS markers FROM w GROUP BY 1""")
def rtp_loss_stats(spark, d):
    """A17, R2, D11"""
    return s.loss_stats(pkt(spark, d))


REORDERED = "stream_id long, event string, seq16 long, n long, ts64 long"


@query()
def rtp_reorder(spark, d):
    """Events of the reorder buffer, in its own order"""
    return ordered_scan(pkt(spark, d).select("stream_id", F.col("arrival_no").cast("long").alias("arrival_no"), F.col("seq16").cast("long").alias("seq16"), "ts32"), ["stream_id"], ["arrival_no"], steps.Reorder, REORDERED)


_SSRC = f"(SELECT stream_id, arrival_no, CASE WHEN arrival_no % 701 > 690 THEN 8 WHEN arrival_no % 97 = 5 THEN 9 ELSE 7 END AS ssrc FROM {PKT} p)"


@query(_walk(_SSRC, "stream_id", "arrival_no", "r.ssrc AS cur, 0 AS cand, 0 AS cnt, TRUE AS accepted",
    "CASE WHEN r.ssrc <> f.cur AND r.ssrc = f.cand AND f.cnt + 1 >= 4 THEN r.ssrc ELSE f.cur END, CASE WHEN r.ssrc <> f.cur AND r.ssrc <> f.cand THEN r.ssrc ELSE f.cand END, CASE WHEN r.ssrc = f.cur THEN f.cnt WHEN r.ssrc <> f.cand THEN 1 WHEN f.cnt + 1 >= 4 THEN 0 ELSE f.cnt + 1 END, r.ssrc = f.cur OR (r.ssrc = f.cand AND f.cnt + 1 >= 4)",
    "stream_id, arrival_no, accepted"))
def ssrc_debounce(spark, d):
    """R3, Q19"""
    a = F.col("arrival_no").cast("long")
    rows = pkt(spark, d).select("stream_id", a.alias("arrival_no"), F.when(a % 701 > 690, 8).when(a % 97 == 5, 9).otherwise(7).cast("long").alias("ssrc"))
    return scan.scanned(rows, ["stream_id"], ["arrival_no"], scan.SourceSwitch(), SCAN_ROWS).select("stream_id", "arrival_no", "accepted")


_FRAMES = "stream_id long, frame_no long, t double, area double, has_image boolean"
_LATE = "(r.t < {0} OR r.t > {0} + 10)".format
_BASE = f"(CASE WHEN {_LATE('f.last')} THEN r.t - 10 ELSE f.last END)"


@query(_walk(CLOCK, "stream_id", "t, frame_no", "r.has_image AS kept, CASE WHEN r.has_image THEN r.t ELSE r.t - 10 END AS last", f"r.t - {_BASE} + 1e-7 >= 0.5 AND r.has_image, CASE WHEN r.t - {_BASE} + 1e-7 >= 0.5 AND r.has_image THEN r.t ELSE {_BASE} END", "stream_id, frame_no", "kept"))
def throttle(spark, d):
    """P10, W9"""
    rows = scan.scanned(clock(spark, d), ["stream_id"], ["t", "frame_no"], scan.Throttle(0.5), SCAN_ROWS)
    return rows.where("kept").select("stream_id", "frame_no")


_SKIP = "(r.t - {0} >= 0 AND r.t - {0} <= 10 AND r.t - {0} < 0.3)".format


@query(_walk(CLOCK, "stream_id", "frame_no", f"NOT {_SKIP('0')} AS kept, CASE WHEN {_SKIP('0')} THEN 0.0::DOUBLE ELSE r.t END AS last", f"NOT {_SKIP('f.last')}, CASE WHEN {_SKIP('f.last')} THEN f.last ELSE r.t END", "stream_id, frame_no", "kept"))
def decoder_throttle(spark, d):
    """P9, in arrival order"""
    rows = scan.scanned(clock(spark, d), ["stream_id"], ["frame_no"], scan.DecoderThrottle(0.3), SCAN_ROWS)
    return rows.where("kept").select("stream_id", "frame_no")


@query(_walk(CLOCK, "stream_id", "frame_no", "r.area < 0.05 AS skipped", "r.area < CASE WHEN f.skipped THEN 0.01 ELSE 0.05 END", "stream_id, frame_no, skipped"))
def skip_hysteresis(spark, d):
    """P11"""
    return scan.scanned(clock(spark, d), ["stream_id"], ["frame_no"], scan.MotionSkip(), SCAN_ROWS).select("stream_id", "frame_no", "skipped")


_QUEUE = f"(SELECT stream_id, frame_no, CAST(frame_no * 7 % 5 AS DOUBLE) / 3 AS queue FROM {CLOCK} c)"
_LOAD = "least(0.95, level)"


@query(_walk(_QUEUE, "stream_id", "frame_no", "(CASE WHEN r.queue > 0 THEN 0.3 ELSE 0.1 END) * r.queue AS level", "f.level + (CASE WHEN r.queue - f.level > 0 THEN 0.3 ELSE 0.1 END) * (r.queue - f.level)",
    f"stream_id, frame_no, ({_LOAD} > 0.125 AND rn % 8 = 7) OR ({_LOAD} > 0.25 AND rn % 8 = 3) OR ({_LOAD} > 0.5 AND rn % 8 IN (1, 5)) OR ({_LOAD} > 0.75 AND rn % 8 IN (2, 6)) OR ({_LOAD} > 0.875 AND rn % 8 = 4) AS dropped"))
def load_shedding(spark, d):
    """P12"""
    rows = clock(spark, d).select("stream_id", "frame_no", (F.pmod(F.col("frame_no") * 7, F.lit(5)).cast("double") / 3).alias("queue"))
    return ordered_scan(rows, ["stream_id"], ["frame_no"], steps.LoadShed, "stream_id long, frame_no long, dropped boolean")


@query(_walk(CLOCK, "stream_id", "t, frame_no", "r.t >= 5 AS picture, r.t >= 5 AS embedded, CASE WHEN r.t >= 5 THEN r.t ELSE 0 END AS lp, CASE WHEN r.t >= 5 THEN r.t ELSE 0 END AS le",
    "r.t - f.lp >= 5, r.t - f.lp >= 5 AND r.t - f.le >= 2, CASE WHEN r.t - f.lp >= 5 THEN r.t ELSE f.lp END, CASE WHEN r.t - f.lp >= 5 AND r.t - f.le >= 2 THEN r.t ELSE f.le END", "stream_id, frame_no, embedded", "picture"))
def snapshot_cadence(spark, d):
    """R17"""
    rows = ordered_scan(clock(spark, d), ["stream_id"], ["t", "frame_no"], steps.Snapshot, _FRAMES + ", picture boolean, embedded boolean")
    return rows.where("picture").select("stream_id", "frame_no", "embedded")


_SHOT = f"(SELECT stream_id, user_id AS track_id, frame_no, det_id, (x1 - x0) * (y1 - y0) * conf AS q FROM {DET} d)"
_BAR = "greatest(0.005, CASE WHEN f.best > 0 THEN greatest(1.2 * f.best, f.best + 0.02) ELSE 0 END)"


@query(_walk(_SHOT, "stream_id, track_id", "frame_no, det_id", "r.q > 0.005 AS taken, CASE WHEN r.q > 0.005 THEN r.q ELSE 0 END AS best, CASE WHEN r.q > 0.005 THEN r.frame_no END AS best_frame",
    f"r.q > {_BAR}, CASE WHEN r.q > {_BAR} THEN r.q ELSE f.best END, CASE WHEN r.q > {_BAR} THEN r.frame_no ELSE f.best_frame END", f"stream_id, track_id, frame_no, det_id, taken, {q('best', 'best')}, best_frame"))
def best_shot(spark, d):
    """State lives as long as its track has rows"""
    rows = det(spark, d).select("stream_id", F.col("user_id").alias("track_id"), "frame_no", "det_id", g.clip_quality(g.box(), F.col("conf")).alias("q"))
    out = ordered_scan(rows, ["stream_id", "track_id"], ["frame_no", "det_id"], lambda: steps.BestShot(least=0.005), "stream_id long, track_id long, frame_no long, det_id long, taken boolean, best double, best_frame long")
    return out.withColumn("best", q6(F.col("best")))


_BLOCK = f"(SELECT event_id AS frame_no, user_id % 64 AS block, CAST(event_id * 37 % 256 AS DOUBLE) * (CASE WHEN event_id % 9 = 0 THEN 1.0 ELSE 0.1 END) AS v FROM events)"
_ALPHA = "0.9 * least(f.rn, 16) / 16"


@query(_walk(_BLOCK, "block", "frame_no", "(CASE WHEN r.v < 0 THEN 0 ELSE 0.005 END) * r.v AS floor_", f"f.floor_ * (CASE WHEN r.v < f.floor_ THEN {_ALPHA} ELSE 0.995 END) + r.v * (1 - (CASE WHEN r.v < f.floor_ THEN {_ALPHA} ELSE 0.995 END))", f"block, frame_no, {q('floor_', 'floor_')}, v > floor_ + 24 AS motion"))
def noise_floor(spark, d):
    """R8"""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_id").alias("frame_no"), (F.col("user_id") % 64).alias("block"), (F.pmod(F.col("event_id") * 37, F.lit(256)).cast("double") * F.when(F.col("event_id") % 9 == 0, 1.0).otherwise(0.1)).alias("v"))
    out = scan.scanned(rows, ["block"], ["frame_no"], scan.NoiseFloor(), SCAN_ROWS)
    return out.select("block", "frame_no", q6(F.col("floor")).alias("floor_"), "motion")


_MB = "(SELECT DISTINCT user_id % 4 AS stream_id, event_id // 50 AS frame_no, event_id * 7 % 11 AS bx, event_id * 13 % 9 AS bz FROM events)"


@query(f"""WITH b AS ({_MB}), e AS (SELECT * FROM b a WHERE EXISTS (SELECT 1 FROM b n WHERE n.stream_id = a.stream_id AND n.frame_no = a.frame_no AND abs(n.bx - a.bx) + abs(n.bz - a.bz) = 1))
SELECT stream_id, frame_no, count(*) AS n_blocks, {q('min(bx) / 11.0', 'x0')}, {q('min(bz) / 9.0', 'y0')}, {q('(max(bx) + 1) / 11.0', 'x1')}, {q('(max(bz) + 1) / 9.0', 'y1')}, {q('count(*) / (99 + 1e-7)', 'score')} FROM e GROUP BY 1, 2""")
def motion_roi(spark, d):
    """R9, A8"""
    e = spark.read.parquet(f"{d}/events.parquet")
    b = e.select((F.col("user_id") % 4).alias("stream_id"), F.floor(F.col("event_id") / 50).alias("frame_no"), (F.col("event_id") * 7 % 11).alias("bx"), (F.col("event_id") * 13 % 9).alias("by")).distinct()
    return s.motion_roi(s.eroded(b), 11, 9).select("stream_id", "frame_no", "n_blocks", *boxed(g.box()), q6(F.col("score")).alias("score"))


@query(f"""WITH c AS (SELECT user_id % 4 AS stream_id, event_id // 100 AS frame_no, avg(greatest(0, event_id * 29 % 31 - 5)) AS score FROM events GROUP BY 1, 2)
SELECT stream_id, frame_no, {q('score', 'score')}, score > 8 AND row_number() OVER (PARTITION BY stream_id ORDER BY frame_no) > 2 AS changed FROM c""")
def scene_change(spark, d):
    """A9, R11"""
    e = spark.read.parquet(f"{d}/events.parquet")
    costs = e.select((F.col("user_id") % 4).alias("stream_id"), F.floor(F.col("event_id") / 100).alias("frame_no"), (F.col("event_id") * 29 % 31).alias("cost"))
    return s.scene_change(costs).withColumn("score", q6(F.col("score")))


def _flow(x: str, y: str, n: str) -> str:
    return f"(({x} * {n[0]} + {y} * {n[1]}) % 201 - 100)"


_FLOW_CTE = f"""WITH p AS (SELECT d.*, f.fx, f.fy, f.w FROM {DET} d, (VALUES (0.5, 0.5, 0.5), (0.35, 0.5, 0.125), (0.65, 0.5, 0.125), (0.5, 0.35, 0.125), (0.5, 0.65, 0.125)) f(fx, fy, w)),
c AS (SELECT *, least(79, greatest(0, CAST(trunc((x0 * fx::DOUBLE + x1 * (1 - fx::DOUBLE)) * 80 + 0.5) AS INT))) AS ix, least(44, greatest(0, CAST(trunc((y0 * fy::DOUBLE + y1 * (1 - fy::DOUBLE)) * 45 + 0.5) AS INT))) AS iy FROM p),
m AS (SELECT det_id, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1, sum(w::DOUBLE * {_flow('ix', 'iy', ('37', '11'))}) / (128.0::DOUBLE * 80) AS dx, sum(w::DOUBLE * {_flow('ix', 'iy', ('17', '29'))}) / (128.0::DOUBLE * 45) AS dy FROM c GROUP BY det_id)"""


@query(_FLOW_CTE + " SELECT det_id, " + ", ".join(q(f"greatest(0, least(1, {c} - d{c[0]}))", c) for c in g.SIDES) + " FROM m")
def flow_predict(spark, d):
    """F24, D16"""
    flow = lambda x, y: (F.pmod(x * 37 + y * 11, F.lit(201)) - 100, F.pmod(x * 17 + y * 29, F.lit(201)) - 100)
    return det(spark, d).select("det_id", *boxed(s.predicted_box(g.box(), flow, 80, 45)))


@query("SELECT n AS name, CASE WHEN regexp_matches(n, '[.](264|h264)$') THEN 'h264' WHEN regexp_matches(n, '[.](265|h265|hevc)$') THEN 'h265' WHEN regexp_matches(n, '[.]pcap$') THEN 'pcap' END AS codec, CAST(floor(coalesce(TRY_CAST(nullif(regexp_extract(n, '_([0-9.]+)fps', 1), '') AS DOUBLE), 0) * 1e6 + 0.5) AS BIGINT) AS fps FROM (SELECT DISTINCT 'clip' || user_id || '_' || (user_id % 61) || CASE WHEN user_id % 3 = 0 THEN 'fps' ELSE '' END || ['.264', '.h265', '.pcap', '.hevc'][CAST(user_id % 4 AS INT) + 1] AS n FROM events) t")
def fps_from_name(spark, d):
    """S9, S10"""
    from sightline.sources.media import name_codec, name_fps

    u = F.col("user_id")
    suffix = F.array(*map(F.lit, (".264", ".h265", ".pcap", ".hevc")))[(u % 4).cast("int")]
    n = F.concat(F.lit("clip"), u.cast("string"), F.lit("_"), (u % 61).cast("string"), F.when(u % 3 == 0, "fps").otherwise(""), suffix)
    names = spark.read.parquet(f"{d}/events.parquet").select(n.alias("name")).distinct()
    return names.select("name", name_codec(F.col("name")).alias("codec"), q6(name_fps(F.col("name"))).alias("fps"))


@query(f"""WITH w AS (SELECT *, (((ts32 - 4294960000) % 4294967296) + 4294967296) % 4294967296 / 90000.0::DOUBLE AS t FROM {PKT} p)
SELECT stream_id, arrival_no, {q('t - first_value(t) OVER (PARTITION BY stream_id ORDER BY arrival_no)', 'since')} FROM w""")
def replay_clock(spark, d):
    """Time since a stream's first packet"""
    from pyspark.sql import Window

    t = F.pmod(F.col("ts32") - 4294960000, F.lit(4294967296)) / 90000.0
    own = Window.partitionBy("stream_id").orderBy("arrival_no")
    rows = pkt(spark, d).withColumn("t", t)
    return rows.select("stream_id", F.col("arrival_no").cast("long").alias("arrival_no"), q6(F.col("t") - F.first("t").over(own)).alias("since"))


@query(f"SELECT stream_id, seq_no, CAST(seq16 AS BIGINT) AS seq16, CAST(ts32 AS BIGINT) AS ts32, marker, CAST(7 AS BIGINT) AS ssrc, CAST(96 AS INT) AS pt FROM {PKT} p")
def rtp_parse(spark, d):
    """Packets written as bytes and read again"""
    from sightline.sources.media import parse_packets

    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    data = F.unhex(F.concat(F.lit("80"), wide(F.when(F.col("marker"), 224).otherwise(96), 2), wide(F.col("seq16"), 4), wide(F.col("ts32"), 8), F.lit("00000007"), F.lit("AABB")))
    return parse_packets(pkt(spark, d).select("stream_id", "seq_no", data.alias("data"))).drop("payload")


@query("""SELECT event_id, b, CASE WHEN event_id % 2 = 0 THEN CASE WHEN b & 31 = 5 THEN 'key' WHEN b & 31 = 7 THEN 'sps' WHEN b & 31 = 8 THEN 'pps' WHEN b & 31 = 6 THEN 'sei' WHEN b & 31 BETWEEN 1 AND 4 THEN 'video' ELSE 'other' END
ELSE CASE WHEN (b >> 1) & 63 = 32 THEN 'vps' WHEN (b >> 1) & 63 = 33 THEN 'sps' WHEN (b >> 1) & 63 = 34 THEN 'pps' WHEN (b >> 1) & 63 IN (39, 40) THEN 'sei' WHEN (b >> 1) & 63 BETWEEN 16 AND 21 THEN 'key' WHEN (b >> 1) & 63 <= 9 THEN 'video' ELSE 'other' END END AS kind
FROM (SELECT event_id, CAST(event_id * 37 % 256 AS INT) AS b FROM events) t""")
def nal_classes(spark, d):
    """F15"""
    from sightline.sources.media import H264, H265, nal_class_column

    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") * 37 % 256).cast("int").alias("b"))
    return e.withColumn("kind", nal_class_column(F.when(F.col("event_id") % 2 == 0, H264).otherwise(H265), F.col("b")))


def _half(x: str) -> str:
    """The SQL of vectors.half() for a non-null number."""
    size = f"abs({x}::DOUBLE)"
    near = f"floor(log2(greatest({size}, {2.0**-30!r}::DOUBLE)))"
    power = f"(CASE WHEN {size} < pow(2.0::DOUBLE, {near}) THEN {near} - 1 WHEN {size} >= pow(2.0::DOUBLE, {near} + 1) THEN {near} + 1 ELSE {near} END)"
    step = f"pow(2.0::DOUBLE, greatest({power}, -14) - 10)"
    return f"(CASE WHEN {size} >= 65520 THEN 'inf'::DOUBLE ELSE round_even({size} / {step}, 0) * {step} END * (CASE WHEN {x} < 0 THEN -1 ELSE 1 END))"


#: Elements at scales from below the least subnormal to above the largest half.
_SCALED = "x::DOUBLE * pow(2.0::DOUBLE, CAST((i * 7 + vec_id) % 44 AS INT) - 26)"


@query(f"""WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings), s AS (SELECT vec_id, i, {_SCALED} AS y FROM e), h AS (SELECT vec_id, i, {_half('y')} AS h FROM s)
SELECT vec_id, CAST(i AS INT) AS i, CASE WHEN isinf(h) THEN CASE WHEN h > 0 THEN 9000000000000000 ELSE -9000000000000000 END ELSE CAST(h * 16777216 AS BIGINT) END AS steps FROM h""")
def half_floats(spark, d):
    """all elements, at scales from 2**-26 to 2**17, in steps of the least subnormal"""
    e = embeddings(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    y = F.col("x").cast("double") * F.pow(F.lit(2.0), (((F.col("i") * 7 + F.col("vec_id")) % 44) - 26).cast("double"))
    h = v.half(y)
    return e.withColumn("h", h).select("vec_id", "i", F.when(F.col("h") == float("inf"), 9_000_000_000_000_000).when(F.col("h") == -float("inf"), -9_000_000_000_000_000).otherwise((F.col("h") * 16777216).cast("long")).alias("steps"))


@query()
def half_floats_all(spark, d):
    """F7 on all rows, by Arrow batches; also tested against numpy with ties, subnormals and overflow"""
    e = embeddings(spark, d).withColumn("half", v.through_half("embedding"))
    return e.select("vec_id", "half")


_MEET_H = "(greatest(0::FLOAT, least(z.hx1, r.hx1) - greatest(z.hx0, r.hx0)) * greatest(0::FLOAT, least(z.hy1, r.hy1) - greatest(z.hy0, r.hy0)))"
_WHOLE_H = f"((z.hx1 - z.hx0) * (z.hy1 - z.hy0) + (r.hx1 - r.hx0) * (r.hy1 - r.hy0) - {_MEET_H})"
_NMS_HALF = _greedy(f"SELECT k, det_id, {_half('conf')} AS hc, " + ", ".join(f"{_half(c)}::FLOAT AS h{c}" for c in g.SIDES) + f" FROM {_DK} e", "hc DESC, det_id", "det_id, hc, hx0, hy0, hx1, hy1", f"{_WHOLE_H} <> 0 AND {_MEET_H} / {_WHOLE_H} > 0.45::FLOAT")


@query(_NMS_HALF + f" SELECT k // 8 // 1000000 AS stream_id, k // 8 % 1000000 AS frame_no, CAST(k % 8 AS INT) AS cl, det_id, {q('hc', 'half_conf')} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hc DESC, det_id) AS n FROM chosen) t WHERE n <= 3")
def nms_half(spark, d):
    """Scores and corners of 16 bits, overlaps without epsilon, three of a class"""
    return m.suppress_half(det(spark, d), 0.45, most=3).select("stream_id", "frame_no", "cl", "det_id", q6(F.col("half_conf")).alias("half_conf"))


_RUN = "(SELECT user_id % 16 AS stream_id, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS BIGINT) AS i, value / 250 AS latency, event_id % 7 = 3 AS skipped FROM events)"
_RATES = f"""WITH r AS {_RUN}, n AS (SELECT stream_id, max(i) AS n FROM r GROUP BY stream_id), h AS (SELECT stream_id, CAST(least(greatest(floor(latency / 0.8::DOUBLE * 40), 0), 39) AS INT) AS bin, sum({1 - _D!r}::DOUBLE * pow({_K10!r}::DOUBLE, n // 10 - i // 10)) AS weight FROM r JOIN n USING (stream_id) GROUP BY stream_id, bin),
c AS (SELECT stream_id, bin, sum(weight) OVER (PARTITION BY stream_id ORDER BY bin) AS cum, sum(weight) OVER (PARTITION BY stream_id) AS total FROM h),
p AS (SELECT stream_id, (min(CASE WHEN cum >= 0.5 * total THEN bin END) + 0.5) * (0.8::DOUBLE / 40) AS p50, (min(CASE WHEN cum >= 0.9 * total THEN bin END) + 0.5) * (0.8::DOUBLE / 40) AS p90 FROM c GROUP BY stream_id),
t AS (SELECT stream_id, count_if(NOT skipped) AS ran, count_if(skipped) AS skipped FROM r GROUP BY stream_id), rates AS (SELECT stream_id, ran, skipped, ran / 20.0::DOUBLE AS fps, p50, p90 FROM t JOIN p USING (stream_id))"""


def _rates(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    own = Window.partitionBy(F.col("user_id") % 16).orderBy("event_id")
    frames = e.withColumn("i", F.row_number().over(own).cast("long")).select((F.col("user_id") % 16).alias("stream_id"), "i", (F.col("value") / 250).alias("latency"), (F.col("event_id") % 7 == 3).alias("skipped"))
    return s.stream_rates(frames, 20.0, 0.0, 0.8)


@query(_RATES + f" SELECT stream_id, CAST(ran AS BIGINT) AS ran, CAST(skipped AS BIGINT) AS skipped, {q('fps', 'fps')}, {q('p50', 'p50')}, {q('p90', 'p90')} FROM rates")
def stream_latency(spark, d):
    """A21, A22 of each stream: rate and latency percentiles by decayed histograms of 40 bins, so exact to 0.02"""
    return _rates(spark, d).select("stream_id", "ran", "skipped", *[q6(F.col(c)).alias(c) for c in ("fps", "p50", "p90")])


_MODES = "(SELECT CASE WHEN n / 32.0 < 0.15 THEN 0 WHEN n / 32.0 < 0.3 THEN 1 ELSE 2 END AS mode FROM (SELECT count(*) AS n FROM events GROUP BY event_id // 64, user_id % 16) b)"


@query(_RATES + f""", a AS (SELECT count(*) AS streams, min(fps) AS fps_min, max(fps) AS fps_max, sum(fps) AS fps_total, avg(fps) AS fps_mean, avg(p50) AS p50, avg(p90) AS p90, sum(skipped) / (sum(ran) + sum(skipped) + 1e-7) AS skipped FROM rates),
m AS (SELECT {', '.join(f"count_if(mode = {k}) / (count(*) + 1e-7) AS mode{k}" for k in range(3))} FROM {_MODES} x)
SELECT CAST(streams AS BIGINT) AS streams, {', '.join(q(c, c) for c in ('fps_min', 'fps_max', 'fps_total', 'fps_mean', 'p50', 'p90', 'skipped', 'mode0', 'mode1', 'mode2'))} FROM a, m""")
def realtime_rollup(spark, d):
    """Over all streams, with the shares of the performance modes that loads of batches give"""
    e = spark.read.parquet(f"{d}/events.parquet")
    batches = e.groupBy(F.floor(F.col("event_id") / 64).alias("f"), (F.col("user_id") % 16).alias("k")).agg(F.count(F.lit(1)).alias("b"))
    modes = batches.select(s.performance_mode(F.col("b") / 32.0).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    out = s.realtime_summary(_rates(spark, d), modes)
    return out.select("streams", *[q6(F.col(c)).alias(c) for c in out.columns if c != "streams"])


# trackers, audio features, streams


@query()
def cascade_tracks(spark, d):
    """Deterministic, stateful; tested on hand-made scenes"""
    from sightline.operators.trackers import CascadeTracker, frames_of, track

    rows = track(frames_of(det(spark, d).withColumn("t", F.col("frame_no") * 0.5)), CascadeTracker)
    return rows.select("stream_id", "frame_no", "track_id", "state", "det_id", "observations", "missed")


@query()
def association_tracks(spark, d):
    """R13, J5, J12, J19, F23"""
    from sightline.operators.trackers import AssociationTracker, frames_of, track

    rows = track(frames_of(det(spark, d).withColumn("t", F.col("frame_no") * 0.5)), AssociationTracker)
    return rows.select("stream_id", "frame_no", "track_id", "state", "det_id", "observations")


@query()
def track_pipeline(spark, d):
    """D4, P10, P11, R12, R15, R16 in one pass a stream"""
    from sightline.operators.pipeline import track_streams
    from sightline.operators.trackers import frames_of

    frames = frames_of(det(spark, d).withColumn("t", F.col("frame_no") * 0.5)).withColumn("area", F.pmod(F.col("frame_no") * 31, F.lit(100)) / 500.0)
    return track_streams(frames, 0.2).select("stream_id", "frame_no", "result_type", F.coalesce(F.size("tracks"), F.lit(0)).alias("n_tracks"))


@query("""WITH e AS (SELECT k, 700 * (pow(10, (k * (2595 * log10(1 + 16000 / 700.0)) / 41) / 2595) - 1) AS hz FROM range(0, 42) r(k)), t AS (SELECT a.k AS band, a.hz AS lo, b.hz AS mid, c.hz AS hi FROM e a JOIN e b ON b.k = a.k + 1 JOIN e c ON c.k = a.k + 2)
SELECT CAST(band AS INT) AS band, CAST(b AS INT) AS bin, CAST(floor(greatest(0, least((b * 62.5 - lo) / (mid - lo), (hi - b * 62.5) / (hi - mid))) * 2 / (hi - lo) * 1e9 + 0.5) AS BIGINT) AS weight FROM t, range(0, 257) q(b)""")
def mel_filterbank(spark, d):
    """40 bands, 512 points, 32 kHz; a table of the model, made on the driver"""
    from sightline.sources.audio import mel_filterbank

    bank = mel_filterbank(40, 512, 32_000)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(bank)]
    return spark.createDataFrame(rows, "band int, w array<double>").select("band", F.posexplode("w").alias("bin", "w")).select("band", "bin", F.floor(F.col("w") * 1e9 + 0.5).cast("long").alias("weight"))


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Windowed counts of a stream (complete mode)"""
    from sightline.streaming import drivers

    table = drivers.drained(drivers.tumbling(drivers.events(spark, d), "1 hour", "10 minutes", "event_type"), "complete")
    return table.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    """Sessions of a stream (complete mode)"""
    from sightline.streaming import drivers

    table = drivers.drained(drivers.sessions(drivers.events(spark, d), "30 minutes", "10 minutes", "user_id"), "complete")
    return table.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """R2's analogue: first row of each key of a stream"""
    from sightline.streaming import drivers

    return drivers.drained(drivers.events(spark, d).withWatermark("ts", "3650 days").dropDuplicates(["user_id", "event_type"])).select("user_id", "event_type")


@query(ORACLE["skip_hysteresis"])
def stream_skip_hysteresis(spark, d):
    """P11 by the state store: the same step as the batch form"""
    from sightline.streaming import drivers

    rows = spark.sql(fx.clock("spark", "{events}"), events=drivers.events(spark, d))
    out = drivers.stateful(rows.select("stream_id", "frame_no", "area"), ["stream_id"], ["frame_no"], steps.MotionSkip, "stream_id long, frame_no long, skipped boolean")
    return drivers.drained(out)


# star-schema conveniences: Spark built-ins, beside the inventory


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS BIGINT) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lineitem(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate <= date'1998-09-02'")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("long").alias("revenue"), F.count(F.lit(1)).alias("n"))


from sightline.plans import image_queries, media_queries, motion_queries, ranged_queries  # noqa: E402, F401  (they register their queries)
