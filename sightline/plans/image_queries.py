"""Queries over pictures: each is 16 x 12 pixels of a block of events, its chroma planes of half size are two of its pixels' grids.

Results are digests of all pixels: SHA-256 of their hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import pixels as px
from sightline.operators import steps
from sightline.operators.fold import ordered_scan
from sightline.plans.queries import q, q6, query

W, H = 16, 12
_N = W * H

#: Pixels by place (x, y) of each picture; absent events are 0.
_PX = f"""p AS (SELECT img, i, i % {W} AS x, i // {W} AS y, CAST(coalesce(v, 0) AS INT) AS v FROM (SELECT DISTINCT event_id // {_N} AS img FROM events) a
 CROSS JOIN (SELECT CAST(unnest(range(0, {_N})) AS BIGINT) AS i) r LEFT JOIN (SELECT event_id // {_N} AS img, event_id % {_N} AS i, (event_id * 37 + user_id * 11) % 256 AS v FROM events) e USING (img, i)),
u AS (SELECT img, y // 2 * {W // 2} + x // 2 AS i, x // 2 AS x, y // 2 AS y, v FROM p WHERE x % 2 = 0 AND y % 2 = 0),
w AS (SELECT img, y // 2 * {W // 2} + x // 2 AS i, x // 2 AS x, y // 2 AS y, v FROM p WHERE x % 2 = 1 AND y % 2 = 1)"""


def pictures(spark, d) -> DataFrame:
    """img, width, height and the planes y, u, v."""
    e = spark.read.parquet(f"{d}/events.parquet")
    at = e.select(F.floor(F.col("event_id") / _N).alias("img"), (F.col("event_id") % _N).cast("int").alias("i"), ((F.col("event_id") * 37 + F.col("user_id") * 11) % 256).cast("int").alias("v"))
    cells = at.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    plane = lambda places: F.unhex(F.concat_ws("", F.transform(F.array(*map(F.lit, places)), lambda i: F.lpad(F.hex(F.coalesce(F.col("m")[i], F.lit(0))), 2, "0"))))
    half = lambda k: [(2 * y + k) * W + 2 * x + k for y in range(H // 2) for x in range(W // 2)]
    return cells.select("img", F.lit(W).alias("width"), F.lit(H).alias("height"), plane(range(_N)).alias("y"), plane(half(0)).alias("u"), plane(half(1)).alias("v"))


def planes(row: dict) -> list[np.ndarray]:
    w, h = row["width"], row["height"]
    shape = {"y": (h, w), "u": (h // 2, w // 2), "v": (h // 2, w // 2)}
    return [np.frombuffer(row[k], np.uint8).reshape(s) for k, s in shape.items()]


def each_picture(rows: DataFrame, kernel: Callable[[dict], dict], schema: str) -> DataFrame:
    """What kernel makes of each row (a dict), by Arrow batches; `schema` of its results beside img."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("img long, " + schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"img": r["img"], **kernel(r)} for r in batch.to_pylist()], arrow)

    return rows.mapInArrow(run, kind)


def digested(rows: DataFrame, column: str = "y") -> DataFrame:
    return rows.select("img", "width", "height", F.sha2(F.hex(column), 256).alias("digest"))


def of_plane(spark, d, kernel) -> DataFrame:
    return digested(px.on_images(pictures(spark, d).select("img", "width", "height", "y"), kernel))


def _sql(more: str, width: int, height: int) -> str:
    """more: CTEs that end in o (img, i, v)."""
    return f"WITH {_PX}, {more} SELECT img, CAST({width} AS INT) AS width, CAST({height} AS INT) AS height, sha256(string_agg(printf('%02X', CAST(v AS INT)), '' ORDER BY i)) AS digest FROM o GROUP BY img"


_HALF = f"h AS (SELECT img, y // 2 * {W // 2} + x // 2 AS i, x // 2 AS x, y // 2 AS y, (sum(v) + 2) // 4 AS v FROM p GROUP BY ALL)"


@query(_sql(_HALF.replace("x // 2 AS x, y // 2 AS y,", "").replace("h AS", "o AS").replace("GROUP BY ALL", "GROUP BY img, x // 2, y // 2"), W // 2, H // 2))
def image_half(spark, d):
    """2 x 2 means"""
    return of_plane(spark, d, px.half)


def _bilinear(source: str, sw: int, sh: int, w: int, h: int) -> str:
    """o: source (img, x, y, v) of sw x sh at w x h."""
    at = lambda n, size: f"greatest(0.0::DOUBLE, least({size - 1}::DOUBLE, (k + 0.5::DOUBLE) * {size} / {n} - 0.5::DOUBLE))"
    return f"""ax AS (SELECT k, CAST(floor({at(w, sw)}) AS INT) AS a, least(CAST(floor({at(w, sw)}) AS INT) + 1, {sw - 1}) AS b, {at(w, sw)} - floor({at(w, sw)}) AS f FROM range(0, {w}) r(k)),
ay AS (SELECT k, CAST(floor({at(h, sh)}) AS INT) AS a, least(CAST(floor({at(h, sh)}) AS INT) + 1, {sh - 1}) AS b, {at(h, sh)} - floor({at(h, sh)}) AS f FROM range(0, {h}) r(k)),
o AS (SELECT q.img, ay.k * {w} + ax.k AS i, round_even((q.v * (1 - ax.f) + s.v * ax.f) * (1 - ay.f) + (t.v * (1 - ax.f) + z.v * ax.f) * ay.f, 0) AS v FROM ax, ay, {source} q, {source} s, {source} t, {source} z
 WHERE q.x = ax.a AND q.y = ay.a AND s.x = ax.b AND s.y = ay.a AND t.x = ax.a AND t.y = ay.b AND z.x = ax.b AND z.y = ay.b AND q.img = s.img AND q.img = t.img AND q.img = z.img)"""


@query(_sql(f"{_HALF}, {_bilinear('h', W // 2, H // 2, 6, 5)}", 6, 5))
def image_scale(spark, d):
    """halved, then bilinear"""
    return of_plane(spark, d, lambda p: px.scale(p, 6, 5))


@query(_sql(_bilinear("p", W, H, 10, 7), 10, 7))
def image_bilinear(spark, d):
    """bilinear alone"""
    return of_plane(spark, d, lambda p: px.scale(p, 10, 7))


@query(_sql(f"""k(d, c) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
o AS (SELECT p.img, p.i, (sum(s.v * a.c * b.c) + 128) // 256 AS v FROM p, k a, k b, p s WHERE s.img = p.img AND s.x = greatest(0, least({W - 1}, p.x + a.d)) AND s.y = greatest(0, least({H - 1}, p.y + b.d)) GROUP BY p.img, p.i)""", W, H))
def image_blur(spark, d):
    """F28"""
    return of_plane(spark, d, px.blur)


@query(_sql(f"""e AS (SELECT p.img, p.x, p.y, abs(p.v - s.v) AS v FROM p JOIN p s ON s.img = p.img AND s.y = p.y AND s.x = {W - 1} - p.x),
r AS (SELECT img, x, y // 4 AS y, ((max(CASE WHEN y % 4 = 0 THEN v END) + max(CASE WHEN y % 4 = 1 THEN v END) + 1) // 2 + (max(CASE WHEN y % 4 = 2 THEN v END) + max(CASE WHEN y % 4 = 3 THEN v END) + 1) // 2 + 1) // 2 AS v FROM e GROUP BY img, x, y // 4),
o AS (SELECT img, y * {W // 4} + x // 4 AS i, (sum(v) + 2) // 4 AS v FROM r GROUP BY img, y, x // 4)""", W // 4, H // 4))
def image_difference(spark, d):
    """a picture against itself from the other side"""
    return of_plane(spark, d, lambda p: px.mad_4x4(p, p[:, ::-1]))


@query(_sql("o AS (SELECT g.img, yy * 12 + xx AS i, coalesce(p.v, 128) AS v FROM (SELECT DISTINCT img FROM p) g CROSS JOIN range(0, 12) a(xx) CROSS JOIN range(0, 9) b(yy) LEFT JOIN p ON p.img = g.img AND xx BETWEEN 1 AND 8 AND yy BETWEEN 2 AND 7 AND p.x = xx - 1 + 3 AND p.y = yy - 2 + 2)", 12, 9))
def image_crop_pad(spark, d):
    """a crop with a grey border"""
    return of_plane(spark, d, lambda p: px.pad(px.crop(p, 3, 2, 8, 6), 1, 2, 3, 1))


@query(_sql("o AS (SELECT p.img, p.i, coalesce(s.v, p.v) AS v FROM p LEFT JOIN p s ON s.img = p.img AND s.x = p.x - 9 AND s.y = p.y - 8 AND s.x < 10 AND s.y < 6)", W, H))
def image_blend(spark, d):
    """a part of the picture over it, cut at the border"""
    return of_plane(spark, d, lambda p: px.blend(px.crop(p, 0, 0, 10, 6), p, 9, 8))


_RGB = """c AS (SELECT p.img, p.i, (p.v - 16) * (255::DOUBLE / 219) AS l, (u.v::DOUBLE - 128) * (255::DOUBLE / 224) AS cb, (w.v::DOUBLE - 128) * (255::DOUBLE / 224) AS cr FROM p JOIN u ON u.img = p.img AND u.x = p.x // 2 AND u.y = p.y // 2 JOIN w ON w.img = p.img AND w.x = p.x // 2 AND w.y = p.y // 2),
rgb AS (SELECT img, i, greatest(0, least(255, round_even(l + 1.5748::DOUBLE * cr, 0))) AS r, greatest(0, least(255, round_even(l - 0.187324::DOUBLE * cb - 0.468124::DOUBLE * cr, 0))) AS g, greatest(0, least(255, round_even(l + 1.8556::DOUBLE * cb, 0))) AS b FROM c)"""


@query(_sql(_RGB + ", o AS (SELECT img, i * 3 + k AS i, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM rgb, range(0, 3) t(k))", W, H))
def image_to_rgb(spark, d):
    """Planes to interleaved RGB"""
    return digested(each_picture(pictures(spark, d), lambda r: {"width": W, "height": H, "y": px.to_rgb(*planes(r)).tobytes()}, "width int, height int, y binary"))


@query(_sql(_RGB + ", o AS (SELECT img, i, round_even(16 + (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) * 219 / 255, 0) AS v FROM rgb)", W, H))
def image_from_rgb(spark, d):
    """RGB to luma"""
    return digested(each_picture(pictures(spark, d), lambda r: {"width": W, "height": H, "y": px.to_yuv(px.to_rgb(*planes(r)))[0].tobytes()}, "width int, height int, y binary"))


@query(_sql("o AS (SELECT img, i * 2 AS i, v FROM u UNION ALL SELECT img, i * 2 + 1, v FROM w)", W, H // 2))
def image_nv12(spark, d):
    """chroma planes interleaved, there and back"""
    def both(r):
        _, u, v = planes(r)
        uv = px.interleave(u, v)
        return {"width": W, "height": H // 2, "y": px.interleave(*px.deinterleave(uv)).tobytes()}

    return digested(each_picture(pictures(spark, d), both, "width int, height int, y binary"))


_WARP = np.array([[0.75, 0.125, 1.5], [-0.125, 0.875, 2.25]])
_SX, _SY = "greatest(0, least(15, 0.75::DOUBLE * xx + 0.125::DOUBLE * yy + 1.5::DOUBLE))", "greatest(0, least(11, -0.125::DOUBLE * xx + 0.875::DOUBLE * yy + 2.25::DOUBLE))"


@query(_sql(f"""t AS (SELECT xx, yy, CAST(floor({_SX}) AS INT) AS x0, CAST(floor({_SY}) AS INT) AS y0, {_SX} - floor({_SX}) AS fx, {_SY} - floor({_SY}) AS fy FROM range(0, 10) a(xx), range(0, 8) b(yy)),
o AS (SELECT a.img, yy * 10 + xx AS i, round_even((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + e.v * fx) * fy, 0) AS v FROM t JOIN p a ON a.x = x0 AND a.y = y0 JOIN p b ON b.img = a.img AND b.x = least(x0 + 1, 15) AND b.y = y0 JOIN p c ON c.img = a.img AND c.x = x0 AND c.y = least(y0 + 1, 11) JOIN p e ON e.img = a.img AND e.x = least(x0 + 1, 15) AND e.y = least(y0 + 1, 11))""", 10, 8))
def image_warp(spark, d):
    """bilinear samples under an affine map, edges repeated"""
    return of_plane(spark, d, lambda p: px.warp(p, _WARP, 10, 8))


#: Fixed values of this query: where five points of a face are to lie, in pixels.
_FACE = np.array([[2.0, 2.0], [6.0, 2.0], [4.0, 4.0], [2.5, 6.0], [5.5, 6.0]])


@query(_sql(f"o AS (SELECT g.img, yy * 8 + xx AS i, p.v FROM (SELECT DISTINCT img FROM p) g CROSS JOIN range(0, 8) a(xx) CROSS JOIN range(0, 8) b(yy) JOIN p ON p.img = g.img AND p.x = least({W - 1}, xx + g.img % 3) AND p.y = least({H - 1}, yy + g.img % 2))", 8, 8))
def aligned_faces(spark, d):
    """faces whose points lie some pixels beside the template's"""
    def face(r):
        shift = np.array([r["img"] % 3, r["img"] % 2], float)
        return {"width": 8, "height": 8, "y": px.aligned_face(planes(r)[0], _FACE + shift, _FACE, 8, 8).tobytes()}

    return digested(each_picture(pictures(spark, d), face, "width int, height int, y binary"))


_COEF = "(event_id % 7 + 1) / 4.0::DOUBLE AS a, (event_id % 5 - 2) / 8.0::DOUBLE AS b, event_id % 11 / 2.0::DOUBLE AS c, (event_id % 3 - 1) / 8.0::DOUBLE AS e, (event_id % 9 + 2) / 4.0::DOUBLE AS f, event_id % 13 / 2.0::DOUBLE AS g"


@query("SELECT event_id, " + ", ".join(q(c, f"m{i}") for i, c in enumerate("abcefg")) + f" FROM (SELECT event_id, {_COEF} FROM events) t")
def affine_points(spark, d):
    """the map found from five points and where it took them"""
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS img", *_COEF.replace("::DOUBLE", "D").split(", "))

    def found(r):
        m = np.array([[r["a"], r["b"], r["c"]], [r["e"], r["f"], r["g"]]])
        return {"m": px.affine(_FACE, _FACE @ m[:, :2].T + m[:, 2]).ravel().tolist()}

    rows = each_picture(e, found, "m array<double>")
    return rows.select(F.col("img").alias("event_id"), *[q6(F.col("m")[i]).alias(f"m{i}") for i in range(6)])


def _fnv(plane: str, w: int) -> str:
    """SQL for one plane's hash by img, as h."""
    step = "lambda h, z: xor(h, z) * 16777619 & 4294967295"
    rows = f"SELECT img, y, list_reduce(list_prepend(2166136261::BIGINT, list(v::BIGINT ORDER BY x)), {step}) AS h FROM {plane} GROUP BY img, y"
    return f"(SELECT img, list_reduce(list_prepend(2166136261::BIGINT, list(h ORDER BY y)), {step}) AS h FROM ({rows}) r GROUP BY img)"


_HASHES = f"WITH {_PX}, hashes AS (SELECT img, list_reduce([2166136261::BIGINT, a.h, b.h, c.h], lambda h, z: xor(h, z) * 16777619 & 4294967295) AS h FROM {_fnv('p', W)} a JOIN {_fnv('u', W // 2)} b USING (img) JOIN {_fnv('w', W // 2)} c USING (img))"


def hashes(spark, d):
    return each_picture(pictures(spark, d), lambda r: {"h": px.image_hash(planes(r))}, "h long")


@query(_HASHES + " SELECT img, h AS hash FROM hashes")
def image_hashes(spark, d):
    """A19"""
    return hashes(spark, d).select("img", F.col("h").alias("hash"))


@query(_HASHES + """, l AS (SELECT img % 4 AS stream_id, list(h ORDER BY img) AS hs FROM hashes GROUP BY 1)
SELECT stream_id, CAST(len(hs) AS BIGINT) AS frames, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(hs, lambda x: x::HUGEINT)), lambda t, h: (t * 1315423911 + h) % 18446744073709551616) AS VARCHAR) AS total FROM l""")
def frame_hashes(spark, d):
    """Hashes of a stream's frames folded in order"""
    rows = hashes(spark, d).select((F.col("img") % 4).alias("stream_id"), F.col("img").alias("frame_no"), "h")
    out = ordered_scan(rows, ["stream_id"], ["frame_no"], steps.FrameHash, "stream_id long, frame_no long, total string")
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.max_by("total", "frame_no").alias("total"))


@query(_sql(f"""o AS (SELECT p.img, p.i, CASE p.img % 3 WHEN 0 THEN p.v WHEN 1 THEN s.v ELSE CASE WHEN p.x BETWEEN 4 AND 11 AND p.y BETWEEN 2 AND 9 THEN p.v ELSE s.v END END AS v FROM p JOIN p s ON s.img = p.img AND s.y = p.y AND s.x = {W - 1} - p.x)""", W, H))
def reference_update(spark, d):
    """By the region's size, all, none or its even pixels of the motion reference are replaced"""
    def run(r):
        image = planes(r)[0]
        roi = [(0.0, 0.0, 1.0, 1.0), (0.3, 0.3, 0.3, 0.3), (0.3, 0.2, 0.7, 0.8)][r["img"] % 3]
        return {"width": W, "height": H, "y": np.ascontiguousarray(px.reference_updated(image[:, ::-1], image, roi)).tobytes()}

    return digested(each_picture(pictures(spark, d), run, "width int, height int, y binary"))


@query(f"WITH {_PX}, o AS (SELECT img, i, v FROM p UNION ALL SELECT img, {_N} + i, v FROM u UNION ALL SELECT img, {_N + _N // 4} + i, v FROM w) SELECT img, TRUE AS equal, sha256('3412EFBE{W:02X}000000{H:02X}000000' || string_agg(printf('%02X', v), '' ORDER BY i)) AS digest FROM o GROUP BY img")
def raw_images(spark, d):
    """Dumps written, read and compared"""
    from sightline.sources.labels import parse_raw_image, raw_image

    def run(r):
        dump = raw_image(*planes(r))
        return {"dump": dump, "equal": px.equal_images(list(parse_raw_image(dump)), planes(r))}

    return each_picture(pictures(spark, d), run, "dump binary, equal boolean").select("img", "equal", F.sha2(F.hex("dump"), 256).alias("digest"))


_LAYOUTS = ["yuv420", "nv12", "rgb24", "planar", "mono"]


@query(f"""WITH RECURSIVE e(a, b, c) AS (VALUES {', '.join(f"('{a}', '{b}', {c})" for (a, b), c in px.CONVERSIONS.items())}), s AS (SELECT unnest({_LAYOUTS}) AS a),
walk AS (SELECT a, a AS b, 0 AS cost, 0 AS hops FROM s UNION ALL SELECT w.a, e.b, w.cost + e.c, w.hops + 1 FROM walk w JOIN e ON e.a = w.b WHERE w.hops < 4),
best AS (SELECT a, b, min(cost) AS cost FROM walk GROUP BY a, b)
SELECT t.a AS source, t.b AS target, CAST(cost AS INT) AS cost, count(*) AS n FROM (SELECT {_LAYOUTS}[event_id % 5 + 1] AS a, {_LAYOUTS}[user_id % 5 + 1] AS b FROM events) t LEFT JOIN best USING (a, b) GROUP BY ALL""")
def conversion_costs(spark, d):
    """the cheapest way between layouts, for the pairs that occur; none where there is no way"""
    from itertools import product

    def cost(a: str, b: str) -> int | None:
        try:
            path = px.conversion_path(a, b)
        except ValueError:
            return None
        return sum(px.CONVERSIONS[x] for x in zip(path, path[1:], strict=False))

    costs = spark.createDataFrame([(a, b, cost(a, b)) for a, b in product(_LAYOUTS, _LAYOUTS)], "source string, target string, cost int")
    name = lambda c: F.array(*map(F.lit, _LAYOUTS))[(F.col(c) % 5).cast("int")]
    pairs = spark.read.parquet(f"{d}/events.parquet").groupBy(name("event_id").alias("source"), name("user_id").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(F.broadcast(costs), ["source", "target"]).select("source", "target", "cost", "n")
