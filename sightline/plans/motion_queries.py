"""The motion stage over pictures of 32 x 16 pixels, a row of pixels an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import motion
from sightline.operators.trackers import frames_of
from sightline.plans.queries import boxed, det, q, q6, query

W, H = 32, 16
_VALUE = "(x * 7 + event_id % 16 * 13) % 64 + CASE WHEN event_id // 16 % 5 < 2 AND event_id // 64 % 4 = x // 8 AND user_id % 3 > 0 THEN 150 ELSE 0 END"


def pictures(spark, d) -> DataFrame:
    """stream_id, frame_no, t, width, height and planes; a picture is 16 events, its chroma is grey."""
    e = spark.read.parquet(f"{d}/events.parquet")
    pixel = lambda x: F.lpad(F.hex(((x * 7 + F.col("event_id") % 16 * 13) % 64 + F.when((F.floor(F.col("event_id") / 16) % 5 < 2) & (F.floor(F.col("event_id") / 64) % 4 == F.floor(x / 8)) & (F.col("user_id") % 3 > 0), 150).otherwise(0)).cast("long")), 2, "0")
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(W - 1)), pixel), "")
    rows = e.select(F.floor(F.col("event_id") / 16).alias("frame_no"), (F.col("event_id") % 16).cast("int").alias("k"), row.alias("row"))
    whole = rows.groupBy("frame_no").agg(F.map_from_entries(F.collect_list(F.struct("k", "row"))).alias("m"))
    plane = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(H - 1)), lambda k: F.coalesce(F.col("m")[k], F.repeat(F.lit("00"), W))), "")
    grey = F.unhex(F.repeat(F.lit("80"), W * H // 4))
    return whole.select((F.col("frame_no") % 4).alias("stream_id"), "frame_no", F.col("frame_no").cast("double").alias("t"), F.lit(W).alias("width"), F.lit(H).alias("height"), F.unhex(plane).alias("y"), grey.alias("u"), grey.alias("v"))


_UP = "(({0} + {1} + 1) // 2)".format
_D = "abs(cur[({y}) * 32 + ({x}) + 1] - ref[({y}) * 32 + ({x}) + 1])".format
_COLUMN = lambda x, y: _UP(_UP(_D(x=x, y=f"{y} + 0"), _D(x=x, y=f"{y} + 1")), _UP(_D(x=x, y=f"{y} + 2"), _D(x=x, y=f"{y} + 3")))
_MAD = "(" + " + ".join(_COLUMN(f"c % 8 * 4 + {k}", "c // 8 * 4") for k in range(4)) + " + 2) // 4"


@query(f"""WITH RECURSIVE grid AS (SELECT f.frame_no, CAST(i AS BIGINT) AS i FROM (SELECT DISTINCT event_id // 16 AS frame_no FROM events) f, range(0, {W * H}) r(i)),
px AS (SELECT frame_no, i, i % {W} AS x, i // {W} AS y, CAST(coalesce(v, 0) AS INT) AS v FROM grid LEFT JOIN (SELECT event_id // 16 AS frame_no, event_id % 16 * {W} + x AS i, {_VALUE} AS v FROM events, range(0, {W}) r(x)) e USING (frame_no, i)),
k(d, c) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
rows_ AS (SELECT p.frame_no, p.x, p.y, CAST(sum(s.v * c) AS INT) AS v FROM px p, k, px s WHERE s.frame_no = p.frame_no AND s.y = p.y AND s.x = greatest(0, least({W - 1}, p.x + d)) GROUP BY p.frame_no, p.x, p.y),
blurred AS (SELECT p.frame_no, p.y * {W} + p.x AS i, CAST((sum(s.v * c) + 128) // 256 AS INT) AS v FROM rows_ p, k, rows_ s WHERE s.frame_no = p.frame_no AND s.x = p.x AND s.y = greatest(0, least({H - 1}, p.y + d)) GROUP BY p.frame_no, p.x, p.y),
fr AS MATERIALIZED (SELECT frame_no % 4 AS stream_id, frame_no, cur, row_number() OVER (PARTITION BY frame_no % 4 ORDER BY frame_no) AS rn FROM (SELECT frame_no, list(v ORDER BY i) AS cur FROM blurred GROUP BY frame_no) z),
fold AS (SELECT stream_id, frame_no, rn, cur AS ref, list_transform(range(0, 8), lambda b: 0.0::DOUBLE) AS fl, 0 AS n, FALSE AS skipped, CAST(0 AS INT) AS blocks, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 1.0::DOUBLE AS x1, 1.0::DOUBLE AS y1 FROM fr WHERE rn = 1
UNION ALL SELECT stream_id, frame_no, rn, CASE WHEN skipped OR blocks = 0 THEN ref WHEN area > 0.99 THEN cur
  ELSE list_transform(range(0, {W * H}), lambda i: CASE WHEN i % 32 >= x0 * 32 AND i % 32 < x1 * 32 AND i // 32 >= y0 * 16 AND i // 32 < y1 * 16 THEN cur[i + 1] ELSE ref[i + 1] END) END, fl, n + 1, skipped, blocks, x0, y0, x1, y1
FROM (SELECT *, area < CASE WHEN was THEN 0.01 ELSE 0.05 END AS skipped FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM (
  SELECT *, CAST(len(m) AS INT) AS blocks, coalesce(list_min(list_transform(m, lambda b: b % 4)) / 4.0::DOUBLE, 0) AS x0, coalesce(list_min(list_transform(m, lambda b: b // 4)) / 2.0::DOUBLE, 0) AS y0, coalesce((list_max(list_transform(m, lambda b: b % 4)) + 1) / 4.0::DOUBLE, 0) AS x1, coalesce((list_max(list_transform(m, lambda b: b // 4)) + 1) / 2.0::DOUBLE, 0) AS y1 FROM (
  SELECT *, list_filter(range(0, 8), lambda b: mv[b + 1] AND ((b % 4 > 0 AND coalesce(mv[b], FALSE)) OR (b % 4 < 3 AND coalesce(mv[b + 2], FALSE)) OR (b > 3 AND coalesce(mv[b - 3], FALSE)) OR (b < 4 AND coalesce(mv[b + 5], FALSE)))) AS m FROM (
  SELECT *, list_transform(range(0, 8), lambda b: val[b + 1] > fl[b + 1] + 24) AS mv FROM (
  SELECT stream_id, frame_no, rn, cur, ref, n, was, val, list_transform(range(0, 8), lambda b: CASE WHEN val[b + 1] < was_fl[b + 1] THEN was_fl[b + 1] * (0.9::DOUBLE * least(n, 16) / 16) + val[b + 1] * (1 - 0.9::DOUBLE * least(n, 16) / 16) ELSE was_fl[b + 1] * 0.995::DOUBLE + val[b + 1] * (1 - 0.995::DOUBLE) END) AS fl FROM (
  SELECT *, list_transform(range(0, 8), lambda b: greatest(mad[b % 4 * 2 + b // 4 * 16 + 1], mad[b % 4 * 2 + b // 4 * 16 + 2], mad[b % 4 * 2 + b // 4 * 16 + 9], mad[b % 4 * 2 + b // 4 * 16 + 10])) AS val FROM (
  SELECT stream_id, frame_no, rn, cur, ref, n, was, was_fl, list_transform(range(0, 32), lambda c: {_MAD}) AS mad FROM (
  SELECT r.stream_id, r.frame_no, r.rn, r.cur, f.ref, f.n, f.skipped AS was, f.fl AS was_fl FROM fold f JOIN fr r ON r.stream_id = f.stream_id AND r.rn = f.rn + 1) a0) a1) a2) a3) a4) a5) a6) a7) a8)
SELECT stream_id, frame_no, blocks, {q('x0', 'x0')}, {q('y0', 'y0')}, {q('x1', 'x1')}, {q('y1', 'y1')}, skipped, {q('coalesce(list_sum(list_transform(range(0, 8), lambda b: fl[b + 1] * (b + 1))), 0)', 'floors')} FROM fold""")
def motion_stage(spark, d):
    """2.15, F28, F29, R8-R10, A8, P11: pictures to regions, with the reference that the regions renew"""
    out = motion.motion(pictures(spark, d))
    floors = F.aggregate(F.transform("floor", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("stream_id", "frame_no", "blocks", *boxed(g.box()), "skipped", q6(floors).alias("floors"))


@query()
def searched_tracks(spark, d):
    """Streams from pictures to tracks by way of their search regions; a change of scene clears the cascade. Tested against a plain version."""
    frame = F.floor(F.col("det_id") / 16)
    own = det(spark, d).withColumn("frame_no", frame).withColumn("stream_id", frame % 4).withColumn("t", frame.cast("double"))
    dets = frames_of(own).select("stream_id", "frame_no", "dets")
    cost = F.when(F.col("frame_no") % 97 == 50, 40.0).otherwise(1.0)
    rows = pictures(spark, d).join(dets, ["stream_id", "frame_no"], "left").withColumn("cost", cost)
    out = motion.searched(rows, 1.5)
    return out.select("stream_id", "frame_no", "result_type", *[q6(F.col(f"search.{c}")).alias(c) for c in g.SIDES], "changed", F.coalesce(F.size("tracks"), F.lit(0)).alias("n_tracks"))
