"""Candidate pairs, greedy one-to-one matching, suppression, fusion and tracking metrics, frame by frame.

Frames are small, so every frame-local operator groups by (stream, frame), which
spreads one busy stream over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions.vectors import half
from sightline.operators.fold import greedy

FRAME = ["stream_id", "frame_no"]


def sides(a: DataFrame, b: DataFrame, a_id: str, b_id: str, more: list[str] = []) -> DataFrame:
    """Every pair of an a and a b of one frame, as a_/b_ columns: an equi-join on the frame."""
    left = a.select(*FRAME, F.col(a_id).alias("a_id"), *[F.col(s).alias(f"a_{s}") for s in (*g.SIDES, *more)])
    right = b.select(*FRAME, F.col(b_id).alias("b_id"), *[F.col(s).alias(f"b_{s}") for s in (*g.SIDES, *more)])
    return left.join(right, FRAME)


def mask_candidates(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of a frame whose boxes share one of 8x8 cells, once each: an equi-join on (frame, cell)."""
    cell = lambda df, i, name: df.select(*FRAME, F.col(i).alias(name), F.explode(g.cells(g.box())).alias("cell"))
    return cell(a, a_id, "a_id").join(cell(b, b_id, "b_id"), [*FRAME, "cell"]).select(*FRAME, "a_id", "b_id").distinct()


def one_to_one(pairs: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Greedy matching: pairs in order, each taken if both ends are free."""
    return greedy(pairs, FRAME, order, columns, lambda k, x: (k["a_id"] == x["a_id"]) | (k["b_id"] == x["b_id"]))


def match_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str, least: float, score: Column | None = None, more: list[str] = []) -> DataFrame:
    """The shared matcher: each a in the order of its id takes the free b of the best score (U1: any column over a_ and b_ columns)."""
    pairs = sides(a, b, a_id, b_id, more).withColumn("score", g.above(g.iou(g.box("a_"), g.box("b_")) if score is None else score, least)).where("score > 0")
    return one_to_one(pairs, [F.col("a_id"), -F.col("score"), F.col("b_id")], ["a_id", "b_id", "score"])


def suppress(det: DataFrame, least: float, most: int | None = None, keep: list[str] = []) -> DataFrame:
    """Non-maximum suppression by class: the rows that survive, with their keys and ids (most: of each class and frame)."""
    keys = [*FRAME, "cl"]
    kept = greedy(det, keys, [-F.col("conf"), F.col("det_id")], ["det_id", "conf", *g.SIDES, *keep], lambda k, x: g.iou_suppression(k, x) > least)
    if most is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf"), "det_id"))).where(F.col("_r") <= most).drop("_r")
    return kept


def suppress_half(det: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """Suppression as a half-precision kernel does it: scores and corners in 16 bits, ties of such scores in the order of ids, overlaps in 32 bits without an epsilon; so rows differ from suppress() where scores or corners meet in 16 bits."""
    keys = [*FRAME, "cl"]
    rounded = det.withColumns({"half_conf": half(F.col("conf")), **{f"half_{s}": half(F.col(s)).cast("float") for s in g.SIDES}})

    def clash(k: Column, x: Column) -> Column:
        side = lambda b, s: b[f"half_{s}"]
        width = lambda lo, hi: F.greatest(F.lit(0.0).cast("float"), F.least(side(k, hi), side(x, hi)) - F.greatest(side(k, lo), side(x, lo)))
        area = lambda b: (side(b, "x1") - side(b, "x0")) * (side(b, "y1") - side(b, "y0"))
        meet = width("x0", "x1") * width("y0", "y1")
        whole = area(k) + area(x) - meet
        return F.when(whole != 0, (meet / whole).cast("float") > F.lit(least).cast("float")).otherwise(False)

    kept = greedy(rounded, keys, [-F.col("half_conf"), F.col("det_id")], ["det_id", "conf", "half_conf", *[f"half_{s}" for s in g.SIDES]], clash)
    if most is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("half_conf"), "det_id"))).where(F.col("_r") <= most).drop("_r")
    return kept


def fuse(det: DataFrame, least: float = 0.3, person: int = 0, face: int = 1, drop_faces: bool = True) -> DataFrame:
    """Each person with the box and confidence of the face matched to it (sub_*), by overlap over the smaller box."""
    people, faces = det.where(F.col("cl") == person), det.where(F.col("cl") == face)
    pairs = sides(people, faces, "det_id", "det_id", ["conf"]).withColumn("score", g.above(g.part_overlap(g.box("a_"), g.box("b_")), least)).where("score > 0")
    found = one_to_one(pairs, [F.col("a_id"), -F.col("score"), F.col("b_id")], ["a_id", "b_id", "b_conf", *[f"b_{s}" for s in g.SIDES]])
    sub = found.select(*FRAME, F.col("a_id").alias("det_id"), F.col("b_id").alias("face_id"), F.col("b_conf").alias("sub_conf"), *[F.col(f"b_{s}").alias(f"sub_{s}") for s in g.SIDES])
    rows = det.where(F.col("cl") != face) if drop_faces else det
    if "face_points" not in det.columns:
        return rows.join(sub, [*FRAME, "det_id"], "left")
    # a matched person takes the face's points
    sub = sub.join(faces.select(*FRAME, F.col("det_id").alias("face_id"), F.col("face_points").alias("_points")), [*FRAME, "face_id"], "left")
    both = rows.join(sub, [*FRAME, "det_id"], "left")
    return both.withColumn("face_points", F.when(F.col("face_id").isNotNull() & (F.col("cl") == person), F.col("_points")).otherwise(F.col("face_points"))).drop("_points")


def duplicate_tracks(tracks: DataFrame, over: float = 0.7) -> DataFrame:
    """stream_id, frame_no, track_id of the tracks (with their age in frames) that a longer-lived one stands on; of equals the first goes."""
    pairs = sides(tracks, tracks, "track_id", "track_id", ["age"]).where(F.col("a_id") < F.col("b_id")).where(g.iou(g.box("a_"), g.box("b_")) > over)
    return pairs.select(*FRAME, F.when(F.col("a_age") > F.col("b_age"), F.col("b_id")).otherwise(F.col("a_id")).alias("track_id")).distinct()


def tracks_joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tracks of a, then those of b whose id (of a stream) a has not."""
    return a.unionByName(b.join(a.select("stream_id", "track_id"), ["stream_id", "track_id"], "left_anti"))


def tracks_without(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tracks of a whose id (of a stream) b has not."""
    return a.join(b.select("stream_id", "track_id"), ["stream_id", "track_id"], "left_anti")


def mota_matches(hyp: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """stream_id, frame_no, frame_index, a_id (track), b_id (truth), iou of the matches, with switched and fragmented."""
    pairs = sides(hyp, gt, "track_id", "gt_id").withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where(F.col("iou") >= least)
    found = one_to_one(pairs, [-F.col("iou"), F.col("a_id"), F.col("b_id")], ["a_id", "b_id", "iou"])
    frames = hyp.select(*FRAME).unionByName(gt.select(*FRAME)).distinct().withColumn("frame_index", F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_no")))
    own = Window.partitionBy("stream_id", "b_id").orderBy("frame_index")
    before = found.join(frames, FRAME).withColumn("_id", F.lag("a_id").over(own)).withColumn("_at", F.lag("frame_index").over(own))
    switched = F.coalesce(F.col("_id") != F.col("a_id"), F.lit(False))
    return before.select(*FRAME, "frame_index", "a_id", "b_id", "iou", switched.alias("switched"), (switched & (F.col("frame_index") - F.col("_at") > 1)).alias("fragmented"))


def mota_frames(hyp: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """matches, false positives, misses, switches and fragmentations of each frame."""
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    m = mota_matches(hyp, gt, least).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("matches"), F.sum("iou").alias("total_iou"), F.count_if("switched").alias("switches"), F.count_if("fragmented").alias("fragmentations"))
    rows = count(gt, "n_gt").join(count(hyp, "n_hyp"), FRAME, "full").join(m, FRAME, "left").na.fill(0)
    return rows.select(*FRAME, "n_gt", "n_hyp", "matches", (F.col("n_hyp") - F.col("matches")).alias("fp"), (F.col("n_gt") - F.col("matches")).alias("misses"), "switches", "fragmentations", "total_iou")


def mota_objects(hyp: DataFrame, gt: DataFrame, least: float = 0.5) -> DataFrame:
    """Frames and matched frames of each true object, and whether it is mostly or partly tracked, or mostly lost."""
    m = mota_matches(hyp, gt, least).groupBy("stream_id", F.col("b_id").alias("gt_id")).agg(F.count(F.lit(1)).alias("matched"))
    rows = gt.groupBy("stream_id", "gt_id").agg(F.count(F.lit(1)).alias("frames")).join(m, ["stream_id", "gt_id"], "left").na.fill(0)
    share = F.col("matched") / F.col("frames")
    return rows.withColumn("quality", F.when(share >= 0.8, "MT").when(share >= 0.2, "PT").otherwise("ML"))


def mota_summary(hyp: DataFrame, gt: DataFrame, least: float = 0.5, by: list[str] = ["stream_id"]) -> DataFrame:
    """The final metrics of each stream (or of all: by=[]). Matches are summed by true object once; all counts start from those sums."""
    keys = by or ["_all"]
    told = lambda df: df if by else df.withColumn("_all", F.lit(1))
    own = mota_matches(hyp, gt, least).groupBy("stream_id", "b_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("iou").alias("total_iou"), F.count_if("switched").alias("switches"), F.count_if("fragmented").alias("fragmentations"), F.collect_set("a_id").alias("tracks"))
    each = gt.groupBy("stream_id", F.col("gt_id").alias("b_id")).agg(F.count(F.lit(1)).alias("n")).join(own, ["stream_id", "b_id"], "left").na.fill(0)
    share = F.col("matched") / F.col("n")
    objects = told(each).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("n").alias("n_gt"), F.sum("matched").alias("matches"), F.sum("total_iou").alias("total_iou"), F.sum("switches").alias("switches"), F.sum("fragmentations").alias("fragmentations"),
        F.count_if(share >= 0.8).alias("mostly_tracked"), F.count_if((share >= 0.2) & (share < 0.8)).alias("partly_tracked"), F.count_if(share < 0.2).alias("mostly_lost"), F.count_if(F.col("matched") == 0).alias("missed"),
    )
    frames = told(hyp.select(*FRAME).unionByName(gt.select(*FRAME)).distinct()).groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    used = own.select("stream_id", F.explode("tracks").alias("track_id"), F.lit(True).alias("used")).distinct()
    tracks = hyp.groupBy("stream_id", "track_id").agg(F.count(F.lit(1)).alias("n")).join(used, ["stream_id", "track_id"], "left")
    found = told(tracks).groupBy(*keys).agg(F.sum("n").alias("n_hyp"), F.count_if(F.col("used").isNull()).alias("fp_tracks"))
    rows = frames.join(objects, keys, "left").join(found, keys, "left").na.fill(0).withColumn("fp", F.col("n_hyp") - F.col("matches")).withColumn("misses", F.col("n_gt") - F.col("matches"))
    m, fp, miss = F.col("matches"), F.col("fp"), F.col("misses")
    return rows.select(
        *by, "frames", "objects", "n_gt", "matches", "fp", "misses", "switches", "fragmentations", "mostly_tracked", "partly_tracked", "mostly_lost", "missed", "fp_tracks",
        F.try_divide(m, m + miss).alias("recall"), F.try_divide(m, m + fp).alias("precision"), (1 - F.try_divide(miss + fp + F.col("switches"), F.col("n_gt"))).alias("mota"), F.try_divide(F.col("total_iou"), m).alias("motp"), F.try_divide(2 * m, 2 * m + fp + miss).alias("idf1"),
    )
