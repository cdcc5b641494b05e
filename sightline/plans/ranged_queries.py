"""Queries over files that are read in byte ranges. Their bytes are made from `events` and `embeddings`, written by the sink for binary files, a few long files each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.plans.media_queries import _NAL_SQL, _PCAP, _captured, _rtp, _udp, embeddings, events, hexed, little, text_hex
from sightline.plans.queries import DET, ORACLE, clock, det, q, q6, query
from sightline.sources import labels, ranged, sinks
from sightline.sources.shared import new_folder


def _written(rows: DataFrame, name: Column, order: str, part: Column, folder: str) -> str:
    """The folder of files of rows' parts (hexadecimal), in order."""
    path = new_folder(rows.sparkSession, folder)
    sinks.write_files(rows.select(name.alias("name"), F.col(order).alias("place"), F.unhex(part).alias("data")), path, ["place"])
    return path


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", F.regexp_extract("path", "[^/]+$", 0))


def _nal(k: Column) -> Column:
    user = F.col("user_id")
    head = F.when(k == 0, "6742").when(k == 1, "68CE").when(k == 2, "6588").when(user % 3 == 0, "4140").otherwise("4188")
    return F.concat(head, hexed(user % 251 + 4, 1), hexed(F.col("event_id") % 251 + 4, 1))


def _long_units_sql(name: str, fps: int) -> str:
    return f"""WITH n AS (SELECT *, event_id % 20 AS k, event_id // 2000 AS f, {_NAL_SQL} AS nal FROM events),
v AS (SELECT *, k > 1 AS video, k = 2 OR (k > 2 AND user_id % 3 <> 0) AS first_ FROM n),
b AS (SELECT *, first_ AND coalesce(sum(CASE WHEN video THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS new_ FROM v),
u AS (SELECT *, CAST(sum(CASE WHEN new_ THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY event_id) AS BIGINT) AS au_no FROM b)
SELECT 'video' || f || '{name}' AS path, au_no, CAST(au_no * {90_000 // fps} AS BIGINT) AS ts90k, bool_or(k = 2) AS key, CAST(count(*) AS INT) AS n_nals, string_agg('00000001' || nal, '' ORDER BY event_id) AS data FROM u GROUP BY f, au_no"""


@query(_long_units_sql(".264", 25))
def annexb_ranges(spark, d):
    """Long streams in ranges of 8 KB, cut by start codes"""
    e, i = events(spark, d), F.col("event_id")
    path = _written(e, F.concat(F.lit("video"), F.floor(i / 2000).cast("string"), F.lit(".264")), "event_id", F.concat(F.lit("00000001"), _nal(i % 20)), "annexb")
    return _named(ranged.annexb_units(spark, path, fps=25.0, range_bytes=8192)).withColumn("data", F.hex("data"))


@query(_long_units_sql(".avcc", 30))
def length_prefixed_ranges(spark, d):
    """Long streams in ranges of 8 KB; a range begins with a chain of lengths"""
    e, i = events(spark, d), F.col("event_id")
    nal = _nal(i % 20)
    path = _written(e, F.concat(F.lit("video"), F.floor(i / 2000).cast("string"), F.lit(".avcc")), "event_id", F.concat(hexed((F.length(nal) / 2).cast("long"), 4), nal), "lengths")
    return _named(ranged.length_prefixed_units(spark, path, range_bytes=8192, backBytes=2048)).withColumn("data", F.hex("data"))


@query("""SELECT 'capture' || event_id // 2500 || '.pcap' AS path, row_number() OVER (PARTITION BY event_id // 2500 ORDER BY event_id) AS arrival_no, CAST((1000 + event_id) * 1000000 + event_id * 7 % 1000000 AS BIGINT) AS capture_us, CAST(5000 + event_id % 4 AS INT) AS port,
'8060' || printf('%04X', event_id * 3 % 65536) || printf('%08X', event_id * 3000 % 4294967296) || '00000007' || 'AABB' || printf('%02X', event_id % 256) AS data FROM events WHERE event_id % 6 <> 5""")
def pcap_ranges(spark, d):
    """Long captures in ranges of 32 KB; a range begins with a chain of record heads, and packets are numbered by a count a range"""
    i = F.col("event_id")
    rtp = _rtp(i * 3 % 65536, i * 3000, F.lit(False), F.concat(F.lit("AABB"), hexed(i % 256, 1)))
    record = F.when(i % 6 == 5, _captured(1000 + i, i * 7 % 1_000_000, "06", F.lit("00500051" + "00" * 8 + "50000000" + "00000000"))).otherwise(_captured(1000 + i, i * 7 % 1_000_000, "11", _udp(5000 + i % 4, rtp)))
    e = events(spark, d).select("event_id", F.floor(i / 2500).alias("file"), record.alias("part"))
    heads = e.select(F.lit(-1).cast("long").alias("event_id"), "file", F.lit(_PCAP).alias("part")).distinct()
    path = _written(e.unionByName(heads), F.concat(F.lit("capture"), F.col("file").cast("string"), F.lit(".pcap")), "event_id", F.col("part"), "captures")
    rows = ranged.pcap_packets(spark, path, 32 << 10, backBytes=8192)
    return _named(rows).withColumn("data", F.hex("data"))


@query("""WITH x AS (SELECT vec_id // 50 AS f, (dense_rank() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1) * 64 + i AS k, greatest(-32768, least(32767, floor(x::DOUBLE * 8192 + 0.5))) AS v
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings) t)
SELECT 'a' || f || '.wav' AS path, CAST(k // 160 AS BIGINT) AS chunk_no, CAST(320 AS INT) AS rate, CAST(2 AS INT) AS channels, CAST(count(*) AS INT) AS n, CAST(sum(v * (k % 160 + 1)) AS BIGINT) AS total FROM x GROUP BY f, k // 160""")
def wav_ranges(spark, d):
    """Long files of two channels in chunks of a quarter second, read in ranges of 1,000 bytes"""
    pcm = F.array_join(F.transform("embedding", lambda x: little(F.pmod(F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * 8192 + 0.5))), F.lit(65536)), 2)), "")
    e = embeddings(spark, d).select(F.col("vec_id").alias("place"), F.floor(F.col("vec_id") / 50).alias("file"), pcm.alias("part"))
    size = F.count(F.lit(1)) * 128
    head = F.concat(F.lit(text_hex("RIFF")), little((size + 36).cast("long"), 4), F.lit(text_hex("WAVEfmt ") + "10000000" + "0100" + "0200" + "40010000" + "00050000" + "0400" + "1000" + text_hex("data")), little(size.cast("long"), 4))
    heads = e.groupBy("file").agg(head.alias("part")).withColumn("place", F.lit(-1).cast("long"))
    path = _written(e.unionByName(heads), F.concat(F.lit("a"), F.col("file").cast("string"), F.lit(".wav")), "place", F.col("part"), "wavs")
    rows = ranged.wav_chunks(spark, path, 250, 1000)
    total = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * 32768 * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return _named(rows).select("path", "chunk_no", F.col("sample_rate").alias("rate"), F.col("num_channels").alias("channels"), F.size("samples").alias("n"), F.round(total).cast("long").alias("total"))


# typed state of streams: the same rows as in batch


@query(ORACLE["best_shot"])
def stream_best_shot(spark, d):
    """R15 on transformWithState: shots of a stream of detections, in four micro-batches"""
    from sightline.operators import steps
    from sightline.streaming import drivers, states

    rows = det(spark, d).select("stream_id", F.col("user_id").alias("track_id"), "frame_no", "det_id", g.clip_quality(g.box(), F.col("conf")).alias("q"))
    stream = states.replayed(rows, "det_id", 4)
    out = states.stepped(stream, ["stream_id", "track_id"], ["frame_no", "det_id"], lambda: steps.BestShot(least=0.005), "best double, best_frame long", "stream_id long, track_id long, frame_no long, det_id long, taken boolean, best double, best_frame long")
    return drivers.drained(out).withColumn("best", q6(F.col("best")))


@query(ORACLE["snapshot_cadence"])
def stream_snapshots(spark, d):
    """R17 on transformWithState"""
    from sightline.operators import steps
    from sightline.streaming import drivers, states

    stream = states.replayed(clock(spark, d), "t", 3)
    out = states.stepped(stream, ["stream_id"], ["t", "frame_no"], steps.Snapshot, "picture double, embedding double", "stream_id long, frame_no long, picture boolean, embedded boolean")
    return drivers.drained(out).where("picture").select("stream_id", "frame_no", "embedded")


#: A sequence parameter set of 640 x 480.
_SPS = "6742001EF40501EC80"
_KEY_DATA = "'000000096742001EF40501EC80' || '0000000268CE' || '00000004' || '6588' || printf('%02X', event_id % 251 + 4) || printf('%02X', user_id % 251 + 4)"


@query(f"""WITH u AS (SELECT *, user_id % 4 AS stream_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS n FROM events),
d AS (SELECT *, lead(event_id) OVER (PARTITION BY stream_id ORDER BY n) - event_id AS gap FROM u),
t AS (SELECT *, CAST(CASE WHEN gap IS NULL THEN coalesce(sum(gap * 900) OVER (PARTITION BY stream_id) // nullif(count(gap) OVER (PARTITION BY stream_id), 0), 3003) ELSE gap * 900 END AS BIGINT) AS duration, n // 12 + 1 AS fragment_no FROM d),
b AS (SELECT stream_id, fragment_no, CAST(coalesce(sum(sum(duration)) OVER (PARTITION BY stream_id ORDER BY fragment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM t GROUP BY stream_id, fragment_no)
SELECT stream_id || '.mp4' AS path, fragment_no, CAST(n % 12 AS INT) AS sample_no, decode_time, duration, n % 12 = 0 AS key, CASE WHEN n % 12 = 0 THEN {_KEY_DATA} ELSE '00000004' || '4188' || printf('%02X', event_id % 251 + 4) || printf('%02X', user_id % 251 + 4) END AS data FROM t JOIN b USING (stream_id, fragment_no)""")
def mp4_files(spark, d):
    """K2, K3: streams of units written as fragmented files, a fragment a key unit, and their samples read back in ranges of 8 KB"""
    from sightline.sources import mp4

    e = events(spark, d)
    n = F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id")) - 1
    tail = F.concat(hexed(F.col("event_id") % 251 + 4, 1), hexed(F.col("user_id") % 251 + 4, 1))
    data = F.when(F.col("au_no") % 12 == 0, F.concat(F.lit("00000001" + _SPS + "0000000168CE" + "000000016588"), tail)).otherwise(F.concat(F.lit("000000014188"), tail))
    units = e.withColumn("au_no", n.cast("long")).select((F.col("user_id") % 4).alias("stream_id"), "au_no", (F.col("event_id") * 900 + 7).alias("ts64"), F.unhex(data).alias("data"))
    path = new_folder(spark, "movies")
    mp4.write_mp4(units, path)
    return _named(mp4.read_mp4(spark, path, 8192, backBytes=4096)).select("path", "fragment_no", "sample_no", "decode_time", "duration", "key", F.hex("data").alias("data"))


@query(f"""SELECT 's' || stream_id || '.yaml' AS path, frame_no, {q('frame_no * 0.5', 't')}, det_id AS gt_id, CAST(cl AS VARCHAR) AS cl, {q('conf', 'conf')}, {', '.join(q(c, c) for c in g.SIDES)} FROM {DET} d""")
def trackset_yaml(spark, d):
    """Track files in YAML, a frame a row while they are written, read in ranges of 16 KB; frames without objects are kept in number"""
    item = F.concat(F.lit("    '"), F.col("det_id").cast("string"), F.lit("':\n      box: ["), F.array_join(F.array(*[F.col(c).cast("string") for c in g.SIDES]), ", "), F.lit("]\n      class: "), F.col("cl").cast("string"), F.lit("\n      conf: "), F.col("conf").cast("string"), F.lit("\n"))
    frames = det(spark, d).groupBy("stream_id", "frame_no").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("objects"))
    last = frames.groupBy("stream_id").agg(F.max("frame_no").alias("last"))
    every = last.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame_no")).join(frames, ["stream_id", "frame_no"], "left")
    text = F.concat(F.lit("- frame_time: "), (F.col("frame_no") * 0.5).cast("string"), F.lit("\n  objects:"), F.coalesce(F.concat(F.lit("\n"), F.col("objects")), F.lit(" {}\n")))
    heads = last.select("stream_id", F.lit(-1).cast("long").alias("place"), F.lit("metadata:\n  classes: [person]\n  frame_rate: 2\n  width: 1\n  height: 1\n  original_video: v\nframes:\n").alias("text"))
    rows = every.select("stream_id", F.col("frame_no").alias("place"), text.alias("text")).unionByName(heads)
    path = _written(rows, F.concat(F.lit("s"), F.col("stream_id").cast("string"), F.lit(".yaml")), "place", F.hex(F.encode("text", "UTF-8")), "yaml")
    out = _named(labels.read_yaml_trackset(spark, path, 16 << 10))
    return out.select("path", "frame_no", q6(F.col("t")).alias("t"), "gt_id", "cl", q6(F.col("conf")).alias("conf"), *[q6(F.col(c)).alias(c) for c in g.SIDES])
