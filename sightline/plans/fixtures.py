"""Detections, ground truth, tracker output and packets derived from `events`, as SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Frames are blocks of events, so that a frame has about as many detections whatever the scale.
_FRAME = {"spark": "CAST(event_id div 64 AS BIGINT)", "duckdb": "event_id // 64"}
#: Four streams with a frame an hour, for which metrics are known.
_HOUR = {"spark": "CAST(datediff(to_date(ts), DATE'2024-01-01') * 24 + hour(ts) AS BIGINT)", "duckdb": "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts)"}
_K = {"spark": "1000.0D", "duckdb": "1000.0::DOUBLE"}
ENGINES = ("spark", "duckdb")


def _frame(engine: str, hourly: bool) -> str:
    return f"user_id % 4 AS stream_id, {_HOUR[engine]} AS frame_no" if hourly else f"user_id % 16 AS stream_id, {_FRAME[engine]} AS frame_no"


def det(engine: str, events: str = "events", hourly: bool = False) -> str:
    k = _K[engine]
    return f"""SELECT {_frame(engine, hourly)}, event_id AS det_id, user_id,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN 2 ELSE 0 END AS cl,
  (50 + (event_id * 7919) % 950) / {k} AS conf,
  ((user_id * 37) % 800 + (event_id % 5) * 4) / {k} AS x0,
  ((user_id * 53) % 700 + (event_id % 3) * 6) / {k} AS y0,
  ((user_id * 37) % 800 + (event_id % 5) * 4 + 60 + (user_id % 7) * 20) / {k} AS x1,
  ((user_id * 53) % 700 + (event_id % 3) * 6 + 90 + (user_id % 5) * 40) / {k} AS y1
FROM {events}"""


def gt(engine: str, events: str = "events", hourly: bool = False) -> str:
    k = _K[engine]
    return f"""SELECT DISTINCT {_frame(engine, hourly)}, user_id AS gt_id,
  ((user_id * 37) % 800 + 8) / {k} AS x0, ((user_id * 53) % 700 + 6) / {k} AS y0,
  ((user_id * 37) % 800 + 8 + 60 + (user_id % 7) * 20) / {k} AS x1,
  ((user_id * 53) % 700 + 6 + 90 + (user_id % 5) * 40) / {k} AS y1
FROM {events} WHERE event_type NOT IN ('signup', 'error')"""


def hyp(engine: str, events: str = "events", hourly: bool = False) -> str:
    return f"""SELECT stream_id, frame_no, det_id, track_id, conf, x0 + dx AS x0, y0, x1 + dx AS x1, y1 FROM (
  SELECT stream_id, frame_no, det_id, conf, x0, y0, x1, y1,
    CASE WHEN det_id % 13 = 0 THEN 300 ELSE 0 END / {_K[engine]} AS dx,
    user_id * 10 + CAST(floor(frame_no / 240) AS BIGINT) AS track_id,
    row_number() OVER (PARTITION BY stream_id, frame_no, user_id ORDER BY det_id) AS rn
  FROM ({det(engine, events, hourly)}) d WHERE cl = 0 AND det_id % 11 <> 0) t WHERE rn = 1"""


def pkt(engine: str, events: str = "events") -> str:
    return f"""SELECT stream_id, seq_no, (65000 + seq_no) % 65536 AS seq16,
  (4294960000 + 3000 * CAST(floor(seq_no / 4) AS BIGINT)) % 4294967296 AS ts32, seq_no % 4 = 3 AS marker,
  row_number() OVER (PARTITION BY stream_id ORDER BY seq_no
    + CASE WHEN event_id % 97 = 0 THEN 40.5 WHEN event_id % 17 = 0 THEN 2.5 ELSE 0 END, seq_no) AS arrival_no
FROM (SELECT user_id % 4 AS stream_id, event_id,
        CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS BIGINT) AS seq_no FROM {events}) t
WHERE event_id % 53 <> 0"""


def sample(engine: str, events: str = "events") -> str:
    return f"SELECT event_type AS series, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS i, value AS v FROM {events}"


def clock(engine: str, events: str = "events") -> str:
    """Frames of four streams with times in seconds that sometimes jump."""
    return f"SELECT user_id % 4 AS stream_id, event_id AS frame_no, (event_id * 13 % 1000000 + event_id % 7 * 40 + CASE WHEN event_id % 499 = 0 THEN 90000 ELSE 0 END) / {_K[engine]} AS t, (event_id * 31 % 100) / {_K[engine]} AS area, event_id % 41 <> 0 AS has_image FROM {events}"


def view(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    return spark.sql(make("spark", "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
