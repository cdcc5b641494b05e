"""The stateful steps over streams, and windowed counts, on Structured Streaming.

stateful() keeps a pickled Step for each key in the state store and pushes each
micro-batch's rows to it in order; it gives what ordered_scan gives for the same
rows, if rows arrive in order across batches. Rate limits at the source
(maxFilesPerTrigger) take the place of queues that pause.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from sightline.operators.fold import Step
from sightline.sources.shared import new_folder


def _plain(x):
    """Nested values as batch steps get them: lists and dicts."""
    if isinstance(x, np.ndarray | list):
        return [_plain(v) for v in x]
    if isinstance(x, Row):
        x = x.asDict()
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


#: Rows of a key that are Python objects at a time.
SLICE = 2048


def pushed(step: Step, frame: pd.DataFrame) -> Iterator[list[dict]]:
    """What a step returns for a key's rows in order, a slice of them at a time: a micro-batch stays in columns but for the slice."""
    for at in range(0, len(frame), SLICE):
        part = frame.iloc[at : at + SLICE]
        yield [r for row in part.astype(object).where(part.notna(), None).to_dict("records") for r in step.push(_plain(row))]


def stateful(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], schema: str, idle_ms: int = 0) -> DataFrame:
    """What the steps return; a key idle for idle_ms is ended and forgotten (0: never)."""
    names = _parse_datatype_string(schema).names

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = dict(zip(keys, key, strict=True))
        step = pickle.loads(state.get[0]) if state.exists else make()
        if state.hasTimedOut:
            yield pd.DataFrame([{**own, **r} for r in step.end()], columns=names)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(order, kind="stable", ignore_index=True)
            for out in pushed(step, rows):
                yield pd.DataFrame([{**own, **r} for r in out], columns=names)
            state.update((pickle.dumps(step),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "step binary", "append", timeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has now, written as Parquet by executors to the shared folder, with its checkpoint beside it. In complete mode, the last table."""
    spark = stream.sparkSession
    path = new_folder(spark, "drained")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        # a batch that is run again replaces its own folder
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else batch}")

    watched(stream, put, f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").select(*stream.columns)


def watched(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append", trigger: dict | None = None):
    """The running query that gives each micro-batch of results to a callback (results, batch number); stop() ends it, processAllAvailable() waits for what is there."""
    path = checkpoint or new_folder(stream.sparkSession, "watched")
    return stream.writeStream.outputMode(mode).option("checkpointLocation", path).trigger(**(trigger or {"availableNow": True})).foreachBatch(callback).start()


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream, with a timestamp that watermarks take."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).format("parquet")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    # a stream reads a folder; a table of one file is one of the files of its folder
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    rows = reader.load(path) if folder else reader.option("pathGlobFilter", "events.parquet").load(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
