"""Counters of running streams: observed metrics, gathered by a listener into a table."""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STATS = "query string, batch long, at timestamp, name string, key string, value double"


def counted(stream: DataFrame, name: str, **counters: Column) -> DataFrame:
    """stream, its counters (aggregates, or conditions that are counted) observed under a name: no second pass, no state."""
    of = {k: F.count_if(c) if k.startswith("n_") else c for k, c in counters.items()}
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in of.items()])


class Stats(StreamingQueryListener):
    """Keeps what each micro-batch of every query observed, and its durations; table() has it all, yaml() the sums of one query as text."""

    def __init__(self):
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at, name = p.timestamp, p.name or str(p.id)
        found = [(name, p.batchId, at, o, k, float(v)) for o, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None]
        found += [(name, p.batchId, at, "durations", k, float(v)) for k, v in p.durationMs.items()]
        found += [(name, p.batchId, at, "input", "rows", float(p.numInputRows))]
        with self._lock:
            self._rows += found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self) -> list[tuple]:
        with self._lock:
            return list(self._rows)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.rows(), "query string, batch long, at string, name string, key string, value double")
        return rows.withColumn("at", F.to_timestamp("at"))

    def totals(self, query: str) -> dict[str, dict[str, float]]:
        """Sums over the micro-batches of a query: name, key, value."""
        out: dict = {}
        for q, _, _, name, key, value in self.rows():
            if q == query:
                own = out.setdefault(name, {})
                own[key] = own.get(key, 0.0) + value
        return out

    def yaml(self, query: str) -> str:
        lines = [f"{json.dumps(query)}:"]
        for name, own in sorted(self.totals(query).items()):
            lines.append(f"  {name}:")
            lines += [f"    {k}: {v:g}" if v != int(v) else f"    {k}: {int(v)}" for k, v in sorted(own.items())]
        return "\n".join(lines) + "\n"
