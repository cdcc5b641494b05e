"""What the operators share: staged tables in the cluster's shared folder, and Arrow columns as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sightline.sources.shared import new_folder as new_path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: later plans start from these files, so a lost executor costs no more than the reading."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all of df: as many as its scan has, and no fewer than the session asks for."""
    return max(parallelism(df.sparkSession), df.rdd.getNumPartitions())


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: of a batch as Spark sends it, which may be tens of MB, no more becomes Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of one column, and one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum([len(x) for x in as_bytes(batch.column(column))])
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)
