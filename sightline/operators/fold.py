"""Two ways to run an order-dependent step over the rows of a key.

greedy() folds inside the JVM, for groups bounded by nature (the detections of a
frame). ordered_scan() is for long sequences (the frames or packets of a
stream): rows are dealt by key, sorted within partitions (which spills) and
stepped through batch by batch, so no task holds a key's rows at once. A key is
sequential by definition; different keys run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], name: str = "items") -> DataFrame:
    """One row a key, with an array of its rows sorted by `order`, which must be total."""
    item = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *columns)
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias(name))


def greedy(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], clash: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows that a greedy choice keeps: in order, each row that clashes with no kept row of its key."""
    groups = ordered(df, keys, order, columns)
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.array_append(acc, x)))
    return groups.select(*keys, F.explode(kept).alias("_k")).select(*keys, *[F.col(f"_k.{c}").alias(c) for c in columns])


class Step:
    """One key's state: push() a row (a dict), get rows (dicts) back; end() after the last."""

    def push(self, row: dict) -> Iterable[dict]:
        raise NotImplementedError

    def end(self) -> Iterable[dict]:
        return ()


#: Rows that are Python objects at a time.
SLICE = 2048


def values_of(column: pa.Array) -> list:
    """to_pylist(), a column at a time: numbers without nulls by NumPy, lists and structs by what they hold."""
    kind = column.type
    if pa.types.is_list(kind):
        at = column.offsets.to_pylist()
        items = values_of(column.values.slice(at[0], at[-1] - at[0]))
        out = [items[a - at[0] : b - at[0]] for a, b in zip(at, at[1:], strict=False)]
    elif pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, x, strict=True)) for x in zip(*map(values_of, column.flatten()), strict=True)]
    elif not column.null_count and (pa.types.is_integer(kind) or kind in (pa.float32(), pa.float64())):
        return column.to_numpy().tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        out = [x if valid else None for x, valid in zip(out, column.is_valid().to_pylist(), strict=True)]
    return out


def stepped(make: Callable[[], Step], keys: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(rows: list[dict], owners: list[tuple]) -> pa.RecordBatch:
        column = lambda n: [r.get(n, o[keys.index(n)]) for r, o in zip(rows, owners, strict=True)] if n in keys else [r.get(n) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(column(f.name), f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            names = batch.schema.names
            for part in (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE)):
                out, owners = [], []
                for values in zip(*map(values_of, part.columns), strict=True):
                    row = dict(zip(names, values, strict=True))
                    key = tuple([row[k] for k in keys])
                    if step is None or key != now:
                        if step is not None:
                            out += step.end()
                            owners += [now] * (len(out) - len(owners))
                        now, step = key, make()
                    out += step.push(row)
                    owners += [key] * (len(out) - len(owners))
                if out:
                    yield made(out, owners)
        if step is not None and (last := list(step.end())):
            yield made(last, [now] * len(last))

    return run


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by ranges of the keys, a heavy key a task: a hash puts several of few keys into one task, and so do small partitions that are merged. Takes a pass over df to sample its keys."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartitionByRange(tasks, *keys)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], schema: str, few: bool = False) -> DataFrame:
    """What the steps of each key return. schema: of the keys and the step's columns; it must name the keys. few: keys are few and their steps slow, so they are dealt apart()."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    dealt = apart(df, keys) if few else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(stepped(make, keys, to_arrow_schema(kind)), kind)
