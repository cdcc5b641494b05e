"""Binary files written by executors: a Python data source with commit and abort.

A task writes the files of its rows under temporary names; the commit of the
whole job gives them their names, an abort deletes them, and a task that is run
again writes under other names, so a lost executor leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sightline.sources.ranged import store


class Written(WriterCommitMessage):
    def __init__(self, files: dict[str, str]):
        self.files = files


class FilesWriter(DataSourceArrowWriter):
    """Rows (name, data) to files below a folder; a file's rows are consecutive, in its order, and in one task."""

    def __init__(self, folder: str):
        self.folder = folder

    def _temporary(self, path: str) -> str:
        return f"{path}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = store(self.folder)
        files: dict[str, str] = {}
        now, out = None, None
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if name != now:
                    if out is not None:
                        out.close()
                    if name in files:
                        raise ValueError(f"rows of {name} are not consecutive")
                    fs.create_dir(path, recursive=True)
                    now, files[name] = name, self._temporary(path)
                    out = fs.open_output_stream(files[name])
                out.write(data or b"")
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = store(self.folder)
        fs.create_dir(path, recursive=True)
        named = [(name, at) for m in messages if m is not None for name, at in m.files.items()]
        if len({name for name, _ in named}) < len(named):
            self.abort(messages)
            raise ValueError("rows of a file are in several tasks")
        for name, at in named:
            fs.move(at, f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = store(self.folder)
        for m in messages:
            for at in (m.files if m is not None else {}).values():
                fs.delete_file(at)


class FilesSink(DataSource):
    """Option: path, the folder."""

    @classmethod
    def name(cls) -> str:
        return "sightline_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Files of rows (name, data and order columns): dealt by name and sorted, so no task holds more than a batch of a file."""
    rows.sparkSession.dataSource.register(FilesSink)
    dealt = rows.repartition("name").sortWithinPartitions("name", *order).select("name", "data")
    dealt.write.format("sightline_files").mode("append").save(folder)
