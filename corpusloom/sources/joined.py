"""One text file from many tasks: tasks write their parts beside it, the commit joins them in order.

A part belongs to one attempt of one task; only those named in the commit messages of successful attempts are joined,
so retried and lost tasks leave no trace in the file, and the file appears at once, by a rename. The join copies bytes
through a buffer of fixed size: a single file is written by a single writer, whatever its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that the join holds.
BUFFER = 4 << 20


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or local path; any store that pyarrow knows."""
    from pathlib import Path

    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else Path(path).absolute().as_uri())


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.head, self.tail, self.between = options["path"], options.get("head", ""), options.get("tail", ""), options.get("between", "\n")
        self.run = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        store, folder = filesystem(self.run)
        number = TaskContext.get().partitionId()
        name, rows = f"{folder}/{number}-{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(name) as out:
            for row in iterator:
                out.write(f"{self.between if rows else ''}{row[0]}".encode())
                rows += 1
        return Part(number, name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, to = filesystem(self.path)
        folder = filesystem(self.run)[1]
        store.create_dir(folder, recursive=True)
        whole, first = f"{folder}/whole", True
        with store.open_output_stream(whole) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write(b"" if first else self.between.encode())
                first = False
                with store.open_input_stream(part.path) as piece:
                    while data := piece.read(BUFFER):
                        out.write(data)
            out.write(self.tail.encode())
        store.move(whole, to)
        store.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, folder = filesystem(self.run)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class JoinedText(DataSource):
    """A sink of rows of one string: head, the rows in the order of partitions with `between` in between, tail."""

    @classmethod
    def name(cls) -> str:
        return "joined_text"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write(rows: DataFrame, path: str, head: str = "", tail: str = "", between: str = "\n") -> None:
    """Write the only column of rows, in their order, as one file; a file that is there is replaced."""
    rows.sparkSession.dataSource.register(JoinedText)
    rows.write.format("joined_text").mode("append").option("path", path).option("head", head).option("tail", tail).option("between", between).save()
