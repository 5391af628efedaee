"""Logs that are still being written: lines of append-only files, read from where the last run stopped.

As a batch, every line comes with whether it is terminated; as a stream, a last
line that is torn is held back until its writer has finished it, and then comes
once. A line's place is its byte offset, so places rise within a file however it
is cut up among tasks. Files are reached through Arrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "src string, seq long, value string, terminated boolean"
_ARROW = pa.schema([("src", pa.string()), ("seq", pa.int64()), ("value", pa.string()), ("terminated", pa.bool_())])
#: Bytes of a file that one task reads, and of one read.
RANGE, BLOCK = 64 << 20, 1 << 20


@dataclass
class _Range(InputPartition):
    """The lines of a file that begin in start .. end."""

    name: str
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "/" + path)


def _sizes(path: str) -> dict[str, int]:
    store, where = _store(path)
    return {f.path: f.size for f in store.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


def _whole(path: str, name: str, start: int, size: int) -> int:
    """Where the last terminated line of a file ends, at least start."""
    store, _ = _store(path)
    with store.open_input_file(name) as f:
        end = size
        while end > start:
            at = max(start, end - BLOCK)
            f.seek(at)
            cut = f.read(end - at).rfind(b"\n")
            if cut >= 0:
                return at + cut + 1
            end = at
    return start


def _ranges(begun: dict[str, int], ends: dict[str, int]) -> list[_Range]:
    return [_Range(name, at, min(at + RANGE, end)) for name, end in sorted(ends.items()) for at in range(begun.get(name, 0), end, RANGE)]


def _lines(path: str, part: _Range) -> Iterator[pa.RecordBatch]:
    """A task goes on past its end to finish the line that began before it, and leaves out the line that began before its start."""
    store, _ = _store(path)
    with store.open_input_file(part.name) as f:
        at, rest = part.start, b""
        if at:
            f.seek(at - 1)
            at, skip = at - 1, True
        else:
            skip = False
        while True:
            block = f.read(BLOCK)
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop()
            seq, value = [], []
            for piece in pieces:
                if not skip and at < part.end:
                    seq.append(at)
                    value.append(piece.decode("utf-8", "replace"))
                skip = False
                at += len(piece) + 1
            last = not block or at >= part.end
            ended = [True] * len(seq)
            if not block and rest and not skip and at < part.end:
                seq.append(at)
                value.append(rest.decode("utf-8", "replace"))
                ended.append(False)
            if seq:
                yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(seq)), pa.array(seq, pa.int64()), pa.array(value), pa.array(ended)], schema=_ARROW)
            if last:
                return


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Range]:
        return _ranges({}, _sizes(self.path))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)


class _Stream(DataSourceStreamReader):
    """An offset says of each file how far it is read; Spark keeps it in the query's progress."""

    def __init__(self, path: str):
        self.path, self.read_to = path, {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        self.read_to = {name: _whole(self.path, name, min(self.read_to.get(name, 0), size), size) for name, size in _sizes(self.path).items()}
        return {"files": json.dumps(self.read_to, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return _ranges(json.loads(start["files"]), json.loads(end["files"]))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class AppendedLog(DataSource):
    """Format ``appended_log``: load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "appended_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """(src, seq, value, terminated) of every line of the files under a folder."""
    spark.dataSource.register(AppendedLog)
    return spark.read.format("appended_log").load(folder)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of terminated lines, each once."""
    spark.dataSource.register(AppendedLog)
    return spark.readStream.format("appended_log").load(folder)
