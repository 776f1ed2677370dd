"""Files that grow, as a stream: the offsets are the files' sizes, which Spark keeps in its checkpoint."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomline.sources import files

RANGE_BYTES = 64 << 20
_BACK = 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def line_start(uri: str, at: int) -> int:
    """Where the line begins that goes on, or begins, at a byte of a file."""
    fs, path = files.opened(uri)
    with fs.open_input_file(path) as f:
        while at > 0:
            low = max(at - _BACK, 0)
            found = f.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return 0


def ended_lines(uri: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines of a file, without their ends, whose ends lie in a range of it."""
    at, rest = line_start(uri, begin), []
    for part in files.read_from(uri, at):
        part = part[: max(end - at, 0)]
        at += len(part)
        *whole, last = part.split(b"\n")
        for piece in whole:
            yield b"".join([*rest, piece])
            rest = []
        rest.append(last)
        if at >= end:
            return


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, glob: str, step: int):
        self.root, self.glob, self.step = root, glob, step

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out, folders = {}, [self.root]
        while folders:
            for path, size in files.listed(folders.pop()):
                if size < 0:
                    folders.append(path)
                elif fnmatch.fnmatch(path.rpartition("/")[2], self.glob):
                    out[path] = size
        return dict(sorted(out.items()))

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, size in end.items():
            known = start.get(path, 0)
            low = known if known <= size else 0
            out += [_Range(path, at, min(at + self.step, size)) for at in range(low, size, self.step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        def batch(lines: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines), pa.string()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["path", "value"])

        held, size = [], 0
        for line in ended_lines(partition.path, partition.begin, partition.end):
            if line.strip():
                held.append(line)
                size += len(line)
            if size >= 1 << 22 or len(held) >= 1 << 14:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class Tail(DataSource):
    """Format ``loomline_tail``: options path, glob and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "loomline_tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("glob", "*"), int(self.options.get("range_bytes", RANGE_BYTES)))


def stream(spark: SparkSession, path: str, glob: str = "*.ndjson", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, value): JSON objects appended to the files of a folder, an object a line, as a stream.

    A line comes with the batch in which its end is seen, so one that is still
    being written waits; blank and malformed lines go.  A file that has shrunk
    is read anew, one that is gone is forgotten.  A restarted query goes on at
    the sizes in its checkpoint.  New bytes are read in ranges, each in a task;
    the driver lists names and sizes of the tailed files, and an offset holds
    them, so the folder is one of live files, which retention keeps small.
    """
    spark.dataSource.register(Tail)
    rows = spark.readStream.format("loomline_tail").option("path", path).option("glob", glob).option("range_bytes", range_bytes).load()
    return rows.where(F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull())
