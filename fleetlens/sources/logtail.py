"""Logs that grow, followed as a stream: each line once, however often the stream is stopped and started.

The built-in file source takes a file once, when it is new. This source remembers how far each
file has been read. Files are opened through Arrow, by any path or address it knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "log string, position long, line string"
CHUNK = 1 << 20


def _opened(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def log_files(path: str) -> dict[str, int]:
    """Files of a folder (or the file itself) with their sizes."""
    from pyarrow import fs

    files, where = _opened(path)
    info = files.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def whole_lines(path: str, log: str, start: int, size: int) -> int:
    """Where the last whole line of a file ends, looking back from its end; ``start`` if there is none."""
    files, _ = _opened(path)
    with files.open_input_file(log) as f:
        end = size
        while end > start:
            begin = max(start, end - CHUNK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


@dataclass
class Part(InputPartition):
    log: str
    start: int
    end: int


def read_part(path: str, part: Part) -> Iterator[tuple[str, int, str]]:
    """log, first byte and text of the lines between two offsets, a bounded number of bytes at a time."""
    files, _ = _opened(path)
    with files.open_input_file(part.log) as f:
        at, held = part.start, b""
        while at < part.end:
            more = f.read_at(min(CHUNK, part.end - at), at)
            if not more:
                break
            begin = at - len(held)
            at += len(more)
            *lines, held = (held + more).split(b"\n")
            for line in lines:
                yield part.log, begin, line.removesuffix(b"\r").decode("utf-8", "replace")
                begin += len(line) + 1
        if held:
            yield part.log, at - len(held), held.removesuffix(b"\r").decode("utf-8", "replace")


class LogStreamReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file. A file that has become smaller is a new one and begins anew."""

    def __init__(self, path: str):
        self.path = path
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for log, size in log_files(self.path).items():
            start = self.seen.get(log, 0)
            out[log] = whole_lines(self.path, log, start if start <= size else 0, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = dict(end)
        ranges = ((log, start.get(log, 0), upto) for log, upto in end.items())
        return [Part(log, since if since <= upto else 0, upto) for log, since, upto in ranges if since != upto]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return read_part(self.path, partition)

    def commit(self, end: dict) -> None:
        self.seen = dict(end)


class LogReader(DataSourceReader):
    """All lines of all files, the last one even without a line end."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Part(log, 0, size) for log, size in log_files(self.path).items() if size]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        return read_part(self.path, partition)


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``, or ``spark.read`` for what is there now."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
