"""Lines of files that grow, each given once: a Python data source that reads byte ranges.

The offset of a batch is the length of each file as it was when the batch was planned, which Spark writes to the
checkpoint before the batch runs. A batch's work is therefore fixed: the bytes between two recorded lengths, however far a
file has grown meanwhile, and the same bytes again if the batch is repeated. Files are dealt out as ranges of limited size,
so one large file is read by many tasks, and only what is new is read.

A line belongs to the range that holds its line end. So ranges may be cut anywhere, a last line without its end waits for
the batch that brings the end, and no line is given twice. A file that is now shorter than its recorded length was written
anew and is read from its start; one that is gone gives nothing and is forgotten.

Paths are anything that Arrow's file systems open (local folders, hdfs, s3, gs). The driver holds one length for each file
(about a hundred bytes). Bytes that are no UTF-8 are replaced, blank lines are left out, a carriage return before the line
end belongs to the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.session import ship

NAME = "growing_lines"
SCHEMA = "file string, ends long, line string"
#: Bytes of a range, of a read, and rows of a batch that a task hands on.
RANGE, READ, ROWS = 64 << 20, 1 << 20, 10_000


class Range(InputPartition):
    """The lines of a file whose ends lie in [begin, end)."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def lengths(path: str, suffix: str) -> dict[str, int]:
    """The files below a folder with their lengths. Names that begin with a dot or an underscore are not data."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(suffix) and not PurePosixPath(f.path).name.startswith((".", "_"))}


def ranges(since: dict[str, int], until: dict[str, int], size: int = RANGE) -> list[Range]:
    """What files have gained, in ranges of at most `size` bytes."""
    out = []
    for file, end in until.items():
        begin = since.get(file, 0)
        begin = 0 if end < begin else begin
        out += [Range(file, a, min(a + size, end)) for a in range(begin, end, size)]
    return out


def line_start(f, at: int) -> int:
    """Where the line begins that the byte at `at` belongs to, looked for backwards."""
    while at > 0:
        begin = max(at - READ, 0)
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def range_lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place after the line end, line) of the lines that end in a range."""
    system, _ = file_system(path)
    with system.open_input_file(part.file) as f:
        place = line_start(f, part.begin)
        f.seek(place)
        held: list[bytes] = []
        at = place
        while at < part.end:
            block = f.read(min(READ, part.end - at))
            if not block:
                return  # the file has been cut off since
            at += len(block)
            first, *rest = block.split(b"\n")
            held.append(first)
            for more in rest:
                line = b"".join(held)
                place += len(line) + 1
                yield place, line.removesuffix(b"\r")
                held = [more]


def _read(path: str, part: Range | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # how Spark reads a source without partitions
        return

    def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part.file] * len(rows), pa.string()), pa.array([e for e, _ in rows], pa.int64()), pa.array([b.decode("utf-8", "replace") for _, b in rows], pa.string())],
            ["file", "ends", "line"],
        )

    rows = []
    for end, line in range_lines(path, part):
        if line.strip():
            rows.append((end, line))
        if len(rows) == ROWS:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


class _Batch(DataSourceReader):
    """All lines beyond the lengths of option `since` (JSON: file to length)."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ".jsonl"), int(options.get("range", RANGE))
        self.since = json.loads(options.get("since", "{}"))

    def partitions(self) -> list[Range]:
        return ranges(self.since, lengths(self.path, self.suffix), self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ".jsonl"), int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return lengths(self.path, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class GrowingLines(DataSource):
    """Options: path, suffix (.jsonl), range (bytes of a task), since (batch only)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def registered(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(GrowingLines)
    return spark


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, ends (place after the line), line: what files gain, batch by batch."""
    return registered(spark).readStream.format(NAME).options(**options).load(path)


def tail(spark: SparkSession, path: str, since: dict[str, int] | None = None, **options: str) -> DataFrame:
    """The same once, beyond known lengths."""
    return registered(spark).read.format(NAME).options(since=json.dumps(since or {}), **options).load(path)
