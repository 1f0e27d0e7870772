"""A tolerant source of JSON lines: every line of every file, with what is wrong with it.

`spark.read.format("json_lines")` after `register(spark)`, or `scan`. Files are cut into byte ranges; a line belongs to the
range that holds its first byte, so ranges need not end with lines. A range is a task where there are few; small ones
share tasks where there are many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.json_tape import report_lines
from ..operators.ordered import positions
from .shared import Scratch

SCHEMA = "file string, first long, line string, issue string, fault string, at long"
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
AHEAD_BYTES = 4096  # first read beyond a range, for the end of its last line
BATCH_LINES = 4096
TASK_BYTES = 4 << 20  # of small ranges that share a task
TASKS = 64  # that small ranges are dealt to before they share one


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it: local for plain paths and file:, else what pyarrow makes of the URI."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return pyarrow.fs.FileSystem.from_uri(path)


class Ranges(InputPartition):
    """(file, start, stop) of the ranges of a task."""

    def __init__(self, ranges: Sequence[tuple[str, int, int]]):
        self.ranges = ranges


class JsonLines(DataSource):
    """Options: path, of a file or a folder whose names beginning with `_` or `.` are left out; rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, max(1, range_bytes)

    def partitions(self) -> Sequence[Ranges]:
        store, at = store_of(self.path)
        info = store.get_file_info(at)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if x.is_file and not any(p.startswith(("_", ".")) for p in x.path[len(at) :].split("/"))]
        ranges = [(x.path, a, min(a + self.range_bytes, x.size)) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.range_bytes)]
        return [Ranges(x) for x in _dealt(ranges)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for file, ranges in groupby(partition.ranges, key=lambda x: x[0]):
            firsts: list[int] = []
            lines: list[bytes] = []
            size = 0
            store, _ = store_of(self.path)
            with store.open_input_file(file) as f:
                for _, start, stop in ranges:
                    for first, line in ranged_lines(f, start, stop):
                        firsts.append(first)
                        lines.append(line)
                        size += len(line)
                        if len(lines) >= BATCH_LINES or size >= READ_BYTES:
                            yield _batch(file, firsts, lines)
                            firsts, lines, size = [], [], 0
            if lines:
                yield _batch(file, firsts, lines)


def _dealt(ranges: Sequence[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """The ranges of each task, in order: up to TASK_BYTES, less where that would leave fewer than TASKS tasks."""
    room = min(TASK_BYTES, sum(b - a for _, a, b in ranges) // TASKS)
    out: list[list[tuple[str, int, int]]] = []
    held = room
    for x in ranges:
        size = x[2] - x[1]
        if not out or held + size > room:
            out.append([])
            held = 0
        out[-1].append(x)
        held += size
    return out


def ranged_lines(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line without its end) of lines that begin at or after `start` and before `stop`."""
    at = max(0, start - 1)
    f.seek(at)
    rest: list[bytes] = []  # of the line that has begun
    first, inside = start, start == 0
    ahead = AHEAD_BYTES
    while data := f.read(min(READ_BYTES, stop - at if at < stop else ahead)):
        ahead = ahead if at < stop else 2 * ahead
        *whole, part = data.split(b"\n")
        for line in whole:
            end = at + len(line) + 1
            if rest:
                line, rest = b"".join([*rest, line]), []
            if inside:
                yield first, line.removesuffix(b"\r")
            first, inside, at = end, True, end
            if first >= stop:
                return
        rest.append(part)
        at += len(part)
        if not inside and at >= stop:
            return  # no line begins here
    if inside and b"".join(rest):
        yield first, b"".join(rest).removesuffix(b"\r")


def _batch(file: str, firsts: list[int], lines: list[bytes]) -> pa.RecordBatch:
    """Lines that are no UTF-8 have the issue ENCODING, and are shown with replacement characters."""
    raw, broken = pa.array(lines, pa.binary()), []
    try:
        text = raw.cast(pa.string())
    except pa.ArrowInvalid:
        shown = [x.decode("utf-8", "replace") for x in lines]
        broken = [i for i, x in enumerate(lines) if shown[i].encode() != x]
        text = pa.array(shown, pa.string())
    found = report_lines(text)
    issue, fault, at = (found.field(i) for i in range(3))
    if broken:
        mask = np.zeros(len(lines), bool)
        mask[broken] = True
        issue, fault, at = (pc.if_else(pa.array(mask), pa.scalar(v, x.type), x) for v, x in (("ENCODING", issue), ("ENCODING", fault), (None, at)))
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(firsts, pa.int64()), text, issue, fault, at], names=["file", "first", "line", "issue", "fault", "at"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)


def scan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, first, line, issue, fault, at) of every line: records have a null issue, so lines are records and issues.
    first is the line's byte in its file; issues and faults as in `json_tape.report`, and ENCODING. The store must be
    one that pyarrow opens."""
    register(spark)
    return spark.read.format("json_lines").option("rangebytes", str(range_bytes)).load(path)


def numbered(lines: DataFrame) -> DataFrame:
    """Adds number: the line's place in its file, from 1. The lines are written first: sorting looks at its rows twice,
    and to judge a line costs more than to read it back."""
    lines = Scratch(lines.sparkSession, "lines").keep(lines, "lines")
    return positions(lines, ["file"], [F.col("first")], "number").withColumn("number", F.col("number") + 1)
