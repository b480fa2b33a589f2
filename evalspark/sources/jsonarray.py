"""One JSON array document, read by many tasks.

A merged generations file is one array of records, with no line structure to
split at.  The reader cuts the file into byte ranges and needs to know, where a
range begins, whether that is inside a string and how deep.  Two passes:

1. every range is scanned for both hypotheses (its first byte is inside a
   string, or outside) and leaves three numbers: the parity of its quotes and
   the change of depth under either hypothesis.  Whether the first byte is
   escaped is told by the backslashes before it.
2. the numbers are summed up in file order, so the state at every border is
   known, and each range is scanned again from its state: the records that
   begin in it are parsed, the last one beyond the range's end.

Both passes are a Python data source (``evalspark_json_array``) with one
partition per range; only the three numbers of each range pass the driver.
Files are opened by ``pyarrow.fs``: plain paths (a shared folder on a cluster)
and the URIs that it knows.  A file that is no array, or a record that does not
fit the declared schema, fails the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "evalspark_json_array"
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20          # taken from the file at a time
BATCH_BYTES = 4 << 20         # of records in one Arrow batch

_TOKENS = re.compile(rb'\\.|["\[\]{}]', re.DOTALL)
_SUMMARY = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("flips", T.BooleanType()),
                         T.StructField("outside", T.LongType()), T.StructField("inside", T.LongType())])


def filesystem(path: str):
    """A file system of ``pyarrow.fs`` and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the documents at a file or folder, hidden ones left out."""
    from pyarrow import fs
    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, in_string: bool = False, depth: int = 0):
        self.file, self.start, self.end, self.in_string, self.depth = file, start, end, in_string, depth


def _is_escaped(stream, start: int) -> bool:
    """Whether an odd number of backslashes stands right before ``start``."""
    n, at = 0, start
    while at > 0:
        step = min(at, 4096)
        stream.seek(at - step)
        piece = stream.read(step)
        run = len(piece) - len(piece.rstrip(b"\\"))
        n, at = n + run, at - step
        if run < step:
            break
    return n % 2 == 1


def _tokens(stream, start: int) -> Iterator[tuple[int, bytes]]:
    """Place and sign of the quotes and brackets from ``start`` on that no backslash escapes."""
    at = start + 1 if _is_escaped(stream, start) else start
    stream.seek(at)
    rest = b""
    while piece := stream.read(READ_BYTES):
        data = rest + piece
        # A backslash at the end goes to the next piece, with the sign that it escapes.
        tail = 1 if (len(data) - len(data.rstrip(b"\\"))) % 2 else 0
        for m in _TOKENS.finditer(data, 0, len(data) - tail):
            if data[m.start()] != 0x5C:
                yield at + m.start(), m[0]
        at, rest = at + len(data) - tail, data[len(data) - tail:]


class _SummaryReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        return [Range(f, a, min(a + self.range_bytes, n)) for f, n in _files(self.path) for a in range(0, n, self.range_bytes)]

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        quotes, depth = 0, [0, 0]                        # by the parity of the quotes so far
        with system.open_input_file(part.file) as stream:
            for at, sign in _tokens(stream, part.start):
                if at >= part.end:
                    break
                if sign == b'"':
                    quotes ^= 1
                else:
                    depth[quotes] += 1 if sign in b"[{" else -1
        yield part.file, part.start, bool(quotes), depth[0], depth[1]


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, ranges: list[list]):
        self.path, self.schema, self.ranges = path, schema, ranges

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def _records(self, part: Range) -> Iterator[bytes]:
        """The records that begin in the range."""
        system, _ = filesystem(self.path)
        in_string, depth, begin = part.in_string, part.depth, None
        with system.open_input_file(part.file) as stream, system.open_input_file(part.file) as texts:
            for at, sign in _tokens(stream, part.start):
                if at >= part.end and begin is None:
                    return
                if sign == b'"':
                    in_string = not in_string
                elif in_string:
                    continue
                elif sign in b"[{":
                    if depth == 0 and sign != b"[":
                        raise ValueError(f"{part.file} is not a JSON array")
                    if depth == 1 and at < part.end:
                        if sign == b"[":
                            raise ValueError(f"{part.file}: an array where a record should be, at byte {at}")
                        begin = at
                    depth += 1
                else:
                    depth -= 1
                    if depth == 1 and begin is not None:
                        texts.seek(begin)
                        yield texts.read(at + 1 - begin)
                        begin = None

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema, rows, size = to_arrow_schema(self.schema), [], 0
        for text in self._records(part):
            rows.append(json.loads(text))
            size += len(text)
            if size >= BATCH_BYTES:
                yield from pa.Table.from_pylist(rows, schema).to_batches()
                rows, size = [], 0
        if rows:
            yield from pa.Table.from_pylist(rows, schema).to_batches()


class JsonArraySource(DataSource):
    """Options: ``path``; ``ranges`` (JSON) for the records, else the summaries in ranges of ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return _SUMMARY

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if "ranges" in self.options:
            return _RecordReader(self.options["path"], schema, json.loads(self.options["ranges"]))
        return _SummaryReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the array document(s) at ``path``, one partition per range of bytes."""
    spark.dataSource.register(JsonArraySource)
    sizes = dict(_files(path))
    rows = spark.read.format(NAME).option("path", path).option("range_bytes", str(range_bytes)).load().collect()
    ranges, state, last = [], (False, 0), None
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            _require_whole(last, state)
            state, last = (False, 0), r["file"]
        in_string, depth = state
        ranges.append([r["file"], r["start"], min(r["start"] + range_bytes, sizes[r["file"]]), in_string, depth])
        state = in_string ^ r["flips"], depth + (r["inside"] if in_string else r["outside"])
    _require_whole(last, state)
    return spark.read.format(NAME).schema(schema).option("path", path).option("ranges", json.dumps(ranges)).load()


def _require_whole(file: str | None, state: tuple[bool, int]) -> None:
    if file is not None and state != (False, 0):
        raise ValueError(f"{file} is not one whole JSON array")
