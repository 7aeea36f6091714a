"""Identifiers in large binary files: a data source that reads byte ranges, so that one file is many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; a range and its text are what a task holds.
RANGE_BYTES = 16 << 20
#: An identifier, and the most characters that it has.
IDENTIFIER, LONGEST = r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 10
_WIDTHS = {"utf-16le": 2, "utf-16be": 2, "utf-32le": 4, "utf-32be": 4}
_FIELDS = ["path", "start", "id"]


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def ids_in_range(data: bytes, first: int, start: int, stop: int, charset: str, pattern: re.Pattern) -> list[tuple[int, str]]:
    """(place in bytes, id) of the matches that begin in start..stop; data are the file's bytes from `first` on, with what stands around the range."""
    width, out, at, last = _WIDTHS.get(charset, 0), [], first, 0
    # Bytes that are no characters stay in the text, so that places can be counted.
    errors = {0: "surrogateescape", 2: "surrogatepass", 4: "replace"}[width]
    text = data[: len(data) // width * width if width else None].decode(charset, errors=errors)
    encode = lambda s: 4 * len(s) if width == 4 else len(s.encode(charset, errors=errors))
    for m in pattern.finditer(text):
        at, last = at + encode(text[last : m.start()]), m.start()
        if start <= at < stop:
            out.append((at, m[1]))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.charset = options["path"], options.get("charset", "utf-16le").lower()
        width = _WIDTHS.get(self.charset, 1)
        self.step = max(int(options.get("rangebytes", RANGE_BYTES)) // width, 1) * width
        self.pattern, self.longest = options.get("pattern", IDENTIFIER), int(options.get("longest", LONGEST))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, inner = _opened(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(at + self.step, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.step)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.stop == part.start:
            return
        system, _ = _opened(self.path)
        # One character before the range and an identifier and one character behind it decide about its ends; a character of UTF-8 has up to four bytes.
        width = _WIDTHS.get(self.charset, 4)
        first = max(part.start - width, 0)
        with system.open_input_file(part.path) as f:
            data = f.read_at(min(part.stop + (self.longest + 1) * width, part.size) - first, first)
        if self.charset not in _WIDTHS:
            # The text begins with a whole character.
            skip = next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), 0) if self.charset.startswith("utf-8") else 0
            data, first = data[skip:], first + skip
        found = ids_in_range(data, first, part.start, part.stop, self.charset, re.compile(self.pattern))
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([i for _, i in found], pa.string())], _FIELDS)


class IdentifierSource(DataSource):
    """Options: path (a file or folder that pyarrow's file systems reach), charset, rangeBytes, pattern, longest."""

    @classmethod
    def name(cls) -> str:
        return "identifiers"

    def schema(self) -> str:
        return "path string, start bigint, id string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan_ranges(spark: SparkSession, path: str, charset: str = "UTF-16LE", range_bytes: int = RANGE_BYTES, pattern: str = IDENTIFIER, longest: int = LONGEST) -> DataFrame:
    """(path, start, id): each identifier in binary files, with the byte where it begins.

    A file is cut into ranges of whole characters; an identifier across a cut belongs to
    the range in which it begins, so that each is found once. The pattern's first group is
    the identifier; no match has more than `longest` characters. Bytes that are no
    characters match nothing. Files without identifiers, and empty ones, give no rows.
    """
    spark.dataSource.register(IdentifierSource)
    reader = spark.read.format("identifiers").option("path", path).option("charset", charset).option("rangeBytes", str(range_bytes))
    return reader.option("pattern", pattern).option("longest", str(longest)).load()
