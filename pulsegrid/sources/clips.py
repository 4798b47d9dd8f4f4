"""A folder of audio files of which only those asked for are read, in the task that needs them.

``Folder`` keeps names and bytes apart: names are listed by Spark and joined with what is
asked for; bytes are read by the task that analyses them, one file at a time, so they are
never shuffled and a folder costs its listing, whatever it holds.  ``ClipSource`` is the
same folder as a Python data source, ``spark.read.format("clips").load(folder)``: files are
dealt into partitions by size, and conditions on ``path`` and ``length`` drop files before
any is opened (set spark.sql.python.filterPushdown.enabled).

Files are opened by Arrow's file systems (local, hdfs, s3, gs, abfs), by the scheme of
their path.  A file that is too large or can't be read is a row with a message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .. import constants as k

#: Bytes and files of a partition of the data source, about.
PART_BYTES, PART_FILES = 64 << 20, 256
TOO_LARGE = f"too large: %d bytes (limit {k.MAX_AUDIO_BYTES})"


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; what has no scheme, or ``file:``, is local."""
    local = re.match(r"(?:file:(?://(?=/))?)?(/.*)$", uri, re.S)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


def opened(path: str, limit: int = k.MAX_AUDIO_BYTES) -> tuple[bytes | None, str | None]:
    """(bytes, message) of a file, of which no more than ``limit`` + 1 bytes are read."""
    try:
        where, inside = located(path)
        with where.open_input_stream(inside) as stream:
            body = stream.read(limit + 1)
    except (OSError, ValueError, pa.ArrowException) as error:
        return None, f"reading {path}: {error}"
    return (None, TOO_LARGE % len(body)) if len(body) > limit else (body, None)


@dataclass(frozen=True)
class Folder:
    """Audio files below ``path``, a folder or pattern as Spark takes it; ``get`` reads one, given its path."""

    path: str
    get: Callable[[str], tuple[bytes | None, str | None]] = field(default=opened)

    def names(self, spark: SparkSession) -> DataFrame:
        """(path, length): no file is opened for these."""
        return spark.read.format("binaryFile").load(self.path).select("path", "length")


@dataclass(frozen=True)
class Clips(InputPartition):
    """Files that one task reads: (path, length) each."""

    files: tuple[tuple[str, int], ...]


TESTS: dict[type, Callable] = {
    EqualTo: lambda has, value: has == value,
    In: lambda has, value: has in value,
    StringStartsWith: lambda has, value: has.startswith(value),
    GreaterThan: lambda has, value: has > value,
    GreaterThanOrEqual: lambda has, value: has >= value,
    LessThan: lambda has, value: has < value,
    LessThanOrEqual: lambda has, value: has <= value,
    IsNotNull: lambda has, _: True,
}


class ClipReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what concerns paths and lengths; the rest is Spark's."""
        for one in filters:
            column = getattr(one, "attribute", ())
            if type(one) in TESTS and column in (("path",), ("length",)):
                self.wanted.append((column[0], TESTS[type(one)], getattr(one, "value", None)))
            else:
                yield one

    def listed(self) -> list[tuple[str, int]]:
        where, inside = located(self.folder)
        prefix = self.folder[: len(self.folder) - len(inside)] if self.folder.endswith(inside) else ""
        found = where.get_file_info(fs.FileSelector(inside, recursive=True))
        named = [({"path": prefix + f.path, "length": f.size}) for f in found if f.is_file and not f.base_name.startswith((".", "_"))]
        return sorted((f["path"], f["length"]) for f in named if all(test(f[column], value) for column, test, value in self.wanted))

    def partitions(self) -> list[InputPartition]:
        parts, own, size = [], [], 0
        for path, length in self.listed():
            if own and (size + length > PART_BYTES or len(own) == PART_FILES):
                parts.append(Clips(tuple(own)))
                own, size = [], 0
            own.append((path, length))
            size += min(length, k.MAX_AUDIO_BYTES)
        return [*parts, Clips(tuple(own))]

    def read(self, partition: Clips) -> Iterator[pa.RecordBatch]:
        for path, length in partition.files:
            body, message = opened(path) if length <= k.MAX_AUDIO_BYTES else (None, TOO_LARGE % length)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([body], pa.binary()), pa.array([message], pa.string())], ["path", "length", "content", "message"])


class ClipSource(DataSource):
    """(path, length, content, message) of the files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return "path string, length bigint, content binary, message string"

    def reader(self, schema) -> DataSourceReader:
        return ClipReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSource)
