"""Archives as data sources: `zipped_lines` and `tar_members`.

A partition is a byte range of an archive, or several small archives; the planner lists sizes and opens
nothing. Of a zip a task reads the directory at its end and takes the members whose header lies in its range; of a
tar it goes from header to header, skipping over the contents, and takes those that lie in its range.
Compressed tars have no such headers and are read whole by the task of the first range. Members pass through
the decompressor a line or a member at a time, so an archive may be larger than a task's memory; a line and a tar's
member must fit.

    spark.dataSource.register(archives.ZippedLines)
    spark.read.format("zipped_lines").load("/shards/docs_shard_*.jsonl.zip")

Options: `path` or `paths` (a JSON list; patterns in the last part, folders and files); `member` of zips (a pattern
of names; without it the member that bears the archive's name less .zip); `splitBytes`, the bytes of a partition.

What can't be read gives a row with its error and no value, after the rows before it: one an archive, or one a
member of a zip. Select on value for the data, count errors for the log. An empty folder gives no rows.
"""

from __future__ import annotations

import fnmatch
import lzma
import tarfile
import weakref
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store

SPLIT_BYTES = 128 << 20
#: What opening an archive counts as, when small ones share a partition.
OPEN_BYTES = 4 << 20
#: Payload and rows of one Arrow batch (one row may exceed it).
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
#: A value of a DataFrame can't be larger.
LARGEST_VALUE = (1 << 31) - 1024

BROKEN = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, EOFError, OSError, KeyError, NotImplementedError, RuntimeError, ValueError)


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) of the archives that a task reads."""

    parts: list[tuple[str, int, int]]


def ranges(files: list[tuple[str, int]], split: int) -> list[Ranges]:
    """Large archives in ranges of `split` bytes, small ones together up to that."""
    out, held, size = [], [], 0
    for path, n in files:
        if n > split:
            cuts = [*range(0, n, split), n]
            out += [Ranges([(path, a, b)]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            continue
        if held and size + max(n, 0) + OPEN_BYTES > split:
            out.append(Ranges(held))
            held, size = [], 0
        held.append((path, 0, max(n, 1)))
        size += max(n, 0) + OPEN_BYTES
    return [*out, Ranges(held)] if held else out


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        more = sum(len(v) for v in row if isinstance(v, bytes | str))
        if held and (size + more > BATCH_BYTES or len(held) >= BATCH_ROWS):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


class _Reader(DataSourceReader):
    """Plans byte ranges; subclasses give the rows of one range."""

    schema: pa.Schema

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = store.paths_of(options)
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.member = options.get("member")
        if self.split < 1:
            raise ValueError("splitBytes must be positive")

    def partitions(self) -> list[Ranges]:
        return ranges(store.listed(self.paths), self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from batched((r for part in partition.parts for r in self.rows(*part)), self.schema)

    def rows(self, path: str, start: int, end: int) -> Iterator[tuple]:
        raise NotImplementedError


class ZipReader(_Reader):
    schema = pa.schema([("shard", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("value", pa.string()), ("error", pa.string())])

    def rows(self, path: str, start: int, end: int) -> Iterator[tuple]:
        shard = path.rsplit("/", 1)[-1].removesuffix(".zip")
        try:
            files, place = store.opened(path)
            with files.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
                wanted = [m for m in archive.infolist() if not m.is_dir() and (fnmatch.fnmatchcase(m.filename, self.member) if self.member else m.filename == shard)]
                if not wanted and not self.member:
                    raise KeyError(f"There is no item named {shard!r} in the archive")
                for info in wanted:
                    if start <= info.header_offset < end:
                        yield from self.lines(archive, info, shard)
        except BROKEN as error:
            if start == 0:  # each range of an archive that can't be opened finds that out; one says so
                yield shard, None, -1, None, said(error)

    @staticmethod
    def lines(archive: zipfile.ZipFile, info: zipfile.ZipInfo, shard: str) -> Iterator[tuple]:
        try:
            with archive.open(info) as lines:
                for i, line in enumerate(lines):
                    yield shard, info.filename, i, line.decode("utf-8", "replace").rstrip("\r\n"), None
        except BROKEN as error:
            yield shard, info.filename, -1, None, said(error)


class TarReader(_Reader):
    schema = pa.schema([("shard", pa.string()), ("place", pa.int64()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def rows(self, path: str, start: int, end: int) -> Iterator[tuple]:
        shard, place = path.rsplit("/", 1)[-1], 0
        try:
            files, inside = store.opened(path)
            with files.open_input_file(inside) as raw:
                try:
                    archive, plain = tarfile.open(fileobj=raw, mode="r:"), True
                except tarfile.ReadError:
                    if start:
                        return
                    raw.seek(0)
                    archive, plain = tarfile.open(fileobj=raw, mode="r|*"), False
                with archive:
                    while (info := archive.next()) is not None:
                        archive.members.clear()  # it would hold every header
                        if plain and info.offset >= end:
                            return
                        if not info.isfile():
                            continue
                        if not plain or info.offset >= start:
                            yield self.member_row(archive, info, shard, place)
                        place += 1
        except BROKEN as error:
            # a broken header ends every range behind it, so the range that would begin there says so
            if start == 0 or place:
                yield shard, place, None, None, said(error)

    def member_row(self, archive: tarfile.TarFile, info: tarfile.TarInfo, shard: str, place: int) -> tuple:
        if self.member and not fnmatch.fnmatchcase(info.name, self.member):
            return shard, place, info.name, None, None
        if info.size > LARGEST_VALUE:
            return shard, place, info.name, None, f"ValueError: {info.size} bytes are more than a value holds"
        return shard, place, info.name, archive.extractfile(info).read(), None


class ZippedLines(DataSource):
    """(shard, member, line_no, value, error) of zipped line files."""

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "shard string, member string, line_no bigint, value string, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader({k.lower(): v for k, v in self.options.items()})


class TarMembers(DataSource):
    """(shard, place, name, content, error) of the regular files of tar archives; with `member` the content of others is null."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "shard string, place bigint, name string, content binary, error string"

    def reader(self, schema) -> TarReader:
        return TarReader({k.lower(): v for k, v in self.options.items()})


_known: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> None:
    """Make both known to a session, once."""
    if spark not in _known:
        for source in (ZippedLines, TarMembers):
            spark.dataSource.register(source)
        _known.add(spark)
