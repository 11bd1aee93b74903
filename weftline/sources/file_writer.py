"""Named files and a table of them from one job, as the data sink `named_files` (K6, K7).

    spark.dataSource.register(file_writer.NamedFiles)
    df.write.format("named_files").mode("append").option("nameColumn", "name").option("contentColumn", "content").save("/results/images")

Each row is one file, `files/<name>` below the path; the other columns, with the name, are the rows of `table/`,
Parquet. Tasks write to folders of their own attempt below a staging folder; the driver moves what
the attempts that Spark committed have written, looks for names that occur twice, and renames the staging folder to the
path, once. So a reader sees all files and rows or none: a task that is killed and runs again leaves its first
folder behind in the staging folder, which goes in the end, on success and on failure.

Mode append writes to a path that isn't there yet, mode overwrite replaces one. A null or empty name, one that leaves the
folder, or one that occurs twice fails the job; null content is an empty file; an empty table gives an empty
folder and a table without rows.
"""

from __future__ import annotations

import contextlib
import posixpath
import uuid
import weakref
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import store

#: Moves that the driver has under way at once.
MOVES = 32
#: How often the driver tries to remove what a failed job has written.
GIVE_UP = 100


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's attempt."""

    folder: str


def safe_name(name: str | None) -> str:
    """The name, if it is a relative path that stays below its folder."""
    plain = posixpath.normpath(name) if name else ""
    if not plain or plain != name or plain.startswith(("/", "..")) or plain == ".":
        raise ValueError(f"not a file name: {name!r}")
    return plain


class FileWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        if "path" not in options:
            raise ValueError("no path was given")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.name, self.content = options.get("namecolumn", "name"), options.get("contentcolumn", "content")
        for column in (self.name, self.content):
            if column not in schema.fieldNames():
                raise ValueError(f"no column {column!r} in {schema.simpleString()}")
        self.rows = to_arrow_schema(StructType([f for f in schema.fields if f.name != self.content]))
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"
        files, place = store.opened(self.path)
        if not overwrite and files.get_file_info(place).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} is there already; use mode overwrite")
        files.create_dir(store.opened(self.staging)[1])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        files, place = store.opened(folder)
        for part in (place, f"{place}/files"):
            files.create_dir(part, recursive=False)  # fails where the job was given up and its folder is gone
        made, table = set(), None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(self.name), batch.column(self.content), strict=True):
                    name = safe_name(name.as_py())
                    if name in made:
                        raise ValueError(f"two files are named {name!r}")
                    made.add(name)
                    for k, c in enumerate(name):
                        if c == "/":
                            files.create_dir(f"{place}/files/{name[:k]}", recursive=False)
                    with files.open_output_stream(f"{place}/files/{name}") as out:
                        out.write(content.as_py() or b"")
                rows = pa.table([batch.column(c) for c in self.rows.names], names=self.rows.names).cast(self.rows)
                table = table or pq.ParquetWriter(f"{place}/part.parquet", self.rows, filesystem=files)
                table.write_table(rows)
        finally:
            if table:
                table.close()
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        files, staging = store.opened(self.staging)
        out = f"{staging}/out"
        files.create_dir(f"{out}/files")
        files.create_dir(f"{out}/table")
        moves, seen = [], set()
        for k, message in enumerate(m for m in messages if m):
            _, place = store.opened(message.folder)
            for info in files.get_file_info(fs.FileSelector(f"{place}/files", recursive=True)):
                if info.is_file:
                    name = info.path[info.path.index(f"{place}/files/") + len(place) + 7 :]
                    if name in seen:
                        raise ValueError(f"two files are named {name!r}")
                    seen.add(name)
                    moves.append((info.path, f"{out}/files/{name}"))
            if files.get_file_info(f"{place}/part.parquet").is_file:
                moves.append((f"{place}/part.parquet", f"{out}/table/part-{k:05d}.parquet"))
        if not any(to.endswith(".parquet") and "/table/" in to for _, to in moves):
            pq.write_table(self.rows.empty_table(), f"{out}/table/part-00000.parquet", filesystem=files)
        for folder in sorted({to.rpartition("/")[0] for _, to in moves}):
            files.create_dir(folder)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: files.move(*m), moves))
        _, place = store.opened(self.path)
        if self.overwrite and files.get_file_info(place).type != fs.FileType.NotFound:
            files.move(place, f"{staging}/old")
        files.move(out, place)
        files.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        files, place = store.opened(self.staging)
        for _ in range(GIVE_UP):
            if files.get_file_info(place).type != fs.FileType.Directory:
                return
            with contextlib.suppress(OSError):  # a task that still runs may add a file meanwhile
                files.delete_dir(place)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(schema, {k.lower(): v for k, v in self.options.items()}, overwrite)


_known: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> None:
    """Make the sink known to a session, once."""
    if spark not in _known:
        spark.dataSource.register(NamedFiles)
        _known.add(spark)
