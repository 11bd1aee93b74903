"""Numpy files as the data source `npy`.

    spark.dataSource.register(arrays.NumpyFiles)
    spark.read.format("npy").load("/features/*.npy")

A row is one item of an array's first axis: (file, member, row, value); value is a number for arrays of one axis, and an array of
numbers, the other axes flattened in C order, for more. Of .npy files tasks read ranges of rows at their
offset; a member of an .npz archive is one task's, which passes it through the decompressor.

Options: `path` or `paths`, and `splitBytes`. The first file (of .npz its first member) gives the type of value, and all others
must have it, whatever their lengths. Refused with an error: pickled objects, texts, complex and unsigned 64-bit
numbers, arrays without an axis, Fortran order of more than one axis, headers that don't parse, and files shorter than
their header says. An empty array gives no rows.
"""

from __future__ import annotations

import ast
import math
import weakref
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Spark's type of each kind and size of numpy's numbers (fixed values).
KINDS = {
    "b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint",
    "f2": "float", "f4": "float", "f8": "double",
}
ARROW = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass(frozen=True)
class Header:
    """What the beginning of an .npy file says: the type of its items, the shape, and where the data begin."""

    dtype: np.dtype
    shape: tuple[int, ...]
    begins: int

    @property
    def kind(self) -> str:
        return KINDS[f"{self.dtype.kind}{self.dtype.itemsize}"]

    @property
    def row_items(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.row_items * self.dtype.itemsize

    @property
    def value(self) -> str:
        return self.kind if len(self.shape) == 1 else f"array<{self.kind}>"


def header_of(file: IO[bytes], name: str) -> Header:
    begin = file.read(8)
    if len(begin) < 8 or begin[:6] != b"\x93NUMPY" or begin[6] not in (1, 2, 3):
        raise ValueError(f"{name} is no .npy file")
    wide = 2 if begin[6] == 1 else 4
    size = int.from_bytes(file.read(wide), "little")
    text = file.read(size)
    if len(text) < size:
        raise ValueError(f"{name} ends within its header")
    try:
        said = ast.literal_eval(text.decode("latin1" if begin[6] < 3 else "utf-8").strip())
        descr, fortran, shape = said["descr"], said["fortran_order"], tuple(said["shape"])
        dtype = np.dtype(descr)
    except (ValueError, SyntaxError, KeyError, TypeError) as error:
        raise ValueError(f"{name} has a header that doesn't parse") from error
    if dtype.hasobject:
        raise ValueError(f"{name} holds pickled objects, which aren't read")
    if f"{dtype.kind}{dtype.itemsize}" not in KINDS:
        raise ValueError(f"{name} holds items of type {dtype}, which isn't read")
    if not shape or not all(isinstance(n, int) and n >= 0 for n in shape):
        raise ValueError(f"{name} has the shape {shape}, which has no rows")
    if fortran and len(shape) > 1:
        raise ValueError(f"{name} is in Fortran order, so its rows don't lie together")
    return Header(dtype, shape, 8 + wide + size)


@dataclass
class Rows(InputPartition):
    """Rows of one array: of an .npy file, or of a member of an .npz archive."""

    path: str
    member: str | None
    first: int
    last: int


class NumpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], value: str) -> None:
        self.options, self.value = options, value

    def partitions(self) -> list[Rows]:
        split, out = int(self.options.get("splitbytes", SPLIT_BYTES)), []
        for path, size, member, header in arrays_of(self.options):
            check(header, path, member, self.value)
            n = header.shape[0]
            if member is None:
                if size < header.begins + n * header.row_bytes:
                    raise ValueError(f"{path} has {size} bytes; its header says {header.begins + n * header.row_bytes}")
                step = max(1, split // max(header.row_bytes, 1))
                out += [Rows(path, None, a, min(a + step, n)) for a in range(0, n, step)]
            elif n:
                out.append(Rows(path, member, 0, n))
        return out or [Rows("", None, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        files, place = store.opened(partition.path)
        with files.open_input_file(place) as raw:
            if partition.member is None:
                header = header_of(raw, partition.path)
                raw.seek(header.begins + partition.first * header.row_bytes)
                yield from self.batches(raw, header, partition)
            else:
                with zipfile.ZipFile(raw) as archive, archive.open(partition.member) as member:
                    yield from self.batches(member, header_of(member, partition.member), partition)

    def batches(self, file: IO[bytes], header: Header, rows: Rows) -> Iterator[pa.RecordBatch]:
        kind, most = ARROW[header.kind], max(1, BATCH_BYTES // max(header.row_bytes, 1))
        for at in range(rows.first, rows.last, most):
            n = min(most, rows.last - at)
            data = file.read(n * header.row_bytes)
            if len(data) < n * header.row_bytes:
                raise ValueError(f"{rows.path} {rows.member or ''} ends before row {at + n} of {header.shape[0]}")
            flat = pa.array(np.frombuffer(data, header.dtype).astype(kind.to_pandas_dtype()), kind)
            value = flat if len(header.shape) == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * header.row_items), flat)
            name = rows.path.rsplit("/", 1)[-1]
            yield pa.record_batch({"file": pa.array([name] * n), "member": pa.array([rows.member] * n, pa.string()), "row": pa.array(np.arange(at, at + n)), "value": value})


def arrays_of(options: dict[str, str]) -> Iterator[tuple[str, int, str | None, Header]]:
    """(path, bytes, member, header) of every array; only directories and headers are read."""
    for path, size in store.listed(store.paths_of(options)):
        files, place = store.opened(path)
        with files.open_input_file(place) as raw:
            if path.endswith(".npz"):
                with zipfile.ZipFile(raw) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as member:
                            yield path, size, name, header_of(member, f"{path}:{name}")
            else:
                yield path, size, None, header_of(raw, path)


def check(header: Header, path: str, member: str | None, value: str) -> None:
    if header.value != value:
        raise ValueError(f"{path}{':' + member if member else ''} holds {header.value}, and the first array {value}")


class NumpyFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        first = next(arrays_of(self._options()), None)
        if first is None:
            raise ValueError("no arrays were found")
        return f"file string, member string, row bigint, value {first[3].value}"

    def reader(self, schema: Any) -> NumpyReader:
        return NumpyReader(self._options(), schema["value"].dataType.simpleString())


_known: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def register(spark: SparkSession) -> None:
    """Make the source known to a session, once."""
    if spark not in _known:
        spark.dataSource.register(NumpyFiles)
        _known.add(spark)
