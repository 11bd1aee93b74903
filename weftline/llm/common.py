"""What the operators of this subpackage share: scratch tables, rows kept whole, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_dir

#: A word is a run of anything but these six ASCII characters (fixed by the contract).
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"

#: Bytes that one Arrow batch of results may hold before it is handed on.
BATCH_BYTES = 8 << 20


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


#: A key is hot if more than one in so many rows have it; so there are fewer hot keys than this.
HOT_SHARE = 1_000
#: Fewer rows than this are joined at once: one task can hold all of them.
HOT_LEAST = 50_000


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left joined with right, which has one row a key and in `weight` how many of left's `total` rows have it.

    The rows of hot keys stay where they are and meet right's row by a broadcast, of fewer than HOT_SHARE
    rows by construction; all others are shuffled by key. left is read twice, so it should be written. The
    rows are the same either way. Joins by shuffle are told to sort and merge: the planner would broadcast what
    is small, and operators with many rounds would fill the driver with such tables.
    """
    if total < HOT_LEAST:
        return left.hint("merge").join(right.drop(weight), keys)
    is_hot = F.col(weight) > max(total // HOT_SHARE, 1)
    rest = [c for c in right.columns if c not in (*keys, weight)]
    hot, cold = (right.where(x).select(*keys, *rest) for x in (is_hot, ~is_hot))
    without = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(without.hint("merge").join(cold, keys))


def row_struct(df: DataFrame) -> Column:
    """All columns of df as one struct, so that working columns can't clash with theirs."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def restored(df: DataFrame, columns: Iterable[str], struct: str = "_row") -> DataFrame:
    """The columns packed by row_struct, under their own names."""
    return df.select(*[F.col(f"{struct}.`{c}`").alias(c) for c in columns])


def bounded(rows: Iterable[tuple], schema: pa.Schema, sizes: Iterable[int] | None = None, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `most` payload bytes or 4,096 rows (one row may exceed it)."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, bytes | str) else 8 for v in row if v is not None)
        if size >= most or len(held) >= 4096:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ids_and_texts(batch: pa.RecordBatch) -> Iterator[tuple[object, str]]:
    """(first column, second column as str, null as empty) of a batch, converted a few rows at a time."""
    for part in slices(batch, 1):
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            yield key, text or ""


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows at most and about so many bytes of a text column (one row may exceed it)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that agree in the first `keys` columns (whole numbers, sorted), each whole, one after the other."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        columns = [held.column(c).to_numpy() for c in range(keys)]
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(ends) else ():
            yield held.slice(a, b - a)
        if len(ends):
            held = held.slice(ends[-1])
    if held is not None:
        yield held


def least_reached(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n points the least name that links (a, b) reach."""
    out = names.copy()
    while True:
        low = np.minimum(out[a], out[b])
        before = out.copy()
        np.minimum.at(out, a, low)
        np.minimum.at(out, b, low)
        if np.array_equal(before, out):
            return out
