"""Packing as a table function that SQL can call (Q2-Q5).

    table_functions.register(spark)
    spark.sql("SELECT * FROM pack_sequences(TABLE(samples), shard => 'shard', ord => 'ord', ids => 'ids', length => 2048, n_image => 64)")

The function partitions its table by the shard and orders it by the place itself, so a call can't leave that out: a task
takes one shard after the other, row by row, and holds one packer's buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..session import ensure_importable
from .packing import Packer

#: Arguments beside the table; a value is the default, its type what is accepted, and None means that the argument must be given.
ARGUMENTS: dict[str, tuple[type, Any]] = {
    "shard": (str, None), "ord": (str, None), "ids": (str, None), "length": (int, None), "n_image": (int, None),
    "max_images": (int, -1), "level": (str, "image"), "partial": (bool, False), "few_shot": (int, 0),
}


def settings(given: dict[str, Any]) -> dict[str, Any]:
    """The arguments with their defaults; unknown, missing, non-constant or ill-typed ones are refused by name."""
    for name in given:
        if name not in ARGUMENTS:
            raise ValueError(f"pack_sequences has no argument {name}; it has {', '.join(ARGUMENTS)}")
    out = {}
    for name, (kind, default) in ARGUMENTS.items():
        value = given.get(name, default)
        if value is None or type(value) is not kind:
            raise ValueError(f"pack_sequences needs a constant {kind.__name__} as {name}")
        out[name] = value
    return out


class PackSequences:
    """(shard, seq, ids, is_truncated) of a table of samples."""

    @staticmethod
    def analyze(table: AnalyzeArgument, **arguments: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(table.dataType, StructType) or not table.isTable:
            raise ValueError("the first argument of pack_sequences must be a table")
        if not all(a.isConstantExpression for a in arguments.values()):
            raise ValueError("the arguments of pack_sequences beside the table must be constants")
        own = settings({k: a.value for k, a in arguments.items()})
        for name in ("shard", "ord", "ids"):
            if own[name] not in table.dataType.fieldNames():
                raise ValueError(f"pack_sequences: the table has no column {own[name]}")
        kind = table.dataType[own["ids"]].dataType
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, IntegerType | LongType):
            raise ValueError(f"pack_sequences: {own['ids']} must be an array of int or bigint")
        Packer(**{k: own[k] for k in ("length", "n_image", "max_images", "level", "partial", "few_shot")})
        schema = StructType().add(own["shard"], table.dataType[own["shard"]].dataType).add("seq", LongType()).add("ids", ArrayType(LongType())).add("is_truncated", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(own["shard"])], orderBy=[OrderingColumn(own["ord"])])

    def __init__(self) -> None:
        self.packer: Packer | None = None
        self.shard, self.seq = None, 0

    def eval(self, row: Row, **arguments: Any) -> Iterator[tuple]:
        if self.packer is None:
            own = settings(arguments)
            self.columns = own["shard"], own["ids"]
            self.packer = Packer(**{k: own[k] for k in ("length", "n_image", "max_images", "level", "partial", "few_shot")})
            self.shard = row[self.columns[0]]
        yield from self._rows(self.packer.add(np.asarray(row[self.columns[1]] or [], np.int64)))

    def terminate(self) -> Iterator[tuple]:
        if self.packer is not None:
            yield from self._rows(self.packer.finish())

    def _rows(self, sequences: Iterator[tuple[np.ndarray, int]]) -> Iterator[tuple]:
        for ids, cut in sequences:
            yield self.shard, self.seq, ids.tolist(), cut
            self.seq += 1


def register(spark: SparkSession) -> None:
    """Make pack_sequences known to a session's SQL."""
    ensure_importable(spark)
    spark.udtf.register("pack_sequences", udtf(PackSequences))
