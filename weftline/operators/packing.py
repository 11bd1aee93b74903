"""Sequence packing: relational where offsets decide, a table function where cuts depend on what was pushed back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.fixed_values import BOS, EOS, IMAGE, SOI


def pack_fixed(tokens: DataFrame, shard: str, order: list[str], length: int) -> DataFrame:
    """tokens with seq and at: a shard's tokens in a row, cut every `length`; the incomplete tail goes (Q1 without images)."""
    rn = F.row_number().over(W.partitionBy(shard).orderBy(*order)) - 1
    placed = tokens.withColumns({"seq": F.floor(rn / length).cast("long"), "at": (rn % length).cast("long")})
    return placed.withColumn("_n", F.count("*").over(W.partitionBy(shard, "seq"))).where(F.col("_n") == length).drop("_n")


@dataclass
class Packer:
    """Buffer of one shard: takes samples, gives sequences (Q1-Q5).

    A sequence is cut where the buffer holds `length` tokens when the next sample comes, and at the end only
    if the buffer is exactly that long, or `partial`. Over `max_images` it is cut short after the last allowed
    image (`image`) or before the next one's sample (`sample`); an image that the cut would split goes back,
    with its sample under `sample`. Sequences without images are dropped.
    """

    length: int
    n_image: int
    max_images: int = -1
    level: str = "image"
    partial: bool = False
    few_shot: int = 0
    tokens: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: Sequences that were cut and dropped for lack of images.
    dropped: int = 0

    def __post_init__(self) -> None:
        if self.level not in ("image", "sample"):
            raise ValueError(f"unknown truncation level: {self.level}")

    def add(self, sample: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        while len(self.tokens) >= self.length:
            got = self.cut()
            if got is not None:
                yield got
        self.tokens = np.concatenate([self.tokens, np.asarray(sample, np.int64)])

    def finish(self) -> Iterator[tuple[np.ndarray, int]]:
        if len(self.tokens) and (len(self.tokens) == self.length or self.partial):
            got = self.cut()
            if got is not None:
                yield got

    def cut(self) -> tuple[np.ndarray, int] | None:
        """The next sequence and whether it was cut short of an image; None where it has no image."""
        end = min(self.length, len(self.tokens))
        if 0 < self.max_images < np.count_nonzero(self.tokens[:end] == IMAGE) // self.n_image:
            starts = np.flatnonzero(self.tokens == SOI)
            end = int(starts[self.max_images - 1]) + self.n_image + 1
            if self.level == "sample":
                following = int(starts[self.max_images])
                opens = np.flatnonzero(self.tokens[:following] == BOS)
                end = int(opens[-1]) if len(opens) and opens[-1] > starts[self.max_images - 1] else following
        truncated = 0
        starts = np.flatnonzero(self.tokens[:end] == SOI)
        if len(starts) and starts[-1] >= end - self.n_image:
            truncated, back = 1, int(starts[-1])
            if self.level == "sample":
                opens = np.flatnonzero(self.tokens[:end] == BOS)
                # a sample that opens the sequence would leave nothing: then only the image goes back
                back = int(opens[-1]) if len(opens) and opens[-1] > 0 else back
            end = back if back > 0 else end
        out, self.tokens = self.tokens[:end], self.tokens[end:]
        if np.count_nonzero(out == IMAGE) // self.n_image <= 0:
            self.dropped += 1
            return None
        return self.boundaries_off(out), truncated

    def boundaries_off(self, out: np.ndarray) -> np.ndarray:
        """Under few_shot > 1 only every few_shot-th sample keeps its BOS and the EOS before it (off by default, as published)."""
        if self.few_shot < 2:
            return out
        opens = np.flatnonzero(out == BOS)
        drop = np.zeros(len(out), bool)
        kept = set(opens[:: self.few_shot].tolist())
        for b in opens.tolist():
            if b not in kept:
                drop[b] = True
                if b and out[b - 1] == EOS:
                    drop[b - 1] = True
        return out[~drop]


def pack_images(samples: DataFrame, shard: str, order: str, ids: str, length: int, n_image: int, max_images: int = -1, level: str = "image", partial: bool = False, few_shot: int = 0) -> DataFrame:
    """(shard, seq, ids, is_truncated): samples of each shard, in order, through a Packer.

    Cuts depend on what earlier cuts pushed back, so a shard is one sequential unit; shards run in parallel
    and stream through the sorted partition, so a task holds one buffer and one sample.
    """
    key = samples.schema[shard].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, at, seq = None, None, 0
        for frame in frames:
            out = []
            for s, sample in zip(frame["s"], frame["ids"], strict=True):
                if packer is None or s != at:
                    if packer is not None:
                        out += [(at, seq + k, *x) for k, x in enumerate(packer.finish())]
                    packer, at, seq = Packer(length, n_image, max_images, level, partial, few_shot), s, 0
                for x in packer.add(np.asarray(sample)):
                    out.append((at, seq, *x))
                    seq += 1
            yield pd.DataFrame([(a, b, c.tolist(), d) for a, b, c, d in out], columns=["s", "seq", "ids", "is_truncated"])
        if packer is not None:
            rest = [(at, seq + k, x.tolist(), d) for k, (x, d) in enumerate(packer.finish())]
            yield pd.DataFrame(rest, columns=["s", "seq", "ids", "is_truncated"])

    rows = samples.select(F.col(shard).alias("s"), F.col(order).alias("o"), F.col(ids).cast("array<bigint>").alias("ids")).repartition("s").sortWithinPartitions("s", "o").drop("o")
    return rows.mapInPandas(run, f"s {key}, seq bigint, ids array<bigint>, is_truncated int").withColumnRenamed("s", shard)


def next_fit(df: DataFrame, shard: str, order: str, size: str, most: int) -> DataFrame:
    """(shard, order, size, bin): a new bin where the next row would pass `most` and the bin isn't empty (Q8).

    Each bin's start hangs on the one before, so a shard is one sequential unit; shards run in parallel and
    stream through the sorted partition, so a task holds one Arrow batch and two numbers, however many rows
    a shard has. Null sizes count as nothing and share the bin that is open.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (shard, order)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fill, bin_, began = None, 0, 0, False
        for batch in batches:
            bins = np.empty(batch.num_rows, np.int64)
            for k, (s, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not began or s != at:
                    at, fill, bin_, began = s, 0, 0, True
                if fill and fill + (n or 0) > most:
                    fill, bin_ = 0, bin_ + 1
                fill += n or 0
                bins[k] = bin_
            yield pa.record_batch([*batch.columns, pa.array(bins)], names=["s", "o", "n", "bin"])

    rows = df.select(F.col(shard).alias("s"), F.col(order).alias("o"), F.col(size).cast("long").alias("n")).repartition("s").sortWithinPartitions("s", "o")
    out = rows.mapInArrow(run, f"s {kinds[shard]}, o {kinds[order]}, n bigint, bin bigint")
    return out.select(F.col("s").alias(shard), F.col("o").alias(order), F.col("n").alias(size), "bin")


def batches(df: DataFrame, shard: str, order: str, size: int, partial: bool = False) -> DataFrame:
    """df with batch and place; a last batch that isn't full goes unless partial (Q6)."""
    rn = F.row_number().over(W.partitionBy(shard).orderBy(order)) - 1
    out = df.withColumns({"batch": F.floor(rn / size).cast("long"), "place": (rn % size).cast("long")})
    if partial:
        return out
    return out.withColumn("_n", F.count("*").over(W.partitionBy(shard, "batch"))).where(F.col("_n") == size).drop("_n")
