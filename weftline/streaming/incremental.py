"""The stateful operators fed incrementally: shards arrive, sequences leave."""

from __future__ import annotations

import json
import weakref
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.hashing import hash01_of
from ..operators.packing import Packer
from ..session import ensure_importable
from ..sources.shards import expand_braces

#: The state store that keeps value, list and map states as rows of their own.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shard_stream(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1) -> DataFrame:
    """Shards as they come, a few a trigger; the offset log replaces replay and skip."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


#: Samples before their turn that a call holds before it writes them to the state.
HELD = 50_000


class PackingProcessor(StatefulProcessor):
    """A Packer a shard, its state in three parts that are written row by row.

    `progress` (value): sequences given, the place that is due, samples that wait, whether the shard has
    ended. `buffer` (list): the packer's tokens, a row a sample; samples are appended, and the list is written anew
    only where a sequence was cut, when little more than a sequence's tokens are left. `early` (map): samples that
    came before their turn, by place; each is written once and removed once, and those whose turn comes within the same
    trigger mostly not at all.

    A sample without ids is the end mark, its place the number of samples: when it is due the tail is flushed as
    in the batch form, and the shard's buffer goes. With idle_ms a shard that gets no rows for so long ends as if its
    mark had come. Rows of an ended shard and places that were there already are left out.
    """

    def __init__(self, packer: dict[str, Any], most_early: int, idle_ms: int | None) -> None:
        self.packer, self.most_early, self.idle_ms = packer, most_early, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "seq bigint, due bigint, waiting bigint, ended boolean")
        self.buffer = handle.getListState("buffer", "ids array<bigint>")
        self.early = handle.getMapState("early", "place bigint", "ids array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq, due, waiting, ended = self.progress.get() if self.progress.exists() else (0, 0, 0, False)
        if ended:
            return
        packer = self._packer()
        chunks: list[tuple] = []  # samples since the last cut
        cut = False
        held: dict[int, Any] = {}  # early samples of this trigger that aren't in the state
        for frame in rows:
            out: list[tuple] = []
            for place, sample in zip(frame["o"].tolist(), frame["ids"], strict=True):
                if ended or place < due:
                    continue
                if place > due:
                    if place not in held and not (waiting and self.early.containsKey((place,))):
                        held[place] = sample
                        if len(held) >= HELD:
                            waiting += self._put(held)
                        if waiting + len(held) > self.most_early:
                            waiting += self._put(held)
                            raise ValueError(f"shard {key[0]!r}: {waiting} samples wait for number {due}, which hasn't come")
                    continue
                while True:
                    due += 1
                    if sample is None:
                        found, ended = list(packer.finish()), True
                    else:
                        found = list(packer.add(np.asarray(sample, np.int64)))
                        chunks.append(([int(t) for t in sample],))
                    if found:
                        cut = True
                    out += [(key[0], seq + k, ids.tolist(), flag) for k, (ids, flag) in enumerate(found)]
                    seq += len(found)
                    if ended:
                        break
                    if due in held:
                        sample = held.pop(due)
                        continue
                    if not waiting or not self.early.containsKey((due,)):
                        break
                    sample = self.early.getValue((due,))[0]
                    self.early.removeKey((due,))
                    waiting -= 1
            yield _rows(out)
        if ended:
            self._end(seq, due)
            return
        waiting += self._put(held)
        if cut or packer.dropped:
            self.buffer.clear()
            if len(packer.tokens):
                self.buffer.appendValue((packer.tokens.tolist(),))
        elif chunks:
            self.buffer.appendList(chunks)
        self.progress.update((seq, due, waiting, False))
        if self.idle_ms:
            self._wait(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seq, due, waiting, ended = self.progress.get()
        if ended:
            return
        if waiting:
            raise ValueError(f"shard {key[0]!r}: {waiting} samples wait for number {due}, which hasn't come")
        out = [(key[0], seq + k, ids.tolist(), flag) for k, (ids, flag) in enumerate(self._packer().finish())]
        self._end(seq + len(out), due)
        yield _rows(out)

    def _put(self, held: dict[int, Any]) -> int:
        """Early samples go to the state; how many."""
        n = len(held)
        for place, sample in held.items():
            self.early.updateValue((place,), (None if sample is None else [int(t) for t in sample],))
        held.clear()
        return n

    def _packer(self) -> Packer:
        held = [np.asarray(ids, np.int64) for (ids,) in self.buffer.get()]
        return Packer(**self.packer, tokens=np.concatenate(held) if held else np.empty(0, np.int64))

    def _end(self, seq: int, due: int) -> None:
        self.buffer.clear()
        self.early.clear()
        self.progress.update((seq, due, 0, True))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _wait(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["s", "seq", "ids", "is_truncated"])


def packed_stream(
    samples: DataFrame, shard: str, ids: str, order: str, length: int, n_image: int, max_images: int = -1, level: str = "image",
    partial: bool = False, few_shot: int = 0, most_early: int = 100_000, idle_ms: int | None = None,
) -> DataFrame:
    """(shard, seq, ids, is_truncated): the sequences of pack_images, tail included, whatever order files and triggers bring.

    `order` is a sample's place in its shard, from 0 without gaps; a row with null ids and the place after the last
    ends the shard (end_marks() makes them). A shard of which more than most_early samples wait for one that doesn't come
    fails the query with its name and the missing place, rather than hold them for ever; where files come in any order, as many
    as a shard has may wait. The session is told to
    keep state in RocksDB, which this operator needs.
    """
    spark = samples.sparkSession
    ensure_importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    packer = {"length": length, "n_image": n_image, "max_images": max_images, "level": level, "partial": partial, "few_shot": few_shot}
    Packer(**packer)  # what it refuses is refused here
    kind = samples.schema[shard].dataType.simpleString()
    rows = samples.selectExpr(f"`{shard}` AS s", f"CAST(`{order}` AS bigint) AS o", f"CAST(`{ids}` AS array<bigint>) AS ids")
    out = rows.groupBy("s").transformWithStateInPandas(
        PackingProcessor(packer, most_early, idle_ms), f"s {kind}, seq bigint, ids array<bigint>, is_truncated int", "append", "processingTime" if idle_ms else "none"
    )
    return out.withColumnRenamed("s", shard)


def end_marks(samples: DataFrame, shard: str, ids: str, order: str) -> DataFrame:
    """(shard, order, ids) rows that end the shards of a table of samples."""
    return samples.groupBy(shard).agg((F.max(order) + 1).alias(order)).withColumn(ids, F.lit(None).cast(samples.schema[ids].dataType))


class DrawReader(SimpleDataSourceStreamReader):
    """Draws of shards with replacement; the offset is the number of the next draw, so a restart repeats none and leaves none out."""

    def __init__(self, options: dict[str, str]) -> None:
        patterns = json.loads(options["shards"])
        self.shards = [s for p in ([patterns] if isinstance(patterns, str) else patterns) for s in expand_braces(p)]
        self.seed = int(options.get("seed", 0)) + int(options.get("epoch", 0))
        self.per_trigger = int(options.get("pertrigger", 100))
        self.draws = int(options["draws"]) if "draws" in options else None

    def initialOffset(self) -> dict:
        return {"draw": 0}

    def read(self, start: dict) -> tuple[Iterable[tuple], dict]:
        end = start["draw"] + (self.per_trigger if self.shards else 0)
        if self.draws is not None:
            end = max(start["draw"], min(end, self.draws))
        return self.readBetweenOffsets(start, {"draw": end}), {"draw": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(draw, self.shards[int(hash01_of(self.seed, draw) * len(self.shards))]) for draw in range(start["draw"], end["draw"])])

    def commit(self, end: dict) -> None:
        """Nothing is held for a draw."""


class ResampledShards(DataSource):
    """(draw, shard) without end: shards drawn with replacement, the draws of sampling.resampled() over the sorted list.

    Options: `shards`, a JSON list of names or brace patterns; `seed` and `epoch`; `perTrigger`, draws at a time;
    `draws`, where the stream is to end. No shards, no draws.
    """

    @classmethod
    def name(cls) -> str:
        return "resampled_shards"

    def schema(self) -> str:
        return "draw bigint, shard string"

    def simpleStreamReader(self, schema: StructType) -> DrawReader:
        return DrawReader({k.lower(): v for k, v in self.options.items()})


_known: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def resampled_stream(spark: SparkSession, shards: Iterable[str], seed: int = 0, epoch: int = 0, per_trigger: int = 100, draws: int | None = None) -> DataFrame:
    """(draw, shard) as a stream."""
    ensure_importable(spark)
    if spark not in _known:
        spark.dataSource.register(ResampledShards)
        _known.add(spark)
    reader = spark.readStream.format("resampled_shards").options(shards=json.dumps(list(shards)), seed=seed, epoch=epoch, perTrigger=per_trigger)
    return (reader if draws is None else reader.option("draws", draws)).load()


def to_table(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], Any] | None = None) -> StreamingQuery:
    """Append to parquet once, through the checkpoint (K8); `each` may take the batches instead."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).outputMode("append").start()
