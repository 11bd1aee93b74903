"""Deterministic sampling, mixing, slicing and epoch arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.hashing import hash01, hash01_of
from .numbering import global_numbers


def source_counts(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"))


def sqrt_weights(df: DataFrame, source: str) -> DataFrame:
    """source, n and the share of its square root among all sources' (M6)."""
    counts = source_counts(df, source)
    return counts.withColumn("weight", F.sqrt("n") / F.sum(F.sqrt("n")).over(W.partitionBy()))


def inverse_frequency_weights(df: DataFrame, key: str) -> DataFrame:
    """df with weight: 1 over the rows of its key, over the sum of that, which is the number of keys (A4)."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    keys = counts.agg(F.count("*").alias("_k"))
    return df.join(counts, key).crossJoin(F.broadcast(keys)).withColumn("weight", 1.0 / F.col("_n") / F.col("_k")).drop("_n", "_k")  # one row


def numbered(df: DataFrame, source: str, order: Column | str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(source).orderBy(order)))


def mix(df: DataFrame, source: str, order: Column | str, weights: Mapping[str, float] | None = None, stop: str = "sum", keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, *keep, vt): sources interleaved by virtual time (row - 0.5) / p, read in the order of vt.

    After any stretch of the result a source is within one row of its share. `sum` ends with the last row;
    `shortest` where the first source ends; `longest` repeats sources until all have ended once (M1-M3).
    """
    if stop not in ("sum", "shortest", "longest"):
        raise ValueError(f"unknown stop rule: {stop}")
    rows = numbered(df.select(source, *keep), source, order)
    sizes = rows.groupBy(source).agg(F.max("_rn").alias("_size"))
    p = F.lit(1.0)
    if weights:
        p = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)].cast("double"), F.lit(1.0))
    sizes = sizes.withColumn("_p", p)
    if stop == "sum":
        return rows.join(sizes, source).select(source, *keep, ((F.col("_rn") - 0.5) / F.col("_p")).alias("vt"))
    ends = sizes.agg((F.min if stop == "shortest" else F.max)(F.col("_size") / F.col("_p")).alias("_end"))
    held = rows.join(sizes, source).crossJoin(F.broadcast(ends))  # one row
    if stop == "longest":
        again = F.ceil(F.col("_end") * F.col("_p") / F.col("_size")).cast("int")
        held = held.select("*", F.explode(F.sequence(F.lit(0), again - 1)).alias("_turn"))
        held = held.withColumn("_rn", F.col("_rn") + F.col("_turn") * F.col("_size"))
    return held.withColumn("vt", (F.col("_rn") - 0.5) / F.col("_p")).where("vt < _end").select(source, *keep, "vt")


def mix_length(df: DataFrame, source: str, weights: Mapping[str, float] | None, rule: str) -> DataFrame:
    """One row, length: of the mixture; longest and shortest go by the raw number of rows (M4)."""
    counts = source_counts(df, source)
    p = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(source)].cast("double"), F.lit(1.0)) if weights else F.lit(1.0)
    held = counts.withColumn("p", p)
    if rule == "sum":
        return held.agg(F.sum("n").alias("length"))
    pick = F.max_by if rule == "longest" else F.min_by
    chosen = pick(F.struct("n", "p"), F.struct(F.col("n"), F.col(source)))
    return held.agg(chosen.alias("c"), F.sum("p").alias("all")).select(F.ceil(F.col("c.n") / F.col("c.p") * F.col("all")).cast("long").alias("length"))


def oversample(df: DataFrame, key: str, order: str, target: int, seed: int = 0) -> DataFrame:
    """df and as many draws as target lacks, with replacement, a row's chance the inverse of its key's frequency.

    Draw i falls on u in [0, 1); as each key has the same mass, u picks the key and its fraction the row, so
    a draw needs equi-joins only and no cumulative sums in one place.
    """
    total, n_keys = df.agg(F.count("*"), F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).first()
    keys = global_numbers(df.select(key).distinct(), [key], "_k")
    rows = numbered(df, key, order).withColumn("_size", F.count("*").over(W.partitionBy(key)))
    draws = df.sparkSession.range(max(target - total, 0)).select(F.col("id").alias("draw"), (hash01(seed, F.col("id")) * n_keys).alias("_u"))
    picked = draws.withColumn("_k", F.floor("_u")).join(keys, "_k")
    placed = picked.join(rows.groupBy(key).agg(F.max("_size").alias("_size")), key).withColumn("_rn", (F.floor((F.col("_u") - F.col("_k")) * F.col("_size")) + 1).cast("int"))
    more = placed.select(key, "_rn", "draw").join(rows.drop("_size"), [key, "_rn"]).select(*df.columns, "draw")
    return df.withColumn("draw", F.lit(None).cast("long")).unionByName(more)


def rank_slices(df: DataFrame, order: str, world: int) -> DataFrame:
    """df with rank: contiguous equal slices, the remainder goes."""
    per_rank = df.count() // world
    held = global_numbers(df, [order], "rank")
    return held.withColumn("rank", F.floor(F.col("rank") / max(per_rank, 1)).cast("long")).where(F.col("rank") < (world if per_rank else 0))


def strided(df: DataFrame, index: Column, world: int) -> DataFrame:
    """df with rank: round-robin."""
    return df.withColumn("rank", F.pmod(index, F.lit(world)).cast("long"))


def epoch_sizes(samples: Column, batch: int, world: int, workers: int, round_up: Column) -> dict[str, Column]:
    """Batches, batches a worker, and the samples of an epoch so rounded."""
    cut = lambda x: F.when(round_up, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    batches = cut(samples / (batch * world))
    per_worker = cut(batches / max(workers, 1))
    whole = per_worker * max(workers, 1)
    return {"batches": batches, "worker_batches": per_worker, "epoch_batches": whole, "epoch_samples": whole * batch * world}


def shuffled(df: DataFrame, *keys: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df in the order of a hash of seed + epoch and keys: a whole shuffle (O9); buffered_shuffle is the one of a buffer."""
    return df.orderBy(hash01(seed + epoch, *[F.col(k) for k in keys]), *keys)


def streams(df: DataFrame, shard: str, order: str, workers: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df with `worker`, laid out as loaders read it: shards in shuffled order, dealt to workers round-robin, a worker's rows
    in one partition, shard after shard.

    Only names of shards are shuffled to find their order; the rows move once, unless the reader has a worker's
    files in one partition already.
    """
    seeded = hash01(seed + epoch, F.col(shard))
    names = df.select(shard).distinct().withColumn("_h", seeded)
    placed = global_numbers(names, ["_h", shard], "_place").select(shard, F.pmod("_place", F.lit(workers)).cast("long").alias("worker"))
    return df.join(placed, shard).repartition("worker").sortWithinPartitions("worker", seeded, shard, order)


def buffered_shuffle(df: DataFrame, worker: str, buffer: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df with place: each worker's rows, shuffled through a buffer of so many rows as they come.

    Row i of a worker is held until row i + d has come, d drawn evenly from 0 to buffer - 1 by a hash of seed + epoch,
    worker and i; rows that fall due together keep their order. So the result is a permutation, no row moves further
    ahead than the buffer is long nor is held longer, and a retry or another epoch gives what its numbers say.
    A worker's rows must lie in one partition, in order; none is exchanged, and a task holds one buffer and one batch.
    """
    if buffer < 1:
        raise ValueError("the buffer must hold a row")
    at = df.columns.index(worker)
    schema = to_arrow_schema(df.schema).append(pa.field("place", pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, due = None, None, np.empty(0, np.int64)
        came = gone = 0

        def leave(most: int | None) -> Iterator[pa.RecordBatch]:
            """Rows that are due before `most`, in the order in which they fall due."""
            nonlocal held, due, gone
            if held is None or not held.num_rows:
                return
            order = np.lexsort((np.arange(len(due)), due))
            n = len(order) if most is None else int(np.searchsorted(due[order], most))
            first, rest = order[:n], np.sort(order[n:])
            out = held.take(pa.array(first)).append_column("place", pa.array(np.arange(gone, gone + n))).cast(schema)
            held, due, gone = held.take(pa.array(rest)), due[rest], gone + n
            yield from out.to_batches()

        for batch in batches:
            names = batch.column(at).to_pylist()
            cuts = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if a == b:
                    continue
                if held is None or names[a] != now:
                    yield from leave(None)
                    now, held, due, came, gone = names[a], None, np.empty(0, np.int64), 0, 0
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                held = part if held is None else pa.concat_tables([held, part])
                due = np.concatenate([due, [i + int(hash01_of(seed + epoch, now, i) * buffer) for i in range(came, came + b - a)]]).astype(np.int64)
                came += b - a
                yield from leave(came)
        yield from leave(None)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("place", LongType())]))


def bernoulli(p: float, *parts: Column | str | int) -> Column:
    return hash01(*parts) < p


def choice(values: Column, *parts: Column | str | int) -> Column:
    """One of an array's values, evenly."""
    return F.get(values, F.floor(hash01(*parts) * F.size(values)).cast("int"))


def k_of_group(df: DataFrame, group: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, without replacement."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(hash01(seed, F.col(group), F.col(key)), key))).where(F.col("_r") <= k).drop("_r")


def resampled(df: DataFrame, order: str, n: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """n draws with replacement (S13): (draw, row's columns)."""
    total = df.count()
    rows = global_numbers(df, [order], "_i")
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), F.floor(hash01(seed + epoch, F.col("id")) * total).alias("_i"))
    return draws.join(rows, "_i").drop("_i")


def global_index(step: Column, sample: Column, rank: Column, batch: int, world: int) -> Column:
    return (step * batch + sample) * world + rank


def latin_order(source: Column, partition: Column, n: Column) -> Column:
    """Place of a source in a partition's order, so that at each turn all sources are in use (M5)."""
    return F.pmod(source + partition, n)


def equalised(df: DataFrame, rank: str, order: str) -> DataFrame:
    """Every rank's first rows, as many as the smallest rank has."""
    least = df.groupBy(rank).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(rank).orderBy(order))).crossJoin(F.broadcast(least)).where("_rn <= _least").drop("_rn", "_least")  # one row
