"""Sinks: Spark's commit protocol does what rank files, barriers and renames did."""

from __future__ import annotations

import contextlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import keep_first
from ..session import ensure_importable
from . import file_writer


def write_results(df: DataFrame, path: str, remove_duplicate: str | None = None, order: Sequence[str] = ()) -> None:
    """Results as JSON lines; of rows that share a key the first in the given order."""
    out = keep_first(df, [remove_duplicate], list(order)) if remove_duplicate else df
    out.write.mode("overwrite").json(path)


def vqa_results(df: DataFrame, vizwiz: bool = False) -> DataFrame:
    """caption as answer, image_id as question id or as the second set's file name (K3)."""
    key = F.format_string("VizWiz_val_%08d.jpg", F.col("image_id")).alias("image") if vizwiz else F.col("image_id").alias("question_id")
    return df.select(key, F.col("caption").alias("answer"))


def append_metrics(spark: SparkSession, path: str, metrics: Mapping[str, float], step: int, epoch: float) -> None:
    """One JSON line a call (K5)."""
    row = [(k, float(v)) for k, v in sorted(metrics.items())]
    values = spark.createDataFrame(row, "k string, v double").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metrics"))
    values.select("metrics", F.lit(step).alias("step"), F.lit(round(epoch, 2)).alias("epoch")).coalesce(1).write.mode("append").json(path)


def write_files(df: DataFrame, path: str, name: str, content: str, overwrite: bool = True) -> None:
    """Binary files by name below path/files and df's other columns as a table in path/table, all of them or none (K6, K7)."""
    ensure_importable(df.sparkSession)
    file_writer.register(df.sparkSession)
    df.write.format("named_files").mode("overwrite" if overwrite else "append").options(nameColumn=name, contentColumn=content).save(path)


def date_in_order(spark: SparkSession, path: str) -> None:
    """Files of a folder get the order of their names as that of their dates, which is a stream's order; where the store sets no dates it stays."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f for f in store.listStatus(place) if f.isFile()), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in files), default=0)
    with contextlib.suppress(Exception):
        for k, f in enumerate(files):
            store.setTimes(f.getPath(), last - 1000 * (len(files) - k), -1)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Statistics or features computed once (K9), under a folder named by the plan's hash: another input or
    another computation gives another folder, never an older one's rows."""
    place = f"{path.rstrip('/')}/{df.semanticHash() & 0xFFFFFFFF:08x}"
    df.write.mode("ignore").parquet(place)
    return df.sparkSession.read.parquet(place)
