"""Sinks and streams on the tables: what was written is read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import scratch_dir
from ..sources import sinks
from ..streaming import incremental
from ..tables import table
from . import batching, mixing
from .token_windows import _samples


def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two ranks, the second's repeats left out, as JSON lines."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "lang"), scratch_dir(spark)
    both = docs.withColumn("rank", F.lit(0)).unionByName(docs.select("doc_id", F.upper("lang").alias("lang")).withColumn("rank", F.lit(1)))
    sinks.write_results(both, path, "doc_id", ["rank"])
    return spark.read.schema("doc_id bigint, lang string, rank int").json(path)


def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a file of its own, and a row about it, from one job (K6, K7)."""
    path = scratch_dir(spark)
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    content = F.encode(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), "UTF-8")
    rows = files.select(F.format_string("%03d/%06d.txt", F.pmod("conv_id", F.lit(7)), "conv_id").alias("name"), content.alias("content"), F.size("t").cast("long").alias("turns"))
    sinks.write_files(rows, path, "name", "content")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/files")
    written = read.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.md5("content").alias("md5"))
    return spark.read.parquet(f"{path}/table").join(written, "name").select("name", "turns", "md5")


def cached_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics computed once and read the second time (K9)."""
    path, counts = scratch_dir(spark), table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    sinks.materialise(counts, path)
    return sinks.materialise(counts, path)


#: Samples in a file of the stream, on average.
FILE_SAMPLES = 50_000


def streamed_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in files that come a few a trigger, packed by state, written through a checkpoint, tail included (K8, Q1-Q4).

    Files hold stretches of places and are dated in their order, so few samples wait for their turn; a store that takes no dates may
    bring them in any order, so as many as there are may wait.
    """
    source, out, checkpoint = (scratch_dir(spark) for _ in range(3))
    place = F.row_number().over(W.partitionBy("shard").orderBy("ord")) - 1
    samples = _samples(spark, sf_dir).withColumn("ord", place.cast("long"))
    n = samples.count()
    files = max(4, -(-n // FILE_SAMPLES))
    samples.unionByName(incremental.end_marks(samples, "shard", "ids", "ord")).repartitionByRange(files, "ord").sortWithinPartitions("ord").write.json(source)
    sinks.date_in_order(spark, source)
    stream = incremental.packed_stream(incremental.shard_stream(spark, source, samples.schema, 2), "shard", "ids", "ord", batching.LENGTH, batching.N_IMAGE, batching.MAX_IMAGES, "image", most_early=n + 1)
    incremental.to_table(stream, out, checkpoint).awaitTermination()
    return batching._sums(spark.read.schema("shard bigint, seq bigint, ids array<bigint>, is_truncated int").parquet(out))


def streamed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of resampled_shards as a stream (S13); the shards' names are its configuration, so they come to the driver."""
    names = [r.source for r in table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().orderBy("source").collect()]
    out, checkpoint = scratch_dir(spark), scratch_dir(spark)
    stream = incremental.resampled_stream(spark, names, mixing.DRAW_SEED, per_trigger=mixing.DRAWS, draws=mixing.DRAWS)
    incremental.to_table(stream, out, checkpoint).awaitTermination()
    return spark.read.schema("draw bigint, shard string").parquet(out).withColumnRenamed("shard", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    written_results, named_results, cached_statistics, streamed_packing, streamed_draws,
)}

ORACLE_SQL: dict[str, str] = {
    "written_results": "SELECT doc_id, lang, CAST(0 AS INT) AS rank FROM documents",
    "named_results": """SELECT lpad(CAST(conv_id % 7 AS VARCHAR), 3, '0') || '/' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '.txt' AS name, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS md5 FROM conversations GROUP BY conv_id""",
    "cached_statistics": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source",
    "streamed_packing": batching.ORACLE_SQL["pack_images"],
    "streamed_draws": mixing.ORACLE_SQL["resampled_shards"],
}
