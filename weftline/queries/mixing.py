"""Sampling, mixing, slicing and epochs on documents and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import hash01, hash01_sql
from ..operators import sampling as sam
from ..tables import table

_WEIGHTS = {"en": 1.0, "fr": 1.0, "de": 1.0, "es": 2.0}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def mix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.mix(_docs(spark, sf_dir), "lang", "doc_id", _WEIGHTS, "sum", keep=("doc_id",)).withColumn("vt", F.round("vt", 6))


def mix_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.mix(_docs(spark, sf_dir), "lang", "doc_id", _WEIGHTS, "shortest", keep=("doc_id",)).withColumn("vt", F.round("vt", 6))


def mix_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.mix(_docs(spark, sf_dir), "lang", "doc_id", _WEIGHTS, "longest", keep=("doc_id",)).withColumn("vt", F.round("vt", 6))


def mix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [sam.mix_length(_docs(spark, sf_dir), "lang", _WEIGHTS, r).select(F.lit(r).alias("rule"), "length") for r in ("sum", "longest", "shortest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.source_counts(_docs(spark, sf_dir), "source")


def sqrt_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.sqrt_weights(_docs(spark, sf_dir), "lang").withColumn("weight", F.round("weight", 9))


def inv_freq_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.inverse_frequency_weights(_docs(spark, sf_dir).select("doc_id", "lang"), "lang").withColumn("weight", F.round("weight", 12))


def oversample_inv_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and draws up to 1.5 times their number, rare languages as often as common ones."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return sam.oversample(docs, "lang", "doc_id", docs.count() * 3 // 2, 7)


def rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.rank_slices(_docs(spark, sf_dir).select("doc_id"), "doc_id", 7)


def strided_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin over nodes, then workers."""
    nodes = sam.strided(_docs(spark, sf_dir).select("doc_id"), F.col("doc_id"), 4).withColumnRenamed("rank", "node")
    return sam.strided(nodes, F.floor(F.col("doc_id") / 4), 3).withColumnRenamed("rank", "worker")


def epoch_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and samples of each source's epoch, rounded up and down."""
    counts = sam.source_counts(_docs(spark, sf_dir), "source")
    both = counts.select("source", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("round_up"))
    return both.select("source", "round_up", *[c.alias(k) for k, c in sam.epoch_sizes(F.col("n"), 4, 8, 3, F.col("round_up")).items()])


def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the shuffles of two epochs."""
    docs = _docs(spark, sf_dir).select("doc_id")
    return docs.select("doc_id", *[F.round(hash01(11 + e, F.col("doc_id")), 9).alias(f"epoch_{e}") for e in (0, 1)])


#: Buffer of samples of the shuffle.
BUFFER = 50


def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the shuffled streams of three workers, through a buffer."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", F.pmod("doc_id", F.lit(5))).alias("shard"))
    return sam.buffered_shuffle(sam.streams(docs, "shard", "doc_id", 3, 23, 1), "worker", BUFFER, 23, 1)


def bernoulli_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", sam.bernoulli(0.3, 3, F.col("doc_id")).alias("image_first"))


def random_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of each conversation."""
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]).alias("texts"))
    return lists.select("conv_id", sam.choice(F.col("texts"), 13, F.col("conv_id")).alias("text"))


def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, sample, rank = F.floor(F.col("doc_id") / 32), F.floor(F.col("doc_id") / 8) % 4, F.col("doc_id") % 8
    return _docs(spark, sf_dir).select("doc_id", sam.global_index(step, sample, rank, 4, 8).alias("global_index"))


def latin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each language's documents are read in each of four partitions, so that at a turn all languages are in use (M5)."""
    pairs = _docs(spark, sf_dir).select("lang", F.pmod("doc_id", F.lit(4)).alias("partition")).distinct()
    numbers = F.dense_rank().over(W.orderBy("lang")) - 1  # four pairs a language
    return pairs.withColumn("k", numbers).withColumn("n", F.max("k").over(W.partitionBy()) + 1).select("lang", "partition", sam.latin_order(F.col("k"), F.col("partition"), F.col("n")).cast("long").alias("place"))


def equal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language's first documents, as many as the rarest has."""
    return sam.equalised(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


#: Draws of shards, and their seed.
DRAWS, DRAW_SEED = 50, 17


def resampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of shards with replacement."""
    shards = table(spark, sf_dir, "documents").select("source").distinct()
    return sam.resampled(shards, "source", DRAWS, DRAW_SEED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    mix_sum, mix_shortest, mix_longest, mix_length, source_counts, sqrt_weights, inv_freq_weights, oversample_inv_freq, rank_slices, strided_slices, epoch_sizing, hash_shuffle, buffer_shuffle,
    bernoulli_branch, random_choice, global_index, latin_order, equal_ranks, resampled_shards,
)}

_P = "CASE lang WHEN 'es' THEN 2.0 ELSE 1.0 END"
_ROWS = f"r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n, CAST({_P} AS DOUBLE) AS p FROM documents)"

ORACLE_SQL: dict[str, str] = {
    "mix_sum": f"WITH {_ROWS} SELECT lang, doc_id, round((rn - 0.5) / p, 6) AS vt FROM r",
    "mix_shortest": f"WITH {_ROWS} SELECT lang, doc_id, round((rn - 0.5) / p, 6) AS vt FROM r WHERE (rn - 0.5) / p < (SELECT min(n / p) FROM r)",
    "mix_longest": f"""WITH {_ROWS}, t AS (SELECT max(n / p) AS t FROM r), x AS (SELECT lang, doc_id, (rn + k * n - 0.5) / p AS vt FROM r, t, range(1000) g(k) WHERE k < ceil(t * p / n))
        SELECT lang, doc_id, round(vt, 6) AS vt FROM x, t WHERE vt < t""",
    "mix_length": f"""WITH c AS (SELECT lang, count(*) AS n, any_value(CAST({_P} AS DOUBLE)) AS p FROM documents GROUP BY 1), s AS (SELECT sum(p) AS sp FROM c)
        SELECT 'sum' AS rule, CAST(sum(n) AS BIGINT) AS length FROM c
        UNION ALL (SELECT 'longest', CAST(ceil(n / p * sp) AS BIGINT) FROM c, s ORDER BY n DESC, lang DESC LIMIT 1)
        UNION ALL (SELECT 'shortest', CAST(ceil(n / p * sp) AS BIGINT) FROM c, s ORDER BY n, lang LIMIT 1)""",
    "source_counts": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "sqrt_weights": "SELECT lang, count(*) AS n, round(sqrt(count(*)) / sum(sqrt(count(*))) OVER (), 9) AS weight FROM documents GROUP BY 1",
    "inv_freq_weights": "SELECT doc_id, lang, round(1.0 / count(*) OVER (PARTITION BY lang) / (SELECT count(DISTINCT lang) FROM documents), 12) AS weight FROM documents",
    "oversample_inv_freq": f"""WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k, count(*) AS n FROM documents GROUP BY lang),
        r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
        d AS (SELECT draw, {hash01_sql('7', 'draw')} * (SELECT count(*) FROM k) AS u FROM range((SELECT count(*) * 3 // 2 - count(*) FROM documents)) g(draw))
        SELECT doc_id, lang, CAST(NULL AS BIGINT) AS draw FROM documents
        UNION ALL SELECT r.doc_id, r.lang, draw FROM d JOIN k ON k.k = floor(u) JOIN r ON r.lang = k.lang AND r.rn = floor((u - floor(u)) * n) + 1""",
    "rank_slices": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () // 7 AS per FROM documents) SELECT doc_id, CAST(rn // per AS BIGINT) AS rank FROM r WHERE rn // per < 7",
    "strided_slices": "SELECT doc_id, doc_id % 4 AS node, CAST((doc_id // 4) % 3 AS BIGINT) AS worker FROM documents",
    "epoch_sizing": """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, true AS round_up, CAST(ceil(n / 32.0) AS BIGINT) AS batches FROM n UNION ALL SELECT source, false, CAST(floor(n / 32.0) AS BIGINT) FROM n),
        w AS (SELECT *, CAST(CASE WHEN round_up THEN ceil(batches / 3.0) ELSE floor(batches / 3.0) END AS BIGINT) AS worker_batches FROM b)
        SELECT source, round_up, batches, worker_batches, worker_batches * 3 AS epoch_batches, worker_batches * 96 AS epoch_samples FROM w""",
    "hash_shuffle": f"SELECT doc_id, round({hash01_sql('11', 'doc_id')}, 9) AS epoch_0, round({hash01_sql('12', 'doc_id')}, 9) AS epoch_1 FROM documents",
    "buffer_shuffle": f"""WITH d AS (SELECT doc_id, concat_ws('/', source, doc_id % 5) AS shard FROM documents),
        w AS (SELECT shard, (row_number() OVER (ORDER BY h, shard) - 1) % 3 AS worker, h FROM (SELECT DISTINCT shard, {hash01_sql('24', 'shard')} AS h FROM d)),
        i AS (SELECT doc_id, shard, worker, row_number() OVER (PARTITION BY worker ORDER BY h, shard, doc_id) - 1 AS i FROM d JOIN w USING (shard))
        SELECT doc_id, shard, worker, row_number() OVER (PARTITION BY worker ORDER BY i + floor({hash01_sql('24', 'worker', 'i')} * {BUFFER}), i) - 1 AS place FROM i""",
    "bernoulli_branch": f"SELECT doc_id, {hash01_sql('3', 'doc_id')} < 0.3 AS image_first FROM documents",
    "random_choice": f"WITH l AS (SELECT conv_id, list(text ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1) SELECT conv_id, t[CAST(floor({hash01_sql('13', 'conv_id')} * len(t)) AS INT) + 1] AS text FROM l",
    "global_index": "SELECT doc_id, CAST((doc_id // 32 * 4 + doc_id // 8 % 4) * 8 + doc_id % 8 AS BIGINT) AS global_index FROM documents",
    "latin_order": """WITH p AS (SELECT DISTINCT lang, doc_id % 4 AS partition FROM documents), k AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM p)
        SELECT lang, partition, (k + partition) % (SELECT max(k) + 1 FROM k) AS place FROM k""",
    "equal_ranks": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))",
    "resampled_shards": f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
        SELECT draw, source FROM range(50) g(draw) JOIN s ON i = floor({hash01_sql('17', 'draw')} * n)""",
}
