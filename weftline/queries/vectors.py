"""Feature vectors: neighbours, moments, similarity, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, quantise_pixel, sincos_embedding
from ..operators import metrics, similarity
from ..tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of a search: every row whose id is divisible by 100."""
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items nearest to each query."""
    return similarity.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, "vec_id", "vec_id", "embedding")


def cosine_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of image pairs: vectors of neighbouring ids."""
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("gt"))
    return v.join(other, "vec_id").agg(F.round(F.avg(cosine("embedding", "gt")), 6).alias("clip_sim"), F.count("*").alias("n"))


def rerank_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates laid out [candidate][caption]: the best candidate of each caption."""
    v = _vectors(spark, sf_dir)
    size = 100
    captions = v.where(F.col("vec_id") < size).select(F.col("vec_id").alias("caption"), "embedding")
    candidates = v.where(F.col("vec_id") >= size).select((F.col("vec_id") % size).alias("caption"), F.floor(F.col("vec_id") / size).alias("candidate"), "embedding")
    return similarity.rerank(candidates, captions, "caption", "embedding", "candidate")


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.mean_vector(_vectors(spark, sf_dir), "embedding").select(F.col("dim").cast("long").alias("dim"), F.round("mean", 9).alias("mean"))


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariance of all dimensions (A10)."""
    one = similarity.co_moments(_vectors(spark, sf_dir), "embedding")
    d = F.size("mean")
    cell = F.floor(F.col("at") / d), F.col("at") % d
    cells = one.select("n", "mean", F.posexplode("products").alias("at", "p")).select(*[c.cast("long").alias(k) for c, k in zip(cell, "ij", strict=True)], F.round(F.col("p") / F.greatest(F.col("n") - 1, F.lit(1)), 9).alias("cov"))
    return cells.where("i <= j")


def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fréchet distance between vectors with even and with odd labels."""
    sides = similarity.moments(_vectors(spark, sf_dir).withColumn("side", F.col("label") % 2), "embedding", "side")
    return spark.createDataFrame([(round(similarity.frechet(*(x for k in "01" for x in (sides[k].mean, sides[k].covariance()))), 6),)], "fid double")


def frechet_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fréchet distance from each label's vectors to those of the label before it, dimensions taken as independent."""
    of = similarity.moments(_vectors(spark, sf_dir), "embedding", "label")
    diagonal = lambda m: np.diag(np.diag(m.covariance()))
    rows = [(int(k), round(similarity.frechet(of[before].mean, diagonal(of[before]), of[k].mean, diagonal(of[k])), 6)) for k in of if k and (before := str(int(k) - 1)) in of]
    return spark.createDataFrame(rows, "label int, fid double")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten options a query, scored by similarity; relevance is a common label, half for a neighbouring one."""
    best = similarity.knn(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10, "vec_id", "vec_id", "embedding").select("query_id", "item_id", "sim")
    labels = _vectors(spark, sf_dir).select("vec_id", "label")
    q = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    i = labels.select(F.col("vec_id").alias("item_id"), F.col("label").alias("il"))
    gap = F.abs(F.col("ql") - F.col("il"))
    return best.join(q, "query_id").join(i, "item_id").withColumn("rel", F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0))


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, mean rank and reciprocal rank of the options of the query's label."""
    ranked = metrics.ranks(_scores(spark, sf_dir), "query_id", "item_id", "sim").where("rel = 1.0")
    out = metrics.rank_metrics(ranked)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised gain of each query."""
    return metrics.ndcg(metrics.ranks(_scores(spark, sf_dir), "query_id", "item_id", "sim"), "query_id", "rel").withColumn("ndcg", F.round("ndcg", 9))


def sincos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sine and cosine embeddings of each turn's position."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = turns.select("conv_id", "turn", F.posexplode(sincos_embedding(F.col("turn"), 8)).alias("i", "x"))
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


def logprob_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option scores: log-softmax over a vector's entries, gathered at its label, summed by label."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    lse = F.log(F.aggregate(F.transform(logits, F.exp), F.lit(0.0), lambda a, x: a + x))
    lp = F.get(logits, F.col("label").cast("int")) - lse
    return _vectors(spark, sf_dir).groupBy("label").agg(F.round(F.sum(lp), 6).alias("score"), F.count("*").alias("n"))


def beam_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of beams x vocabulary scores the best 2 x beams a batch; token and beam by division."""
    from pyspark.sql.window import Window as W

    beams, vocab = 4, 64
    flat = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / beams).alias("batch"), (F.col("vec_id") % beams).alias("b"), F.posexplode("embedding").alias("t", "x"))
    index = (F.col("b") * vocab + F.col("t")).alias("ix")
    best = flat.select("batch", index, F.col("x").cast("double").alias("x")).withColumn("rank", F.row_number().over(W.partitionBy("batch").orderBy(F.desc("x"), "ix")).cast("long")).where(F.col("rank") <= 2 * beams)
    return best.select("batch", "rank", F.floor(F.col("ix") / vocab).alias("beam"), (F.col("ix") % vocab).alias("token"))


def pixel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as bytes, counted."""
    x = _vectors(spark, sf_dir).select(F.explode("embedding").alias("x"))
    return x.select(quantise_pixel((F.col("x").cast("double") + 1) / 2).alias("level")).groupBy("level").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    knn_topk, cosine_mean, rerank_best, mean_vector, covariance, frechet, frechet_diagonal, rank_metrics, ndcg, sincos, logprob_score, beam_topk, pixel_levels,
)}

_COS = "(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_BEST = f"""{_V}, pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS ql, i.label AS il, round({_COS.format(a="i.e", b="q.e")}, 6) AS sim FROM v i, v q WHERE q.vec_id % 100 = 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM pairs)"""
_REL = f"{_BEST}, rel AS (SELECT *, CASE abs(ql - il) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS rel FROM best WHERE rank <= 10)"

ORACLE_SQL: dict[str, str] = {
    "frechet_diagonal": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY ALL)
        SELECT a.label, round(sum((a.m - b.m) ** 2 + (sqrt(a.v) - sqrt(b.v)) ** 2), 6) AS fid FROM m a JOIN m b ON a.i = b.i AND b.label = a.label - 1 GROUP BY a.label""",
    "knn_topk": f"WITH {_BEST} SELECT query_id, item_id, sim, rank FROM best WHERE rank <= 5",
    "cosine_mean": f"WITH {_V} SELECT round(avg({_COS.format(a='a.e', b='b.e')}), 6) AS clip_sim, count(*) AS n FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "rerank_best": f"""WITH {_V}, s AS (SELECT c.vec_id AS caption, i.vec_id // 100 AS candidate, round(list_dot_product(i.e, c.e), 6) AS sim FROM v i JOIN v c ON c.vec_id = i.vec_id % 100 WHERE i.vec_id >= 100)
        SELECT caption, CAST(candidate AS BIGINT) AS candidate, sim FROM s QUALIFY row_number() OVER (PARTITION BY caption ORDER BY sim DESC, candidate) = 1""",
    "mean_vector": f"WITH {_V}, x AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) SELECT CAST(dim AS BIGINT) AS dim, round(avg(x), 9) AS mean FROM x GROUP BY dim",
    "covariance": f"WITH {_V} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(covar_samp(e[i + 1], e[j + 1]), 9) AS cov FROM v, range(64) a(i), range(64) b(j) WHERE i <= j GROUP BY i, j",
    "rank_metrics": f"""WITH {_REL}, t AS (SELECT rank FROM rel WHERE rel = 1.0)
        SELECT round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS r1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS r5, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS r10,
               round(avg(rank), 9) AS mean_rank, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM t""",
    "ndcg": f"""WITH {_REL}, k AS (SELECT *, count(*) FILTER (rel != 0) OVER (PARTITION BY query_id) AS k, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM rel)
        SELECT query_id, round(sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= k THEN rel / log2(ideal + 1) ELSE 0 END), 0), 9) AS ndcg FROM k GROUP BY 1""",
    "sincos": "SELECT conv_id, turn, CAST(i AS BIGINT) AS i, round(CASE WHEN i < 4 THEN sin(turn / pow(10000.0, i / 4.0)) ELSE cos(turn / pow(10000.0, (i - 4) / 4.0)) END, 9) AS x FROM conversations, range(8) b(i)",
    "logprob_score": f"WITH {_V} SELECT label, round(sum(e[label + 1] - ln(list_sum(list_transform(e, lambda x: exp(x))))), 6) AS score, count(*) AS n FROM v GROUP BY label",
    "beam_topk": f"""WITH {_V}, f AS (SELECT vec_id // 4 AS batch, vec_id % 4 * 64 + generate_subscripts(e, 1) - 1 AS ix, unnest(e) AS x FROM v),
        r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY x DESC, ix) AS rank FROM f)
        SELECT CAST(batch AS BIGINT) AS batch, rank, CAST(ix // 64 AS BIGINT) AS beam, ix % 64 AS token FROM r WHERE rank <= 8""",
    "pixel_levels": f"WITH {_V}, x AS (SELECT unnest(e) AS x FROM v) SELECT CAST(least(greatest(floor((x + 1) / 2 * 255 + 0.5), 0), 255) AS INT) AS level, count(*) AS n FROM x GROUP BY 1",
}
