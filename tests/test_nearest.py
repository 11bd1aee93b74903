"""knn against the plain cross join, on odd vectors and ties; and what a block costs."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.functions.vectors import cosine
from weftline.operators import similarity


def plain(items, queries, k):
    pairs = items.select(F.col("id").alias("item_id"), F.col("v").alias("w")).crossJoin(queries.select(F.col("id").alias("query_id"), "v"))
    scored = pairs.select("query_id", "item_id", F.round(cosine("v", "w"), 6).alias("sim"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "item_id")).cast("long"))
    return sorted(map(str, ranked.where(F.col("rank") <= k).collect()))


@pytest.mark.parametrize(("item_rows", "query_rows"), [(16_384, 4_096), (20, 7)])
def test_nearest_of_odd_vectors(spark, monkeypatch, item_rows, query_rows):
    """Copies, near ties, vectors of no length, of another length, with nulls and NaN: the same rows as by all pairs."""
    monkeypatch.setattr(similarity, "ITEM_ROWS", item_rows)
    monkeypatch.setattr(similarity, "QUERY_ROWS", query_rows)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))]
    rows += [(60 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(90 + i, [1.0, 2.0, 3.0, 4.0 + i * 1e-7]) for i in range(20)]
    rows += [(110, None), (111, [0.0] * 4), (112, [1.0, None, 2.0, 3.0]), (113, [1.0, 2.0]), (114, []), (115, [float("nan"), 1.0, 1.0, 1.0]), (116, [2.0, 1.0])]
    items = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    queries = items.where("id % 9 = 0 OR id >= 108")
    got = similarity.knn(items, queries, 5, "id", "id", "v")
    assert sorted(map(str, got.collect())) == plain(items, queries, 5)


def test_a_block_is_a_product_of_matrices():
    rng = np.random.default_rng(3)
    column = lambda n: pa.chunked_array([pa.array(list(rng.normal(size=(n, 64))), pa.list_(pa.float64()))])
    began = time.process_time()
    q, _, _ = similarity.nearest(column(16_000), column(500), 5, 6)
    assert len(q) == 2_500 and time.process_time() - began < 20
