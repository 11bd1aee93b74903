"""Packing, mixing, joins and metrics: invariants and hand-computed cases."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.fixed_values import BOS, IMAGE, SOI
from weftline.operators import metrics, packing, relational, sampling, sequences, similarity


def image(n: int) -> list[int]:
    return [SOI] + [IMAGE] * n


def feed(samples, **options):
    packer = packing.Packer(**options)
    out = [x for s in samples for x in packer.add(np.array(s))]
    return [x.tolist() for x, _ in [*out, *packer.finish()]], packer


samples = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 2)).map(lambda x: [BOS, *range(100, 100 + x[0]), *image(3) * x[1]]), max_size=25)


@settings(max_examples=150, deadline=None)
@given(samples, st.sampled_from(["image", "sample"]), st.integers(-1, 4))
def test_packing_conserves_tokens(rows, level, most):
    """What comes out and what is left is what went in, but for sequences without an image."""
    options = {"length": 20, "n_image": 3, "max_images": most, "level": level}
    out, packer = feed(rows, **options)
    assert all(len(x) <= 20 and IMAGE in x for x in out)
    assert all(most <= 0 or x.count(SOI) <= most for x in out)
    flat = [t for r in rows for t in r]
    it = iter(flat)
    assert all(any(t == u for u in it) for x in out for t in x)  # in order, none invented
    assert not len(packer.tokens) or flat[-len(packer.tokens) :] == packer.tokens.tolist()


def test_a_split_image_goes_back():
    rows = [[BOS, 100, 101, *image(3)], [BOS, 102, *image(3)], [BOS, 103, *image(3)]]
    out, packer = feed(rows, length=11, n_image=3)
    assert out == [[BOS, 100, 101, *image(3), BOS, 102]] and packer.tokens.tolist() == [*image(3), BOS, 103, *image(3)]
    out, packer = feed(rows, length=11, n_image=3, level="sample")
    assert out == [[BOS, 100, 101, *image(3)]] and packer.tokens.tolist()[:2] == [BOS, 102]


def test_image_cap():
    out, _ = feed([[BOS, *image(2), *image(2), 100, *image(2)], [BOS, 101, 102], [BOS]], length=11, n_image=2, max_images=2)
    assert out[0] == [BOS, *image(2), *image(2)]


def test_next_fit(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate((6, 5, 4))] + [("b", i, n) for i, n in enumerate((20, 1))], "s string, o int, n int")
    got = {(r.s, r.o): r.bin for r in packing.next_fit(df, "s", "o", "n", 10).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("b", 0): 0, ("b", 1): 1}


def test_windows(spark):
    rows = [(0, p, t) for p, t in enumerate([SOI, 5, 5, SOI, 5, BOS, 5, SOI])]
    df = spark.createDataFrame(rows, "seq int, pos bigint, token bigint")
    assert [r.nearest_bos for r in sequences.nearest_bos(df).orderBy("pos").collect()] == [0, 0, 5]
    two = spark.createDataFrame([(0, p, {0: BOS, 10: BOS, 2: SOI, 5: SOI, 11: SOI, 14: SOI}.get(p, 7)) for p in range(16)], "seq int, pos bigint, token bigint")
    assert [r.previous for r in sequences.previous_image(two).orderBy("img").collect()] == [None, 0, None, 2]


@pytest.mark.parametrize("stop", ["sum", "shortest", "longest"])
def test_mixture_is_within_a_row_of_its_share(spark, stop):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", i) for i in range(100)], "s string, i int")
    rows = sampling.mix(df, "s", "i", {"a": 1.0, "b": 2.0}, stop, keep=("i",)).orderBy("vt", "s").collect()
    assert len(rows) == {"sum": 140, "shortest": 120, "longest": 150}[stop]
    for n in range(1, 100):
        assert abs(sum(r.s == "a" for r in rows[:n]) - n / 3) <= 1


def test_mixture_length(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 50, "s string")
    assert [sampling.mix_length(df, "s", {"a": 1.0, "b": 2.0}, r).first()[0] for r in ("sum", "longest", "shortest")] == [150, 300, 75]
    sizes = spark.range(1).select(*[c.alias(k) for k, c in sampling.epoch_sizes(F.lit(1000), 4, 8, 3, F.lit(True)).items()]).first()
    assert sizes.asDict() == {"batches": 32, "worker_batches": 11, "epoch_batches": 33, "epoch_samples": 1056}


def test_oversampling_evens_out(spark):
    df = spark.createDataFrame([("a", i) for i in range(900)] + [("b", i) for i in range(100)], "k string, i int")
    out = sampling.oversample(df, "k", "i", 3000).collect()
    drawn = Counter(r.k for r in out if r.draw is not None)
    assert len(out) == 3000 and abs(drawn["a"] - drawn["b"]) < 200


def test_joins_refuse_broken_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    with pytest.raises(ValueError, match="unique"):
        relational.checked_join(a, b, ["k"])
    with pytest.raises(ValueError, match="partner"):
        relational.checked_join(a, b.limit(1), ["k"])
    assert relational.checked_join(a.where("k = 1"), b.limit(1), ["k"]).count() == 1
    assert {r.k for r in relational.key_differences(a, b, ["k"]).collect()} == {2}


def test_vqa_score(spark):
    row = spark.createDataFrame([(1, "t", "a", "x", ["x"] * 3 + ["y"] * 7)], "question_id int, question_type string, answer_type string, answer string, answers array<string>")
    assert metrics.vqa_scores(row).first().score == pytest.approx(0.9)


def test_ndcg(spark):
    df = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate((1.0, 0.0, 0.5))], "q int, rank bigint, rel double")
    assert metrics.ndcg(df, "q", "rel").first().ndcg == pytest.approx(1 / (1 + 0.5 / np.log2(3)), abs=1e-9)
    assert metrics.ndcg(df.withColumn("rel", F.lit(0.0)), "q", "rel").first().ndcg is None


def test_frechet_of_diagonals():
    m, a, b = np.array([1.0, 2.0]), np.diag([4.0, 9.0]), np.diag([1.0, 16.0])
    assert similarity.frechet(m, a, m + 1, b) == pytest.approx(2 + (2 - 1) ** 2 + (3 - 4) ** 2)
    assert similarity.frechet(m, a, m, a) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_moments(spark, shift):
    """Sums of squares would lose the last nine digits of values round a million."""
    x = np.random.default_rng(0).normal(size=(500, 3)) + shift
    rows = [(v.tolist(), k % 3) for k, v in enumerate(x)] + [(None, 0), ([1.0, None, 2.0], 1)]
    df = spark.createDataFrame(rows, "v array<double>, k int").repartition(7)
    one = similarity.moments(df, "v")[None]
    assert one.n == 500 and np.allclose(one.mean, x.mean(0), rtol=1e-12) and np.allclose(one.covariance(), np.cov(x, rowvar=False), rtol=0, atol=1e-9)
    by = similarity.moments(df, "v", "k")
    assert set(by) == {"0", "1", "2"} and all(np.allclose(by[str(k)].covariance(), np.cov(x[k::3], rowvar=False), rtol=0, atol=1e-9) for k in range(3))
    assert similarity.moments(df.limit(0), "v") == {}


def test_moments_scan_once(spark, sf_dir):
    plan = similarity.co_moments(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_knn_plan_keeps_k_rows_a_task(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = similarity.knn(v, v.where("vec_id % 100 = 0"), 5, "vec_id", "vec_id", "embedding")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    from weftline.queries import relations

    plan = relations.facet_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(event_type" in plan and "props" not in plan.split("== Physical Plan ==")[1]


def test_caption_scores(spark):
    w = F.split("t", " ")
    cand = spark.createDataFrame([(0, "a b c d"), (1, "x y z w")], "id int, t string").select("id", w.alias("w"))
    refs = spark.createDataFrame([(0, 0, "a b c d"), (1, 0, "p q r s")], "id int, ref_id int, t string").select("id", "ref_id", w.alias("w"))
    assert {r.id: round(r.cider, 6) for r in metrics.cider(cand, refs, "id", F.col("w"), 4).collect()} == {0: 10.0, 1: 0.0}
    assert metrics.bleu(cand.where("id = 0"), refs.where("id = 0"), "id", F.col("w"), 2).first().bleu_2 == pytest.approx(1, abs=1e-6)
    pairs = spark.createDataFrame([(["a", "b", "a", "c"], ["b", "a", "x", "c"]), ([], ["a"])], "c array<string>, r array<string>")
    assert [round(r.rouge_l, 6) for r in metrics.rouge_l(pairs, "c", "r").collect()] == [0.75, 0.0]
