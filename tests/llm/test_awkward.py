"""Every operator and stage over the awkward rows, over none, and over clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from weftline.llm import byte_bpe, common, decontaminate, line_dedup, lm_score, near_copies, pii, quality, secrets, sharding, simhash, substring_dedup, vector_copies


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "Is this asked? Yes it is."), (1, None), (2, ""), (None, "a b c d e f g")], "item_id bigint, text string")


def digests_of(spark, items):
    return {
        "op1": pii.digests, "op2": secrets.digests, "op3": substring_dedup.digests, "op4": simhash.digests, "op5": sharding.shard, "op6": line_dedup.digests,
        "op8": lm_score.score, "op9": quality.digests, "op10": byte_bpe.digests, "op7": lambda d: decontaminate.digests(d, items),
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_row_for_row(spark, items, awkward, clashing, empty, name):
    make = digests_of(spark, items)[name]
    got = sorted(map(str, make(awkward).collect()))
    assert len(got) == awkward.count()
    assert sorted(map(str, make(clashing).collect())) == got
    assert make(empty).count() == 0


def test_decontamination(spark, items, awkward, clashing, empty):
    leak = spark.createDataFrame([(50, "so it goes and Is this asked? Yes it is. and on", "en", "a", 1), (51, None, "en", "a", 0)], awkward.schema)
    assert {(r.doc_id, r.item_id) for r in decontaminate.digests(leak.unionByName(awkward), items).collect()} == {(50, 0)}
    assert decontaminate.digests(empty, items).count() == 0
    assert decontaminate.digests(awkward, items.limit(0)).count() == 0
    kept = decontaminate.keep_clean(leak.unionByName(awkward), items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() + 1
    assert decontaminate.keep_clean(clashing, items).count() == clashing.count()


@pytest.mark.parametrize("stage", [quality.keep_good, line_dedup.clean, simhash.keep_one, near_copies.keep_one])
def test_stages_keep_columns(awkward, clashing, empty, stage):
    out = stage(awkward)
    assert out.schema.simpleString() == awkward.schema.simpleString()
    wide = stage(clashing)
    assert wide.columns == clashing.columns
    assert sorted(map(str, wide.select(*awkward.columns).collect())) == sorted(map(str, out.collect()))
    assert stage(empty).count() == 0


def test_encode(spark, sf_dir, awkward, clashing, empty):
    out = corpus_pipeline.encode(spark, awkward, sf_dir)
    rows = sorted(map(str, out.collect()))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and len(rows) == awkward.count()
    assert {r.n_tokens for r in out.where("doc_id IN (4, 5)").collect()} == {0}
    assert sorted(map(str, corpus_pipeline.encode(spark, clashing, sf_dir).collect())) == rows
    assert corpus_pipeline.encode(spark, empty, sf_dir).count() == 0


@pytest.mark.parametrize("make", [simhash.digests, line_dedup.digests, near_copies.grouped])
def test_hot_keys_at_any_size(awkward, monkeypatch, make):
    """Joins that split hot keys from the first row on give the rows of those that don't."""
    docs = awkward.unionByName(awkward.where("doc_id IN (1, 8, 12)"))
    want = sorted(map(str, make(docs).collect()))
    monkeypatch.setattr(common, "HOT_LEAST", 0)
    assert sorted(map(str, make(docs).collect())) == want


def test_hot_vectors_at_any_size(spark, monkeypatch):
    rows = [(k, [1.0 + 0.01 * (k % 5), 0.5, 0.1 * (k % 3)], k % 2) for k in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    want = sorted(map(str, vector_copies.grouped(vectors).collect()))
    monkeypatch.setattr(common, "HOT_LEAST", 0)
    assert sorted(map(str, vector_copies.grouped(vectors).collect())) == want


def test_near_copies_of_a_very_long_text(spark, sf_dir):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, " ".join(words[:30_000])), (4, "short"), (5, None)]
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
