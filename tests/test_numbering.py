"""Numbers over whole tables, and plans that don't pull a table into one task."""

from __future__ import annotations

import random

import pytest

from weftline.operators import numbering, packing, relational, sampling


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_numbers_are_those_of_a_sort(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(20)]), i, rng.choice("abc")) for i in range(500)]
    got = numbering.global_numbers(spark.createDataFrame(rows, "a int, b int, _x string"), ["a", "b"], ranges=ranges).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.rn, r.a, r.b, r._x) for r in got) == [(i, *r) for i, r in enumerate(order)]
    texts = spark.createDataFrame([(w,) for w in ("é", "b", "", "a", "ab")], "t string")
    assert [r.t for r in numbering.global_numbers(texts, ["t"], ranges=ranges).orderBy("rn").collect()] == ["", "a", "ab", "b", "é"]
    assert numbering.global_numbers(texts.where("false"), ["t"]).columns == ["t", "rn"]


def test_no_table_in_one_task(spark):
    df = spark.range(2000).selectExpr("id", "id % 7 AS k")
    for plan in (sampling.rank_slices(df, "id", 3), sampling.resampled(df, "id", 50), relational.unique_counts(df, "k", ["id"]), sampling.oversample(df, "k", "id", 3000)):
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() > 0


def test_next_fit_streams(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, 0, *range(1, 40)])) for i in range(3000)]
    want, state = {}, {}
    for s, i, n in sorted(rows):
        fill, bin_ = state.get(s, (0, 0))
        if fill and fill + (n or 0) > 30:
            fill, bin_ = 0, bin_ + 1
        state[s] = (fill + (n or 0), bin_)
        want[s, i] = bin_
    got = packing.next_fit(spark.createDataFrame(rows, "s string, i int, n int"), "s", "i", "n", 30)
    assert {(r.s, r.i): r.bin for r in got.collect()} == want
