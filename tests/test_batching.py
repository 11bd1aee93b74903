"""Packing against plain Python and by SQL, collators, and the buffered shuffle."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.fixed_values import BOS, EOS, IMAGE, PAD, SOI
from weftline.functions.hashing import hash01, hash01_of
from weftline.operators import collating, packing, sampling, table_functions

N = 2  # image tokens


def plain(samples, length, most, level, partial, few_shot):
    """The packer's rules on lists, step by step."""
    out, buffer = [], []

    def cut():
        nonlocal buffer
        end = min(length, len(buffer))
        spots = [k for k, t in enumerate(buffer) if t == SOI]
        if most > 0 and sum(t == IMAGE for t in buffer[:end]) // N > most:
            if level == "image":
                end = spots[most - 1] + N + 1
            else:
                begins = [k for k in range(spots[most]) if buffer[k] == BOS]
                end = begins[-1] if begins and begins[-1] > spots[most - 1] else spots[most]
        inside = [k for k in spots if k < end]
        split = bool(inside) and inside[-1] >= end - N
        if split:
            back = inside[-1]
            if level == "sample":
                begins = [k for k in range(1, end) if buffer[k] == BOS]
                back = begins[-1] if begins else back
            end = back or end
        got, buffer = buffer[:end], buffer[end:]
        if sum(t == IMAGE for t in got) // N == 0:
            return
        if few_shot > 1:
            begins = [k for k, t in enumerate(got) if t == BOS]
            gone = set(begins) - set(begins[::few_shot])
            gone |= {b - 1 for b in gone if b and got[b - 1] == EOS}
            got = [t for k, t in enumerate(got) if k not in gone]
        out.append((got, int(split)))

    for sample in samples:
        while len(buffer) >= length:
            cut()
        buffer = buffer + sample
    if buffer and (len(buffer) == length or partial):
        cut()
    return out


def samples(seed):
    rng = random.Random(seed)
    rows = []
    for shard in range(3):
        for k in range(rng.choice([0, 1, 60])):
            body = []
            for _ in range(rng.randint(0, 3)):
                body += [*range(100, 100 + rng.randint(0, 6)), *([SOI, *[IMAGE] * N] if rng.random() < 0.6 else [])]
            rows.append((shard, k, [BOS, *body, EOS]))
    return rows


@pytest.mark.parametrize("level", ["image", "sample"])
@pytest.mark.parametrize(("most", "partial", "few_shot"), [(-1, False, 0), (2, True, 2), (3, False, 3)])
def test_packing_equals_plain_and_sql(spark, level, most, partial, few_shot):
    rows = [(s + 10 * seed, o, ids) for seed in range(6) for s, o, ids in samples(seed)]
    df = spark.createDataFrame(rows, "shard int, ord int, ids array<bigint>")
    want = {(s, k): (ids, cut) for s in {r[0] for r in rows} for k, (ids, cut) in enumerate(plain([r[2] for r in rows if r[0] == s], 24, most, level, partial, few_shot))}
    got = packing.pack_images(df, "shard", "ord", "ids", 24, N, most, level, partial, few_shot).collect()
    assert {(r.shard, r.seq): (r.ids, r.is_truncated) for r in got} == want and len(got) == len(want) > 30
    table_functions.register(spark)
    df.createOrReplaceTempView("packing_samples")
    by_sql = spark.sql(f"SELECT * FROM pack_sequences(TABLE(packing_samples), shard => 'shard', ord => 'ord', ids => 'ids', length => 24, n_image => {N}, max_images => {most}, level => '{level}', partial => {partial}, few_shot => {few_shot})")
    assert {(r.shard, r.seq): (r.ids, r.is_truncated) for r in by_sql.collect()} == want


@pytest.mark.parametrize(
    ("call", "said"),
    [
        ("shard => 'shard', ord => 'ord', ids => 'ids', length => 8", "n_image"),
        ("shard => 'shard', ord => 'ord', ids => 'nothing', length => 8, n_image => 2", "no column nothing"),
        ("shard => 'shard', ord => 'ord', ids => 'ord', length => 8, n_image => 2", "array of int"),
        ("shard => 'shard', ord => 'ord', ids => 'ids', length => 'x', n_image => 2", "constant int as length"),
        ("shard => 'shard', ord => 'ord', ids => 'ids', length => 8, n_image => 2, level => 'word'", "truncation level"),
        ("shard => 'shard', ord => 'ord', ids => 'ids', length => 8, n_image => 2, other => 2", "no argument other"),
    ],
)
def test_what_the_table_function_refuses(spark, call, said):
    table_functions.register(spark)
    spark.createDataFrame([(1, 1, [1])], "shard int, ord int, ids array<bigint>").createOrReplaceTempView("packing_refused")
    with pytest.raises(Exception, match=said):
        spark.sql(f"SELECT * FROM pack_sequences(TABLE(packing_refused), {call})").collect()


PROMPTS = [
    (0, 0, [BOS, SOI, IMAGE, 5], [6, EOS], ["a"], [[1], [2, 3]]),
    (0, 1, [BOS, 7], None, None, [[4]]),
    (0, 2, [BOS, 8, BOS, SOI, IMAGE, SOI, IMAGE], [9], ["b", "c"], None),
    (1, 0, None, None, [], []),
]


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(PROMPTS, "batch int, place int, prompt array<int>, target array<int>, images array<string>, options array<array<int>>")


def test_collate(prompts):
    train, texts, images, scores = ({r.batch: r for r in collating.collate(prompts, ["batch"], "place", m, negative=F.array(F.lit(SOI), F.lit(IMAGE))).collect()} for m in collating.MODES)
    t = train[0]
    assert (t.rows, t.width) == (3, 8)
    assert t.ids == [BOS, SOI, IMAGE, 5, 6, EOS, PAD, PAD, BOS, 7, *[PAD] * 6, BOS, 8, BOS, SOI, IMAGE, SOI, IMAGE, 9]
    assert t.mask == [1] * 6 + [0] * 2 + [1] * 2 + [0] * 6 + [1] * 8
    assert t.labels == [-100] * 4 + [6, EOS] + [-100] * 2 + [-100] * 8 + [-100] * 7 + [9]
    assert (t.images, t.images_per_row, t.image_offsets) == (["a", "b", "c"], [1, 0, 2], [0, 1, 1])
    assert (t.image_rows, t.image_columns, t.image_bos) == ([0, 2, 2], [1, 3, 5], [0, 2, 2])
    assert t.prompt_lengths == [4, 2, 7] and (t.loss_image_weight, t.loss_text_weight) == (1, 1)
    g = texts[0]
    assert g.ids[:7] == [PAD] * 3 + [BOS, SOI, IMAGE, 5] and g.mask[:7] == [0] * 3 + [1] * 4 and g.image_columns == [4, 3, 5] and g.loss_image_weight == 0
    i = images[0]
    assert i.ids[:7] == [BOS, SOI, IMAGE, 5] + [PAD] * 3 and i.negative_ids == [SOI, IMAGE] and i.loss_text_weight == 0
    s = scores[0]
    assert (s.options_per_row, s.option_width, s.option_ids, s.option_mask) == ([2, 1, 0], 2, [1, PAD, 2, 3, 4, PAD], [1, 0, 1, 1, 1, 0])
    for mode in (train, texts, images, scores):
        assert (mode[1].rows, mode[1].width, mode[1].ids, mode[1].images, mode[1].image_rows) == (1, 0, [], [], [])


def test_collate_refuses_what_doesnt_fit(spark, prompts):
    with pytest.raises(ValueError):
        collating.collate(prompts, ["batch"], "place", "both")
    with pytest.raises(Exception, match="aren't as many"):
        collating.collate(prompts.withColumn("images", F.array(F.lit("one"))), ["batch"], "place", "train").collect()
    assert collating.collate(prompts.limit(0), ["batch"], "place", "train").count() == 0


def test_hash_in_python_is_that_of_spark(spark):
    rows = [(k, None if k % 5 == 0 else f"é{k}") for k in range(50)]
    got = spark.createDataFrame(rows, "k int, s string").select("k", "s", hash01(3, F.col("k"), F.col("s")).alias("h")).collect()
    assert all(r.h == hash01_of(3, r.k, r.s) for r in got)


def test_buffered_shuffle(spark):
    """A permutation of each worker's rows, the same on every run, of another epoch another, and near its order."""
    df = spark.createDataFrame([(f"s{k % 12}", k) for k in range(6_000)], "shard string, k int").repartition(5)
    streams = sampling.streams(df, "shard", "k", 3, seed=4)
    order = {w: [r.k for r in streams.where(F.col("worker") == w).collect()] for w in range(3)}
    shuffled = {e: sampling.buffered_shuffle(sampling.streams(df, "shard", "k", 3, seed=4), "worker", 100, 4, e).collect() for e in (0, 1)}
    again = sampling.buffered_shuffle(sampling.streams(df, "shard", "k", 3, seed=4), "worker", 100, 4, 0).collect()
    places = {e: {(r.worker, r.place): r.k for r in rows} for e, rows in shuffled.items()}
    assert {(r.worker, r.place): r.k for r in again} == places[0] != places[1]
    moves = []
    for w, ks in order.items():
        assert len(ks) == 2_000 and sorted(places[0][w, i] for i in range(2_000)) == sorted(ks)
        at = {k: i for i, k in enumerate(ks)}
        moves += [i - at[places[0][w, i]] for i in range(2_000)]
    assert max(map(abs, moves)) < 100 and sum(m == 0 for m in moves) < 300 and sum(map(abs, moves)) / len(moves) > 20
    plan = sampling.buffered_shuffle(df, "shard", 10)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") == df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    with pytest.raises(ValueError):
        sampling.buffered_shuffle(df, "shard", 0)
