"""Packing by state and resampled shards as a stream: equal to the batch forms, over restarts."""

from __future__ import annotations

import json
import os

import pytest

from weftline.operators import packing, sampling
from weftline.queries import batching, outputs
from weftline.streaming import incremental

SCHEMA = "s int, o int, ids array<bigint>"
ROWS = [(s, i, [1, *range(100, 100 + (i * 7 + s) % 11), 32000, 32001, 32001]) for s in range(3) for i in range(40)]


def arrives(folder, place: int, rows) -> None:
    path = folder / f"{place}.json"
    path.write_text("\n".join(json.dumps({"s": s, "o": o, "ids": ids}) for s, o, ids in rows))
    os.utime(path, (1_000_000 + place, 1_000_000 + place))


def run(spark, tmp_path, **options):
    stream = incremental.packed_stream(incremental.shard_stream(spark, str(tmp_path / "in"), SCHEMA, 2), "s", "ids", "o", 32, 2, 3, **options)
    query = incremental.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    return query


def packed(spark, tmp_path):
    rows = [((r.s, r.seq), (r.ids, r.is_truncated)) for r in spark.read.schema("s int, seq bigint, ids array<bigint>, is_truncated int").parquet(str(tmp_path / "out")).collect()]
    assert len(rows) == len(dict(rows)), "a sequence twice"
    return dict(rows)


def batch(spark, rows, **options):
    return {(r.s, r.seq): (r.ids, r.is_truncated) for r in packing.pack_images(spark.createDataFrame(rows, SCHEMA), "s", "o", "ids", 32, 2, 3, **options).collect()}


@pytest.mark.parametrize(("arrival", "partial"), [((0, 1, 2, 3, 4, 5, 6, 7), False), ((7, 6, 5, 4, 3, 2, 1, 0), True), ((3, 0, 6, 1, 7, 2, 5, 4), True)])
def test_equals_batch_with_its_tail(spark, tmp_path, arrival, partial):
    """Whatever order the files come in, the end marks among them, one file twice, and over a restart from the checkpoint."""
    (tmp_path / "in").mkdir()
    marks = [(s, 40, None) for s in range(3)]
    for place, part in enumerate(arrival[:5]):
        arrives(tmp_path / "in", place, [r for r in ROWS if r[1] // 5 == part] + (marks if part == 6 else []))
    run(spark, tmp_path, partial=partial)
    for place, part in enumerate((*arrival[5:], arrival[0]), 5):
        arrives(tmp_path / "in", place, [r for r in ROWS if r[1] // 5 == part] + (marks if part == 6 else []))
    run(spark, tmp_path, partial=partial)
    got = packed(spark, tmp_path)
    assert got == batch(spark, ROWS, partial=partial)
    arrives(tmp_path / "in", 20, [(0, 40, [1, 5]), (0, 41, [1, 6])])  # an ended shard takes nothing more
    run(spark, tmp_path, partial=partial)
    assert packed(spark, tmp_path) == got


def test_state_is_written_by_what_arrives(spark, tmp_path):
    """Hundreds of samples wait for the first one; a trigger writes rows for those that it brings, not for those that wait."""
    (tmp_path / "in").mkdir()
    rows = [(0, i, [1, 100, 32000, 32001, 32001]) for i in range(1, 601)]
    for k in range(12):
        arrives(tmp_path / "in", k, rows[50 * k : 50 * (k + 1)])
    written = [sum(op.numRowsUpdated for op in p.stateOperators) for p in run(spark, tmp_path).recentProgress if p.numInputRows]
    assert len(written) == 6 and max(written) <= 110 and not packed(spark, tmp_path)
    arrives(tmp_path / "in", 20, [(0, 0, rows[0][2]), (0, 601, None)])
    run(spark, tmp_path)
    assert packed(spark, tmp_path) == batch(spark, [(0, 0, rows[0][2]), *rows])


def test_a_missing_sample_is_said(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrives(tmp_path / "in", 0, [(7, i, [1, 2]) for i in range(3, 30)])
    with pytest.raises(Exception, match="shard 7.*number 0"):
        run(spark, tmp_path, most_early=20)


def test_an_idle_shard_ends(spark, tmp_path):
    """Without an end mark a timer flushes the tail."""
    (tmp_path / "in").mkdir()
    rows = [r for r in ROWS if r[0] == 0 and r[1] < 5]
    arrives(tmp_path / "in", 0, rows)
    stream = incremental.packed_stream(incremental.shard_stream(spark, str(tmp_path / "in"), SCHEMA), "s", "ids", "o", 32, 2, 3, partial=True, idle_ms=500)
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).format("parquet").option("path", str(tmp_path / "out")).trigger(processingTime="300 milliseconds").start()
    try:
        want = batch(spark, rows, partial=True)
        for _ in range(60):
            query.awaitTermination(1)
            if any((tmp_path / "out").glob("*.parquet")) and packed(spark, tmp_path) == want:
                break
        assert packed(spark, tmp_path) == want
    finally:
        query.stop()


def test_the_query_lets_a_whole_shard_wait(spark, sf_dir, monkeypatch):
    """Files come in any order, so a fixed number of samples that may wait is passed once shards are large enough."""
    monkeypatch.setattr(incremental.packed_stream, "__defaults__", (-1, "image", False, 0, 3, None))
    got = sorted(map(str, outputs.streamed_packing(spark, sf_dir).collect()))
    assert got == sorted(map(str, batching.pack_images(spark, sf_dir).collect())) and got


def test_end_marks(spark):
    got = incremental.end_marks(spark.createDataFrame(ROWS, SCHEMA), "s", "ids", "o").collect()
    assert sorted((r.s, r.o, r.ids) for r in got) == [(s, 40, None) for s in range(3)]


@pytest.mark.parametrize("per_trigger", [1, 7, 100])
def test_resampled_stream_equals_batch(spark, tmp_path, per_trigger):
    """However the draws are cut into triggers, and over a restart, they are those of the batch form, each once."""
    names = [f"s{k:02d}" for k in range(11)]
    n = 12 if per_trigger == 1 else 40
    for upto in (n // 2, n):  # the second run goes on from the first one's checkpoint
        stream = incremental.resampled_stream(spark, ["s{00..10}"], 5, 12, per_trigger, draws=upto)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).format("parquet").option("path", str(tmp_path / "out")).start()
        query.processAllAvailable()
        query.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sampling.resampled(spark.createDataFrame([(s,) for s in names], "shard string"), "shard", n, 5, 12)
    assert got == sorted((r.draw, r.shard) for r in want.collect())


def test_resampled_stream_of_no_shards(spark):
    reader = incremental.DrawReader({"shards": "[]"})
    assert reader.read(reader.initialOffset())[1] == {"draw": 0}
