"""tar_groups and caption_union over whole tables, against plain Python."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from weftline.queries import ingest


def documents(spark, tmp_path):
    rows = [(i, f"Text {i} " + "word " * 30) for i in range(430)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_every_document_is_in_an_archive(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = ingest.tar_groups(spark, str(tmp_path)).collect()
    want = Counter((f"part/{i:09d}", files) for i, _ in rows for files in (("json,txt", "txt") if i % 5 == 0 else ("json,txt",)))
    assert Counter((r.key, r.files) for r in got for _ in range(r.n)) == want
    sizes = Counter(s for s, _ in {(r.shard, r.key) for r in got})
    assert len(sizes) == 9 and max(sizes.values()) < 2 * ingest.TAR_DOCS


def test_a_task_holds_one_archive(spark, tmp_path, monkeypatch):
    """Archives leave the task that packs them one by one, however many it has."""
    documents(spark, tmp_path)
    held = []
    monkeypatch.setattr(ingest.sinks, "write_files", lambda df, *_: held.append(df) or df.select(F.lit(1)).limit(0).collect())
    monkeypatch.setattr(ingest.shards, "tar_members", lambda s, _: s.createDataFrame([], "shard string, place bigint, name string, content binary, error string"))
    ingest.tar_groups(spark, str(tmp_path))
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInPandas" in plan


def test_whole_captions(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = {r.doc_id: r.caption for r in ingest.caption_union(spark, str(tmp_path)).collect()}
    assert got == {i: (t if i % 2 == 0 else f"{t} two").lower() for i, t in rows}
