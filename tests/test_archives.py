"""Archives read in byte ranges, and named files written all or none."""

from __future__ import annotations

import io
import json
import tarfile
import tracemalloc
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.queries import ingest
from weftline.sources import archives, file_writer, shards, sinks, store

SPLITS = [600, 5_000, archives.SPLIT_BYTES]


def zip_of(path, members, how=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, data in members:
            z.writestr(name, data)


def tar_of(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        t.addfile(tarfile.TarInfo("empty"), io.BytesIO(b""))


def read(reader):
    return [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


@pytest.mark.parametrize("split", SPLITS)
def test_zip_ranges_give_each_member_once(tmp_path, split):
    members = [(f"m{k}.txt", "\n".join(f"{k} line {j} é" for j in range(50 * (k % 3))) + "\n" * (k % 2)) for k in range(30)]
    zip_of(tmp_path / "a.zip", members)
    got = read(archives.ZipReader({"path": str(tmp_path / "a.zip"), "splitbytes": str(split), "member": "*.txt"}))
    want = Counter((name, j, line) for name, text in members for j, line in enumerate(io.StringIO(text, newline="\n")))
    assert Counter((r["member"], r["line_no"], r["value"] + "\n" * (r["value"] + "\n" == w)) for r in got for w in [next((x for n, j, x in want if n == r["member"] and j == r["line_no"]), "")]) == want


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("mode", ["w", "w:gz", "w:xz"])
def test_tar_ranges_give_each_member_once(tmp_path, split, mode):
    members = [(f"d/{k}.bin", bytes([k]) * (k * 37 % 1500)) for k in range(40)] + [("d/" + "long" * 60, b"x")]
    tar_of(tmp_path / "a.tar", members, mode)
    got = read(archives.TarReader({"path": str(tmp_path / "a.tar"), "splitbytes": str(split)}))
    assert [(r["place"], r["name"], r["content"]) for r in sorted(got, key=lambda r: r["place"])] == [(k, *m) for k, m in enumerate([*members, ("empty", b"")])]
    assert all(r["error"] is None for r in got)


def test_what_is_broken_is_counted(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(3_000))
    zip_of(tmp_path / "good.jsonl.zip", [("good.jsonl", text)])
    whole = (tmp_path / "good.jsonl.zip").read_bytes()
    middle = len(whole) // 2
    (tmp_path / "bit.jsonl.zip").write_bytes(whole[:middle].replace(b"good.jsonl", b"bit.jsonl!") + bytes([whole[middle] ^ 255]) + whole[middle + 1 :].replace(b"good.jsonl", b"bit.jsonl!"))
    (tmp_path / "cut.jsonl.zip").write_bytes(whole[:middle])
    (tmp_path / "empty.jsonl.zip").write_bytes(b"")
    zip_of(tmp_path / "other.jsonl.zip", [("name", "x")])
    paths = [str(tmp_path / f"{n}.jsonl.zip") for n in ("good", "cut", "empty", "other", "missing")]
    rows = shards.zipped_lines(spark, paths).collect()
    assert [r.value for r in rows if r.shard == "good.jsonl"] == text.split("\n")
    assert Counter(r.shard for r in rows if r.error) == {f"{n}.jsonl": 1 for n in ("cut", "empty", "other", "missing")}
    bit = shards.zipped_lines(spark, str(tmp_path / "bit*"), member="*").collect()
    assert sum(r.error is not None for r in bit) == 1 and bit[-1].value is None
    tar_of(tmp_path / "a.tar", [(f"{k}", b"y" * 600) for k in range(20)])
    (tmp_path / "cut.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:6_000])
    for split in (700, 10**6):
        tar = shards.tar_members(spark, [str(tmp_path / "cut.tar"), str(tmp_path / "a.tar")], splitBytes=split).collect()
        assert sum(r.content is not None for r in tar if r.shard == "a.tar") == 21
        cut = [r for r in tar if r.shard == "cut.tar"]
        assert 1 <= sum(r.error is not None for r in cut) and 2 <= sum(r.content == b"y" * 600 for r in cut) <= 4


def test_folders_and_patterns(spark, tmp_path):
    for k in range(3):
        zip_of(tmp_path / f"s{k}.zip", [(f"s{k}", f"a\nb{k}")])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    for path in (str(tmp_path), str(tmp_path / "s*.zip"), f"file:{tmp_path}"):
        assert sorted((r.shard, r.line_no, r.value) for r in shards.zipped_lines(spark, path).collect()) == [x for k in range(3) for x in ((f"s{k}", 0, "a"), (f"s{k}", 1, f"b{k}"))]
    (tmp_path / "none").mkdir()
    assert shards.zipped_lines(spark, str(tmp_path / "none")).count() == 0


def test_small_archives_share_a_partition():
    parts = archives.ranges([("a", 10), ("b", 0), ("c", -1), ("d", 300)], 100 + 3 * archives.OPEN_BYTES)
    assert [[x[0] for x in p.parts] for p in parts] == [["a", "b", "c"], ["d"]]
    assert [p.parts for p in archives.ranges([("e", 250)], 100)] == [[("e", 0, 100)], [("e", 100, 200)], [("e", 200, 250)]]


def test_an_archive_of_three_gigabytes(spark, tmp_path):
    """More than a value can hold: six members of half a gigabyte, each its own task; one task's memory is measured."""
    line = b"0123456789abcdef" * 1023 + b"\n"
    block, blocks = line * 64, 512
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(6):
            with z.open(zipfile.ZipInfo(f"part{k}"), "w", force_zip64=True) as out:
                for _ in range(blocks):
                    out.write(block)
    assert (tmp_path / "big.zip").stat().st_size > 3 * 10**9
    lines = shards.zipped_lines(spark, str(tmp_path / "big.zip"), member="part*", splitBytes=256 << 20)
    got = lines.withColumn("task", F.spark_partition_id()).agg(F.count("value").alias("n"), F.sum(F.length("value")).alias("chars"), F.count("error").alias("errors"), F.count_distinct("task").alias("tasks")).first()
    assert (got.n, got.chars, got.errors) == (6 * 64 * blocks, 6 * 64 * blocks * (len(line) - 1), 0) and got.tasks == 6
    reader = archives.ZipReader({"path": str(tmp_path / "big.zip"), "member": "part*", "splitbytes": str(256 << 20)})
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    rows, most = 0, 0
    for batch in reader.read(reader.partitions()[0]):
        rows, most = rows + batch.num_rows, max(most, pa.total_allocated_bytes() - before)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 64 * blocks and peak + most < 64 << 20
    (tmp_path / "big.zip").unlink()


def test_documents_by_language_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, "it", 4), (2, "it", 6), (3, None, 5)], "doc_id int, lang string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.metric: r.value for r in ingest.metric_table(spark, str(tmp_path)).collect()} == {"it_mean_chars": 5.0, "it_n": 2.0, "null_mean_chars": 5.0, "null_n": 1.0}


# --- named files ----------------------------------------------------------------------------------------


def test_files_and_their_table(spark, tmp_path):
    rows = [(f"img/{k:03d}.png", bytes([k]) * k, f"answer {k}") for k in range(50)] + [("empty", None, None)]
    df = spark.createDataFrame(rows, "name string, content binary, answer string").repartition(5)
    path = str(tmp_path / "out")
    sinks.write_files(df, path, "name", "content")
    assert {str(p.relative_to(tmp_path / "out" / "files")): p.read_bytes() for p in (tmp_path / "out" / "files").rglob("*") if p.is_file()} == {n: c or b"" for n, c, _ in rows}
    assert sorted(map(tuple, spark.read.parquet(path + "/table").collect()), key=str) == sorted(((n, a) for n, _, a in rows), key=str)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="is there already"):
        sinks.write_files(df, path, "name", "content", overwrite=False)
    sinks.write_files(df.limit(0), path, "name", "content")
    assert not list((tmp_path / "out" / "files").iterdir()) and spark.read.parquet(path + "/table").count() == 0


@pytest.mark.parametrize("bad", ["../up", "/root", "", None, "a//b", "same"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    rows = [("good", b"1"), ("same", b"2"), (bad, b"3")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="not a file name|two files are named"):
        sinks.write_files(df, str(tmp_path / "out"), "name", "content")
    assert list(tmp_path.iterdir()) == []


def test_a_job_that_fails_leaves_the_old_files(spark, tmp_path):
    good = spark.createDataFrame([("a", b"old")], "name string, content binary")
    sinks.write_files(good, str(tmp_path / "out"), "name", "content")
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_files(spark.createDataFrame([("a", b"new"), ("..", b"")], "name string, content binary"), str(tmp_path / "out"), "name", "content")
    assert (tmp_path / "out" / "files" / "a").read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_killed_attempt_leaves_nothing(spark, tmp_path):
    """An attempt dies after some files, its partition is written again, and a second attempt of another one comes too late."""
    schema = spark.createDataFrame([], "name string, content binary, note string").schema
    writer = file_writer.FileWriter(schema, {"path": str(tmp_path / "out")}, False)
    batch = lambda k, names: pa.record_batch({"name": names, "content": [n.encode() for n in names], "note": [k] * len(names)})

    def dies():
        yield batch("first", ["a", "gone"])
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    one, two = writer.write(iter([batch("again", ["a", "b"])])), writer.write(iter([batch("other", ["c"])]))
    writer.write(iter([batch("late", ["c"])]))
    assert not (tmp_path / "out").exists()
    writer.commit([one, None, two])
    assert {p.name: p.read_bytes() for p in (tmp_path / "out" / "files").iterdir()} == {"a": b"a", "b": b"b", "c": b"c"}
    assert sorted(r.note for r in spark.read.parquet(str(tmp_path / "out/table")).collect()) == ["again", "again", "other"]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_paths():
    assert store.paths_of({"paths": json.dumps(["a", "b"]), "path": "c"}) == ["a", "b"] and store.paths_of({"path": "c"}) == ["c"]
    with pytest.raises(ValueError):
        store.paths_of({})
