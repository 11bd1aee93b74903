"""Readers, sinks, streaming and the scoring boundary, on files made here."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.plans import scoring
from weftline.sources import registry, shards, sinks


def test_braces():
    assert shards.expand_braces("s_{0..3}.x") == ["s_0.x", "s_1.x", "s_2.x", "s_3.x"]
    assert shards.expand_braces("{08..10}") == ["08", "09", "10"] and shards.expand_braces("{3..1}") == ["3", "2", "1"]
    assert shards.expand_braces("{a,b{1..2}}{x,y}") == ["ax", "ay", "b1x", "b1y", "b2x", "b2y"]
    assert shards.expand_braces("plain") == ["plain"] and shards.expand_braces("{one}") == ["{one}"]


def doc(i: int, sims: list[float]) -> str:
    return json.dumps({"text_list": [f"t{i}"], "image_info": [{"image_name": f"{k}.png", "matched_text_index": 0, "matched_sim": s} for k, s in enumerate(sims)], "similarity_matrix": [[0.1]]})


def test_zipped_shards(spark, tmp_path):
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"docs_shard_{i}_v2.jsonl.zip", "w") as z:
            z.writestr(f"docs_shard_{i}_v2.jsonl", "\n".join([doc(10 * i, [0.3, 0.2]), "{broken", doc(10 * i + 1, [0.1])]))
    (tmp_path / "docs_shard_2_v2.jsonl.zip").write_bytes(b"nothing")
    out = registry.build(spark, {"name": "mmc4_wds", "annt_root": str(tmp_path), "input_shards": "docs_shard_{0..2}_v2.jsonl"}).collect()
    assert sorted((r.shard, r.line_no, len(r.image_info)) for r in out) == [("docs_shard_0_v2.jsonl", 0, 1), ("docs_shard_1_v2.jsonl", 0, 1)]
    assert shards.zipped_lines(spark, str(tmp_path / "*.zip")).where("error IS NOT NULL").count() == 1


def test_tar_shards(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name in ("x/1.jpg", "x/1.json", "x/2.jpg", "x/2.JPG", "x/1.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"ok"))
    got = shards.grouped_members(shards.tar_members(spark, str(tmp_path / "*.tar"))).orderBy("sample").collect()
    assert [(r.key, sorted(r.files)) for r in got] == [("x/1", ["jpg", "json"]), ("x/2", ["jpg"]), ("x/2", ["jpg"]), ("x/1", ["txt"])]


def test_json_sources(spark, tmp_path):
    pairs = tmp_path / "p.txt"
    pairs.write_text('{"image": "a.jpg", "caption": "One"}\n{"image": "b.jpg", "caption": ["Two", "three"]}\nbad\n')
    assert {r.image: r.captions for r in registry.build(spark, {"name": "laion_wds", "input_shards": str(pairs)}).collect()} == {"a.jpg": ["One"], "b.jpg": ["Two", "three"]}
    q, a = tmp_path / "q.json", tmp_path / "a.json"
    q.write_text(json.dumps({"questions": [{"image_id": 1, "question_id": 5, "question": "?"}]}))
    a.write_text(json.dumps({"annotations": [{"image_id": 1, "question_id": 5, "question_type": "t", "answer_type": "o", "answers": [{"answer": "x", "answer_id": 1}]}]}))
    row = registry.build(spark, {"name": "vqav2", "question_file": str(q), "annt_file": str(a)}).first()
    assert row.question == "?" and row.answers[0].answer == "x"
    with pytest.raises(NotImplementedError):
        registry.build(spark, {"name": "unheard_of"})


def test_dialogs_are_decoded(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"data": {"questions": ["q0", "q1"], "answers": ["a0", "a1", "a2"], "dialogs": [{"image_id": 9, "caption": "c", "dialog": [{"question": 1, "answer": 2, "answer_options": [2, 0]}, {"question": 0, "answer": 0, "answer_options": [1]}]}]}}))
    rows = registry.build(spark, {"name": "visdial", "annt_file": str(path)}).orderBy("round_id").collect()
    assert [(r.question, r.answer, r.options) for r in rows] == [("q1", "a2", ["a2", "a0"]), ("q0", "a0", ["a1"])]


def test_mixture_of_sources(spark, tmp_path):
    for name, n in (("a", 4), ("b", 8)):
        (tmp_path / f"{name}.txt").write_text("\n".join(json.dumps({"image": f"{name}{i}", "caption": "x"}) for i in range(n)))
    parts = {n: {"name": "laion_wds", "input_shards": str(tmp_path / f"{n}.txt")} for n in "ab"}
    out = registry.build(spark, {"name": "random_mix", "datasets": parts, "weights": {"a": 1.0, "b": 2.0}}).orderBy("vt").collect()
    assert len(out) == 12 and all((r.source == "a") == ('"a' in r.record) for r in out)


def test_catalog(spark):
    assert tuple(shards.size_catalog(spark, '{"s0": 5, "s1": 7}', ["x/s0", "x/s1", "x/s2"]).first()) == (12, 3)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "image_id int, ord int, caption string")
    sinks.write_results(df, str(tmp_path / "r"), "image_id", ["ord"])
    assert sorted((r.image_id, r.caption) for r in spark.read.json(str(tmp_path / "r")).collect()) == [(1, "x"), (2, "z")]
    for step in (1, 2):
        sinks.append_metrics(spark, str(tmp_path / "m"), {"b": 2, "a": 1}, step, 0.123)
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert sinks.vqa_results(df, vizwiz=True).first().image == "VizWiz_val_00000001.jpg"


def test_scoring_boundary(spark):
    df = spark.createDataFrame([(1, "a b c", ["x", "y"]), (2, "", ["z"])], "id int, p string, o array<string>")
    assert [r.generated in ("a", "b", "c", "") for r in scoring.generate(df, "p").collect()] == [True, True]
    assert [len(r.scores) for r in scoring.score_options(df, "p", "o").orderBy("id").collect()] == [2, 1]
    out = scoring.evaluate({"s": df}, {"s": lambda d: d.agg(F.count("*").alias("n"))}).first()
    assert (out.metric, out.value) == ("s_n", 2.0)


def test_losses(spark):
    text = spark.createDataFrame([(-1.0, 5), (-3.0, 7), (-9.0, -100)], "logp double, label int")
    images = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0], 9, 1), ([0.0], [3.0], 2, 1), ([0.0], [2.0], 3, 0), ([1.0], [0.0], 3, None)], "t array<float>, p array<float>, c int, m int")
    loss, image = scoring.losses(text, "logp", "label"), scoring.image_losses(images, "t", "p", "c", "m")
    assert loss.first().loss == 2.0 and image.first().loss == (2.0 + 0 + 0 + 1.0) / 4
    assert tuple(scoring.total_loss(loss, image).first()) == (2.0, 0.75, 9.5) and tuple(scoring.total_loss(loss).first()) == (2.0, None, 2.0)
    assert scoring.image_losses(images, "t", "p", "c").first().loss == (2.0 + 0 + 4.0 + 1.0) / 4
