"""Rules of text, boxes and arrays on hand-computed cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, boxes, text, vectors
from weftline.functions.fixed_values import BOS, CURLY_CONTRACTIONS, EOS, IMAGE, PAD, SOI
from weftline.functions.hashing import hash01


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("said", "want"), [("It is a red car.", "red car"), ("pizza slice", "slice"), ('"The dog, or cat"', "dog"), ("two of them\nmore", "two"), ("", "")])
def test_extract_answer(spark, said, want):
    assert one(spark, text.extract_answer(F.lit(said)))[0] == want


@pytest.mark.parametrize(("said", "want"), [("3. x 3.5 .5 5.", "3 x 3.5 .5 5"), ("5..", "5"), ("a.b", "ab")])
def test_strip_periods(spark, said, want):
    assert one(spark, text.strip_periods(F.lit(said)))[0] == want


@pytest.mark.parametrize(("said", "want"), [("a-b", "a b"), ("a- b", "a b"), ("1,000 x-y", "1000 xy"), ("what?", "what ")])
def test_punctuation(spark, said, want):
    assert one(spark, text.process_punctuation(F.lit(said)))[0] == want


def test_digits_articles(spark):
    row = one(spark, text.process_digits_articles(F.lit("The Two dogs dont\tsee an  owl")), text.process_digits_articles(F.lit("dont Im"), CURLY_CONTRACTIONS))
    assert list(row) == ["2 dogs don't see owl", "don’t im"]


def test_interleave(spark):
    got = one(spark, text.interleave(F.array(F.lit("a cat"), F.lit("a dog"), F.lit("end")), F.array(F.lit(True), F.lit(True), F.lit(False)), F.array(F.lit(True), F.lit(False), F.lit(False)), 2))[0]
    block = "<|beginofimage|><|image|><|image|>"
    assert got == f"{block}a cat a dog{block}end</s>"


def test_dialog_context_skips_the_last_round(spark):
    q, a = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xyz"))
    got = one(spark, text.dialog_context(F.lit("cap"), q, a, F.lit(3)), text.dialog_context(F.lit("cap"), q, a, F.lit(3), True))
    assert got[0] == "caption: cap . question: a? answer: x. question: c? answer: "
    assert "question: b? answer: y. " in got[1]


def test_template_and_sides(spark):
    got = one(spark, text.template("{question} ok", image=F.lit("<i>"), question=F.lit("Q")), text.swap_sides(F.lit("left of right")), text.crop_allowed(F.lit("on top")), text.recapitalise(F.lit("pororo AND\n x"), ["Pororo"]))
    assert list(got) == ["<i>Q ok", "right of left", False, "Pororo and x"]


def test_box_text(spark):
    got = one(spark, boxes.box_to_text(*map(F.lit, (1, 22, 333, 999))), *boxes.text_to_box(F.lit("no box")), *boxes.text_to_box(F.lit("x(001,022)(333,999)")))
    assert list(got) == ["(001,022)(333,999)", 0, 0, 0, 0, 1, 22, 333, 999]


def test_iou(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = one(spark, boxes.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), boxes.iou(box(0, 0, 1, 1), box(2, 2, 3, 3)), boxes.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)))
    assert got[0] == pytest.approx(1 / 7) and got[1] == 0 and math.isnan(got[2])


def test_grounded_caption(spark):
    said = F.lit("a <ref>dog</ref><box>(10,20)(30,40)</box><box>(1,2)(3,4)</box>")
    got = one(spark, boxes.grounded_objects(said), boxes.rescale_caption(said, F.lit(100), F.lit(200)))
    assert got[0][0]["phrase"] == "dog" and got[0][0]["boxes"] == ["(10,20)(30,40)", "(1,2)(3,4)"]
    assert got[1] == "a <ref>dog</ref><box>(099,099)(299,199)</box><box>(009,009)(029,019)</box>"


def test_arrays(spark):
    ids = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    row = one(
        spark, arrays.dual_sort(F.array(F.lit(3), F.lit(1), F.lit(1)), F.array(F.lit("c"), F.lit("a"), F.lit("b"))), arrays.pad(ids(5, 6), F.lit(4)), arrays.pad(ids(5, 6), F.lit(4), left=True),
        arrays.pad_mask(ids(5, 6), F.lit(3)), arrays.trim_generated(ids(BOS, 7, SOI, EOS), 2), arrays.trim_generated(ids(7), 1, force_image=True), arrays.trim_generated(ids(), 1),
    )
    assert row[0] == ["a", "b", "c"] and row[1] == [5, 6, PAD, PAD] and row[2] == [PAD, PAD, 5, 6] and row[3] == [1, 1, 0]
    assert (row[4]["ids"], row[4]["stopped"]) == ([7, SOI, IMAGE, IMAGE], True)
    assert row[5]["ids"] == [7, SOI, IMAGE] and row[6]["ids"] == []


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, vectors.norm(a), vectors.cosine(a, a), vectors.cosine(a, z), vectors.unit(z), vectors.quantise_pixel(F.lit(1.2)), vectors.quantise_pixel(F.lit(0.5)))
    assert row[0] == 5 and row[1] == pytest.approx(1) and row[2] is None and row[3] is None and row[4] == 255 and row[5] == 128


def test_hash01(spark):
    rows = spark.range(2000).select(hash01(1, F.col("id")).alias("u"), hash01(2, F.col("id")).alias("v")).collect()
    assert all(0 <= r.u < 1 for r in rows) and 0.45 < sum(r.u for r in rows) / 2000 < 0.55 and rows[0].u != rows[0].v
