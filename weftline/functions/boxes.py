"""Boxes as columns: text form, parsing, IoU, flips and crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box_to_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.format_string("(%03d,%03d)(%03d,%03d)", *(c.cast("int") for c in (x1, y1, x2, y2)))


def text_to_box(text: Column) -> Box:
    """The first box of a text; zeros where there is none."""
    pattern = r"\(([0-9]+),([0-9]+)\)\(([0-9]+),([0-9]+)\)"
    return tuple(F.coalesce(F.regexp_extract(text, pattern, k).try_cast("double"), F.lit(0.0)) for k in (1, 2, 3, 4))


def rescale(v: Column, size: Column, scale: int = 999) -> Column:
    """A pixel as a whole number of scale-ths, cut toward zero."""
    return (v / size * scale).cast("int")


def flip(x1: Column, x2: Column) -> tuple[Column, Column]:
    """Left and right edge of the mirrored box, of relative ones."""
    return 1 - x2, 1 - x1


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; NaN where both have no area, as 0/0."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union != 0, w * h / union).otherwise(F.lit(float("nan")))


def is_sane(b: Box) -> Column:
    return (b[0] <= b[2]) & (b[1] <= b[3])


def crop(b: Box, c: Box) -> Box:
    """b in relative places of the crop c, which first grows to hold b."""
    grown = (F.least(c[0], b[0]), F.least(c[1], b[1]), F.greatest(c[2], b[2]), F.greatest(c[3], b[3]))
    w, h = F.nullif(grown[2] - grown[0], F.lit(0.0)), F.nullif(grown[3] - grown[1], F.lit(0.0))
    return ((b[0] - grown[0]) / w, (b[1] - grown[1]) / h, (b[2] - grown[0]) / w, (b[3] - grown[1]) / h)


def grounded_objects(caption: Column) -> Column:
    """array<struct<phrase, boxes>> of <ref>phrase</ref><box>...</box>... in a caption."""
    refs = F.regexp_extract_all(caption, F.lit(r"<ref>([^<]*)</ref>((?:<box>[^<]*</box>)*)"), F.lit(0))
    return F.transform(refs, lambda r: F.struct(F.regexp_extract(r, r"<ref>([^<]*)</ref>", 1).alias("phrase"), F.regexp_extract_all(r, F.lit(r"<box>([^<]*)</box>"), F.lit(1)).alias("boxes")))


def rescale_caption(caption: Column, width: Column, height: Column, scale: int = 999) -> Column:
    """Every (x,y) of a caption in scale-ths of width and height; text around them stays."""
    pair = r"\(([0-9.]+),([0-9.]+)\)"
    pieces = F.split(caption, r"\([0-9.]+,[0-9.]+\)", -1)
    found = F.regexp_extract_all(caption, F.lit(pair), F.lit(0))
    number = lambda p, k: F.regexp_extract(p, pair, k).cast("double")
    said = F.transform(found, lambda p: F.format_string("(%03d,%03d)", rescale(number(p, 1), width, scale), rescale(number(p, 2), height, scale)))
    return F.array_join(F.transform(F.arrays_zip(pieces.alias("t"), said.alias("b")), lambda x: F.concat(x["t"], F.coalesce(x["b"], F.lit("")))), "")
