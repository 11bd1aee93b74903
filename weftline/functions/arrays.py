"""Array expressions over token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import BOS, EOS, IMAGE, PAD, SOI


def dual_sort(keys: Column, values: Column) -> Column:
    """values in the order of keys, ties in their own order."""
    zipped = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), x["v"].alias("v")))
    return F.transform(F.array_sort(zipped), lambda x: x["v"])


def pad(ids: Column, length: Column, left: bool = False, value: int = PAD) -> Column:
    fill = F.array_repeat(F.lit(value).cast("long"), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pad_mask(ids: Column, length: Column, left: bool = False) -> Column:
    ones = F.transform(ids, lambda _: F.lit(1))
    zeros = F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def truncate_keep_image(ids: Column, length: int, n_image: int) -> Column:
    """At most length ids; where the last one is an image token, the trailing image (n_image + 2 ids) stays."""
    tail = n_image + 2
    over = F.size(ids) > length
    kept = F.concat(F.slice(ids, 1, max(length - tail, 0)), F.slice(ids, -tail, tail))
    return F.when(over & (F.element_at(ids, -1).isin(IMAGE, EOS)), kept).when(over, F.slice(ids, 1, length)).otherwise(ids)


def trim_generated(ids: Column, n_image: int, force_image: bool = False) -> Column:
    """struct<ids, stopped>: without a leading BOS and a trailing EOS (then stopped); an SOI at the end gets its image tokens."""
    body = F.when(F.get(ids, F.lit(0)) == BOS, F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))).otherwise(ids)
    stopped = F.coalesce(F.element_at(F.when(F.size(body) > 0, body), -1) == EOS, F.lit(False))
    cut = F.when(stopped, F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    last = F.element_at(F.when(F.size(cut) > 0, cut), -1)
    soi = F.array(F.lit(SOI).cast("long"))
    asked = F.when(F.coalesce(last != SOI, F.lit(True)), F.concat(cut, soi)).otherwise(cut) if force_image else cut
    more = F.when(F.element_at(F.when(F.size(asked) > 0, asked), -1) == SOI, F.concat(asked, F.array_repeat(F.lit(IMAGE).cast("long"), n_image))).otherwise(asked)
    return F.struct(more.alias("ids"), stopped.alias("stopped"))
