"""Batches from ragged samples, by mode: one row a batch, laid out as dense matrices with tables beside them (Q7, Q11).

A batch's ids are a matrix of rows of equal width, row after row in one array, padded on the side that the mode wants;
its images are one table for the whole batch, with a count and an offset for each row, and with the place of each image in the
matrix. Batches are bounded, so that a batch is built in one row by array functions in the JVM.

| mode | ids | padding | besides |
| --- | --- | --- | --- |
| train | prompt and target | right | labels: the target's ids, -100 elsewhere; prompt_lengths |
| texts | prompt | left | prompt_lengths |
| images | prompt | right | negative_ids: the prompt without a text |
| scores | prompt | left | options of all rows padded to one width, and how many a row has |

Null prompts, targets, images and options are empty. A row whose images aren't as many as its prompt has places for
fails the query. Loss weights are the mode's: texts have no image loss, images no text loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import pad, pad_mask
from ..functions.fixed_values import BOS, SOI

MODES = ("train", "texts", "images", "scores")
IGNORED = -100


def _positions(ids: Column, token: int) -> Column:
    return F.filter(F.transform(ids, lambda x, i: F.when(x == token, i)), lambda i: i.isNotNull())


def collate(
    samples: DataFrame, keys: list[str], place: str, mode: str, prompt: str = "prompt", target: str = "target", images: str = "images", options: str = "options", negative: Column | None = None
) -> DataFrame:
    """One row for each value of `keys`: the batch's samples, in the order of `place`, laid out for the mode.

    keys, rows, width, ids and mask (rows x width), images, images_per_row, image_offsets, image_rows, image_columns and
    image_bos (of each image: its row and column in the matrix and the column of the last BOS before it, or 0), loss weights,
    and what the mode adds. negative: the ids of an empty prompt (mode images).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    none = F.array().cast("array<bigint>")
    held = lambda c: F.coalesce(F.col(c).cast("array<bigint>"), none)
    ids = F.concat(held(prompt), held(target)) if mode == "train" else held(prompt)
    parts = {"place": F.col(place), "ids": ids, "prompt": F.size(held(prompt)), "images": F.coalesce(F.col(images), F.array().cast(samples.schema[images].dataType))}
    if mode == "scores":
        parts["options"] = F.coalesce(F.col(options).cast("array<array<bigint>>"), F.array().cast("array<array<bigint>>"))
    one = F.struct(*[c.alias(k) for k, c in parts.items()])
    grouped = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("r"))
    left = mode in ("texts", "scores")
    each = lambda f: F.transform("r", f)
    wide = grouped.withColumn("width", F.coalesce(F.array_max(each(lambda r: F.size(r["ids"]))), F.lit(0)))
    padded = wide.withColumn("m", each(lambda r: pad(r["ids"], F.col("width"), left=left)))
    counts = each(lambda r: F.size(r["images"]))
    # an image is where its SOI is
    spots = F.flatten(F.transform("m", lambda row, i: F.transform(_positions(row, SOI), lambda j: F.struct(i.alias("row"), j.alias("column"), F.coalesce(F.array_max(F.filter(_positions(row, BOS), lambda b: b < j)), F.lit(0)).alias("bos")))))
    fit = F.forall("r", lambda r: F.size(r["images"]) == F.size(_positions(r["ids"], SOI)))
    checked = padded.withColumn("spots", F.when(fit, spots).otherwise(F.raise_error(F.lit("a row's images aren't as many as its places for them"))))
    out = {
        "rows": F.size("r"),
        "width": F.col("width"),
        "ids": F.flatten("m"),
        "mask": F.flatten(each(lambda r: pad_mask(r["ids"], F.col("width"), left=left))),
        "images": F.flatten(each(lambda r: r["images"])),
        "images_per_row": counts,
        "image_offsets": F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x)),
        "image_rows": F.transform("spots", lambda s: s["row"]),
        "image_columns": F.transform("spots", lambda s: s["column"]),
        "image_bos": F.transform("spots", lambda s: s["bos"]),
        "loss_image_weight": F.lit(0.0 if mode in ("texts", "scores") else 1.0),
        "loss_text_weight": F.lit(0.0 if mode == "images" else 1.0),
    }
    if mode in ("train", "texts", "scores"):
        out["prompt_lengths"] = each(lambda r: r["prompt"])
    if mode == "train":
        label = lambda r: F.transform(r["ids"], lambda x, i: F.when(i < r["prompt"], F.lit(IGNORED)).otherwise(x))
        out["labels"] = F.flatten(each(lambda r: pad(label(r), F.col("width"), value=IGNORED)))
    if mode == "images":
        out["negative_ids"] = (negative if negative is not None else none).cast("array<bigint>")
    if mode == "scores":
        width = F.coalesce(F.array_max(F.flatten(each(lambda r: F.transform(r["options"], F.size)))), F.lit(0))
        flat = F.flatten(each(lambda r: r["options"]))
        out |= {
            "options_per_row": each(lambda r: F.size(r["options"])),
            "option_width": width,
            "option_ids": F.flatten(F.transform(flat, lambda o: pad(o, width))),
            "option_mask": F.flatten(F.transform(flat, lambda o: pad_mask(o, width))),
        }
    return checked.select(*keys, *[c.alias(k) for k, c in out.items()])
