"""Window operators over token sequences in long form: one row a token, ordered by `pos` within `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.fixed_values import BOS, IMAGE, PAD, SOI


def _by(seq: str, pos: str) -> W:
    return W.partitionBy(seq).orderBy(pos)


def _at(token: str, value: int, pos: str) -> Column:
    return F.when(F.col(token) == value, F.col(pos))


def number(df: DataFrame, seq: str, *order: str) -> DataFrame:
    """df with `pos`, from 0 within seq."""
    return df.withColumn("pos", (F.row_number().over(W.partitionBy(seq).orderBy(*order)) - 1).cast("long"))


def nearest_bos(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """For each SOI the last BOS strictly before it, else 0."""
    before = _by(seq, pos).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("nearest_bos", F.coalesce(F.max(_at(token, BOS, pos)).over(before), F.lit(0).cast("long"))).where(F.col(token) == SOI).select(seq, pos, "nearest_bos")


def last_seen(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """df with last_bos and last_soi, this row included, -1 for none so far."""
    upto = _by(seq, pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({n: F.coalesce(F.max(_at(token, t, pos)).over(upto), F.lit(-1).cast("long")) for n, t in (("last_bos", BOS), ("last_soi", SOI))})


def no_image_mask(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """df with no_image: no SOI so far, or none since the last BOS."""
    return last_seen(df, seq, pos, token).withColumn("no_image", (F.col("last_soi") < F.col("last_bos")) | (F.col("last_soi") < 0))


def labels(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token", prompt: int = 0, ignore_no_image: bool = False) -> DataFrame:
    """df with label: the next token, -100 where it is padding, an image token, within the prompt, BOS, or SOI after BOS."""
    nxt = F.lead(token, 1).over(_by(seq, pos))
    masked = nxt.isin(PAD, IMAGE, BOS) | ((F.col(token) == BOS) & (nxt == SOI)) | (F.col(pos) + 1 < prompt)
    out = no_image_mask(df, seq, pos, token)
    if ignore_no_image:
        masked |= F.col("no_image")
    return out.withColumn("label", F.when(nxt.isNull() | masked, F.lit(-100).cast("long")).otherwise(nxt.cast("long")))


def images(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """(seq, img, start, nearest_bos): images in order, img from 0."""
    rows = nearest_bos(df, seq, pos, token)
    return rows.select(seq, (F.row_number().over(_by(seq, pos)) - 1).cast("long").alias("img"), F.col(pos).alias("start"), "nearest_bos")


def previous_image(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """Each image's directly preceding one, if that starts at or after the image's BOS."""
    own = W.partitionBy(seq).orderBy("start")
    last = F.lag("start", 1).over(own)
    return images(df, seq, pos, token).withColumn("previous", F.when(last >= F.col("nearest_bos"), F.col("img") - 1))


def visibility(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """(seq, pos, img): images that a token sees, those since the last BOS up to itself.

    An equi-join on the sequence with a range condition; a sequence is bounded by the packed length.
    """
    tokens = last_seen(df, seq, pos, token).select(seq, pos, "last_bos")
    return tokens.join(images(df, seq, pos, token).select(seq, "img", "start"), seq).where(f"start > last_bos AND start <= {pos}").select(seq, pos, "img")


def relative_image_rank(visible: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """visible with rank: the latest visible image is 1."""
    return visible.withColumn("rank", F.row_number().over(W.partitionBy(seq, pos).orderBy(F.desc("img"))).cast("long"))


def sequence_stats(df: DataFrame, seq: str = "seq", pos: str = "pos", token: str = "token") -> DataFrame:
    """(seq, is_first_token_image, uncond_image_cnt, image_cnt)."""
    near = images(df, seq, pos, token)
    counts = near.groupBy(seq).agg(F.sum((F.col("start") - F.col("nearest_bos") <= 1).cast("long")).alias("uncond_image_cnt"), F.count("*").alias("image_cnt"))
    first = df.groupBy(seq).agg(F.max(((F.col(pos) == 0) & F.col(token).isin(SOI, IMAGE)).cast("long")).alias("is_first_token_image"))
    return first.join(counts, seq, "left").select(seq, "is_first_token_image", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("uncond_image_cnt", "image_cnt")])


def sliding_stats(df: DataFrame, seq: str, order: str, value: str, width: int = 20) -> DataFrame:
    """df with mean, max, latest and lower median of the last width values."""
    span = W.partitionBy(seq).orderBy(order).rowsBetween(-(width - 1), 0)
    seen = F.sort_array(F.collect_list(value).over(span))
    return df.withColumns({
        "slide_avg": F.avg(value).over(span), "slide_max": F.max(value).over(span), "latest": F.last(value).over(span),
        "slide_median": F.element_at(seen, F.floor((F.size(seen) - 1) / 2).cast("int") + 1),
    })


def offsets(df: DataFrame, group: str, order: str, n: str) -> DataFrame:
    """df with `offset`: the sum of n before the row."""
    before = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))


def position_ids(df: DataFrame, seq: str = "seq", pos: str = "pos", mask: str = "mask") -> DataFrame:
    """df with position_id: cumulative mask less one; 1 where the mask is 0."""
    upto = _by(seq, pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("position_id", F.when(F.col(mask) == 0, F.lit(1)).otherwise(F.sum(mask).over(upto) - 1).cast("long"))


def every_kth(df: DataFrame, seq: str, order: str, k: int) -> DataFrame:
    """Rows 0, k, 2k, ... of a sequence."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(seq).orderBy(order)) - 1).where(F.col("_rn") % k == 0).drop("_rn")


def chunks(df: DataFrame, seq: str, k: int, *order: str, whole_only: bool = True) -> DataFrame:
    """df with chunk and place: consecutive k rows of a sequence; incomplete chunks go."""
    rows = df.withColumn("_rn", F.row_number().over(W.partitionBy(seq).orderBy(*order)) - 1)
    out = rows.withColumns({"chunk": F.floor(F.col("_rn") / k).cast("long"), "place": (F.col("_rn") % k).cast("long")}).drop("_rn")
    if not whole_only:
        return out
    return out.withColumn("_n", F.count("*").over(W.partitionBy(seq, "chunk"))).where(F.col("_n") == k).drop("_n")


def prefixes(df: DataFrame, seq: str, items: Column) -> DataFrame:
    """(seq, length, prefix): the first 1 to n - 1 items, never all."""
    held = df.select(seq, items.alias("_items")).where(F.size("_items") > 1)
    return held.select(seq, "_items", F.explode(F.sequence(F.lit(1), F.size("_items") - 1)).alias("length")).select(seq, F.col("length").cast("long").alias("length"), F.slice("_items", F.lit(1), F.col("length")).alias("prefix"))


def scatter(tokens: DataFrame, features: DataFrame, mark: int) -> DataFrame:
    """The image tokens of (seq, pos, token) with slot and features: the k-th one of a sequence takes row k of its features.

    features: (seq, slot from 0, ...); a token beyond its sequence's features gets nulls.
    """
    marked = tokens.where(F.col("token") == mark)
    placed = marked.withColumn("slot", (F.row_number().over(W.partitionBy("seq").orderBy("pos")) - 1).cast("long"))
    return placed.join(features.withColumn("slot", F.col("slot").cast("long")), ["seq", "slot"], "left")
