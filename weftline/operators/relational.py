"""Joins with integrity checks, dedup by order, facets, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import global_numbers


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order (the order should be total).

    Where the order is made of plain columns the row travels as one struct through a partial
    aggregation, so a hot key costs one row a task.
    """
    ranked = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, ranked).alias("_row")).select("_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in the given order."""
    ranked = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, ranked).alias("_row")).select("_row.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = True) -> DataFrame:
    """Inner join after the reference's assertions: unique keys (both sides, or the right one), no missing partner.

    The rules are checked by up to three jobs while the plan is built, each of which stops at the first row
    that breaks it, and ValueError says which rule broke.
    """
    for side, df in (("left", left), ("right", right)):
        if (side == "right" or one_to_one) and duplicate_keys(df, keys).limit(1).count():
            raise ValueError(f"keys {list(keys)} are not unique on the {side}")
    if left.join(right, list(keys), "left_anti").limit(1).count():
        raise ValueError("a left key has no partner")
    return left.join(right, list(keys))


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, in_left, in_right): keys of only one side; empty where the sets are equal."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    return both.where("in_left IS NULL OR in_right IS NULL").select(*keys, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def in_split(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def complete_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows whose key has exactly size rows."""
    whole = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == size).select(key)
    return df.join(whole, key, "left_semi")


def facet_filter(df: DataFrame, facets: Mapping[str, Sequence]) -> DataFrame:
    """Rows in every facet's list; an empty list asks for nothing."""
    test = F.lit(True)
    for column, wanted in facets.items():
        if wanted:
            test &= F.col(column).isin(list(wanted))
    return df.where(test)


def lookup(df: DataFrame, ids: Sequence, key: str) -> DataFrame:
    """Rows of the ids, with each id's place in the list as `pos`; an id asked for twice comes twice."""
    asked = df.sparkSession.createDataFrame([(k, v) for k, v in enumerate(ids)], f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(asked), key)  # the caller's own list


def multimap(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key -> values as an array in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.transform(pairs, lambda x: x["_v"]).alias("values"))


def decode_list(df: DataFrame, key: str, indexes: str, dictionary: DataFrame, index: str, text: str) -> DataFrame:
    """key, texts: an array of indexes as the array of their texts, order kept; unknown indexes give null."""
    long = df.select(key, F.posexplode_outer(indexes).alias("pos", "_ix"))
    told = long.join(dictionary.select(F.col(index).alias("_ix"), F.col(text).alias("_text")), "_ix", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "_text"))))
    return told.groupBy(key).agg(F.transform(pairs, lambda x: x["_text"]).alias("texts"))


def with_followers(df: DataFrame, item: str, followers: str, *keep: str) -> DataFrame:
    """keep, frames: the item and its followers in order."""
    return df.select(*keep, F.concat(F.array(F.col(item)), F.col(followers)).alias("frames"))


def unique_counts(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """value, first_pos (from 0), n, inverse (dense rank from 0) of the distinct values."""
    placed = global_numbers(df.select(value, *[o for o in order if o != value]), order, "pos")
    counts = placed.groupBy(value).agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))
    return global_numbers(counts, [value], "inverse")


def confident(df: DataFrame, column: str, least: float) -> DataFrame:
    """Rows at or over a confidence; a row without one counts as sure."""
    return df.where((F.col(column) >= least) | F.col(column).isNull())


def dense_join(dialogs: DataFrame, dense: DataFrame, key: str, round_id: str) -> DataFrame:
    """Dialogs with their dense annotation, many to one; those without one go, and one for no round of a dialog is an error.

    dialogs: key and `rounds`, an array; dense: one row a key, with the annotated round from 1 and whatever else.
    """
    joined = dialogs.join(dense, key)
    fits = F.col(round_id).between(1, F.size("rounds"))
    return joined.where(F.assert_true(fits, F.lit(f"{round_id} is outside its dialog")).isNull())
