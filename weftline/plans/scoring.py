"""The scoring boundary (G1-G14): models stay outside; a stub that needs none serves tests."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ModelAdapter(Protocol):
    """What the engine asks of a model, batch by batch: generated texts, or scores of options."""

    def generate_texts(self, prompts: list[str]) -> list[str]: ...

    def generate_scores(self, prompts: list[str], options: list[list[str]]) -> list[list[float]]: ...


class StubModel:
    """Deterministic: echoes a word of the prompt, scores options by a checksum."""

    def generate_texts(self, prompts: list[str]) -> list[str]:
        return [(p.split() or [""])[zlib.crc32(p.encode()) % max(1, len(p.split()))] for p in prompts]

    def generate_scores(self, prompts: list[str], options: list[list[str]]) -> list[list[float]]:
        return [[zlib.crc32(f"{p}|{o}".encode()) / 2**32 for o in opts] for p, opts in zip(prompts, options, strict=True)]


def generate(df: DataFrame, prompt: str, make: Callable[[], ModelAdapter] = StubModel) -> DataFrame:
    """df with `generated`; the model is made once a task."""
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(generated=model.generate_texts(frame[prompt].fillna("").tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) if schema else ""
    return df.mapInPandas(run, f"{fields}, generated string")


def score_options(df: DataFrame, prompt: str, options: str, make: Callable[[], ModelAdapter] = StubModel) -> DataFrame:
    """df with `scores`, one an option."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            yield frame.assign(scores=model.generate_scores(frame[prompt].tolist(), [list(o) for o in frame[options]]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, scores array<double>")


def evaluate(sources: Mapping[str, DataFrame], run: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(metric, value) over all sources, keys prefixed by the source's name (X11)."""
    out = None
    for name, df in sources.items():
        row = run[name](df)
        pairs = F.array(*[F.struct(F.lit(f"{name}_{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
        part = row.select(F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def evaluate_by(df: DataFrame, key: str, metrics: Mapping[str, Column]) -> DataFrame:
    """evaluate() where the sources are the values of a column: one grouped pass, whatever values there are; null is a source of that name."""
    rows = df.groupBy(key).agg(*[c.cast("double").alias(name) for name, c in metrics.items()])
    prefix = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return rows.select(F.inline(F.array(*[F.struct(F.concat(prefix, F.lit(f"_{name}")).alias("metric"), F.col(name).alias("value")) for name in metrics])))


def losses(tokens: DataFrame, logp: str, label: str, weight_text: float = 1.0) -> DataFrame:
    """Mean negative log-probability of the labels that count."""
    return tokens.where(F.col(label) != -100).agg((F.avg(-F.col(logp)) * weight_text).alias("loss"))


def image_losses(images: DataFrame, truth: str, predicted: str, context: str, mask: str | None = None) -> DataFrame:
    """One row, loss: the mean of the images' squared errors, those without a condition counting as nothing.

    truth, predicted: arrays; context: how many positions an image's condition has, of which two are its BOS and SOI, so that
    an image with no more has none; mask: a weight an image (null: 1).
    """
    squares = F.zip_with(truth, predicted, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    error = F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.size(truth)
    weight = (F.col(context) > 2).cast("double") * (F.coalesce(F.col(mask).cast("double"), F.lit(1.0)) if mask else F.lit(1.0))
    return images.agg(F.avg(error * weight).alias("loss"))


def total_loss(text: DataFrame, image: DataFrame | None = None, weight_text: float = 1.0, weight_image: float = 10.0) -> DataFrame:
    """One row (loss_txt, loss_img, loss) of one row of each: both weighed and added up; without images the text's alone."""
    both = text.select(F.col("loss").alias("loss_txt"))
    both = both.crossJoin(F.broadcast(image.select(F.col("loss").alias("loss_img")))) if image is not None else both.withColumn("loss_img", F.lit(None).cast("double"))  # one row each
    return both.withColumn("loss", F.coalesce("loss_txt", F.lit(0.0)) * weight_text + F.coalesce("loss_img", F.lit(0.0)) * weight_image)
