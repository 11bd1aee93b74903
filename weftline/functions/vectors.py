"""Vector expressions over array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double precision, in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """a over its length; null for the zero vector."""
    a = F.col(a) if isinstance(a, str) else a
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def sincos_embedding(pos: Column, dim: int) -> Column:
    """Sines, then cosines, of pos / 10000^(2i/dim)."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), lambda i: pos.cast("double") * F.pow(F.lit(10000.0), -i.cast("double") / F.lit(dim / 2.0)))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def quantise_pixel(x: Column) -> Column:
    """x in [0, 1] as a byte: times 255, rounded half up, clamped."""
    return F.least(F.greatest(F.floor(x * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")


def colour(index: Column, colours: int) -> dict[str, Column]:
    """b, g and r of one of so many colours: the index's digits in a base just over the cube root, taken off white."""
    base = int(colours ** (1 / 3)) + 1
    return {c: (255 - F.floor(index / base**k) % base * (255 // base)).cast("int") for k, c in enumerate("bgr")}
