"""Sizes and crop windows of image transforms as columns: what is computed before a pixel is touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resized(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """(width, height) with the shorter side at `size`, the longer one in proportion, cut down to a whole number."""
    longer = lambda long, short: F.floor(F.lit(size) * long / short).cast("long")
    whole = F.lit(size).cast("long")
    return F.when(width <= height, whole).otherwise(longer(width, height)), F.when(height <= width, whole).otherwise(longer(height, width))


def center_window(width: Column, height: Column, size: int) -> tuple[Column, Column]:
    """(left, top) of a window of `size` in the middle; halves go to the even number, negative where the image is smaller."""
    middle = lambda side: F.bround((side - size) / 2.0, 0).cast("long")
    return middle(width), middle(height)


def _shrunk(width: Column, height: Column, size: Column) -> tuple[Column, Column]:
    """Halved while the shorter side is twice `size` or more, then scaled so that it is `size`, rounded half to even."""
    halvings = F.greatest(F.length(F.bin(F.floor(F.least(width, height) / size).cast("long"))) - 1, F.lit(0))
    w, h = (F.floor(side / F.pow(F.lit(2.0), halvings)) for side in (width, height))
    scale = size / F.least(w, h)
    return F.bround(w * scale, 0).cast("long"), F.bround(h * scale, 0).cast("long")


def center_crop(width: Column, height: Column, size: int) -> tuple[Column, Column, Column, Column]:
    """(new width, new height, left, top): shrunk to the size, then the middle window, cut toward zero."""
    w, h = _shrunk(width, height, F.lit(size))
    return w, h, F.floor((w - size) / 2).cast("long"), F.floor((h - size) / 2).cast("long")


def random_crop(width: Column, height: Column, size: int, draws: tuple[Column, Column, Column], least: float = 0.8, most: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """The same with the shorter side drawn between size / most and size / least and the window anywhere; draws in [0, 1)."""
    low, high = -(-size // most), -(-size // least)
    shorter = F.floor(draws[0] * (high + 1 - low)) + int(low)
    w, h = _shrunk(width, height, shorter)
    return w, h, F.floor(draws[1] * (w - size + 1)).cast("long"), F.floor(draws[2] * (h - size + 1)).cast("long")


def scaled(byte: Column, signed: bool) -> Column:
    """A byte as a number in [0, 1], or in [-1, 1]."""
    return byte / 127.5 - 1 if signed else byte / 255.0
