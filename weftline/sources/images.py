"""Images as pixels, by a chain of decoders.

First Spark's own `image` source, which decodes what the Java platform can. What it gives up goes to decoders of uncompressed
images (portable pixel and grey maps) and of PNG, over Arrow batches; what these can't read either is a row without pixels
that says so. Pixels are as in Spark's source: rows from the top, in each the channels blue, green, red (alpha), or one of grey.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable

#: Pixels of the largest image that is decoded here; a header may say anything.
MOST_PIXELS = 1 << 28
#: Channels of PNG's colour types without a palette (fixed values).
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, channels) of an 8-bit PNG without interlacing; a palette is looked up; grey with alpha loses its alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, header, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"PNG chunk {kind!r} is broken")
        if kind == b"IHDR":
            header = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None or len(header) != 13:
        raise ValueError("PNG without a header")
    width, height, depth, colour, _, _, interlaced = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big"), *header[8:]
    if depth != 8 or interlaced or colour not in (*PNG_CHANNELS, 3) or (colour == 3 and palette is None):
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlacing {interlaced}")
    channels = PNG_CHANNELS.get(colour, 1)
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"PNG of {width} x {height} pixels")
    need = height * (width * channels + 1)
    raw = zlib.decompressobj().decompress(b"".join(packed), need)
    if len(raw) < need:
        raise ValueError("PNG ends before its last row")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    pixels = unfiltered(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise ValueError("PNG with an index beyond its palette")
        pixels = palette[pixels[:, :, 0]]
    return pixels[:, :, :1] if colour == 4 else pixels


def unfiltered(filters: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """The rows of a PNG without their filters: none, left, up, the mean of both, or the best of left, up and corner."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(filters.tolist(), rows, strict=True)):
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            out[y] = _by_pixel(kind, row.tolist(), above.tolist(), step)
        else:
            raise ValueError(f"PNG filter {kind}")
        above = out[y]
    return out


def _by_pixel(kind: int, row: list[int], above: list[int], step: int) -> list[int]:
    now = [0] * step + row
    for x in range(len(row)):
        left, up, corner = now[x], above[x], above[x - step] if x >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            # the neighbour nearest to left + up - corner; ties go to left, then up
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        now[x + step] = (row[x] + guess) & 255
    return now[step:]


_MAP = re.compile(rb"P([56])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)\s")


def map_pixels(data: bytes) -> np.ndarray:
    """(height, width, 1 or 3) of a binary portable grey or pixel map of 8 bits."""
    head = _MAP.match(data)
    if head is None:
        raise ValueError("no portable map")
    channels, width, height, most = 3 if head[1] == b"6" else 1, int(head[3]), int(head[5]), int(head[7])
    if not 0 < most < 256 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"map of {width} x {height} pixels up to {most}")
    pixels = np.frombuffer(data, np.uint8, offset=head.end())[: width * height * channels]
    if len(pixels) < width * height * channels:
        raise ValueError("map ends before its last row")
    scaled = pixels if most == 255 else (pixels.astype(np.uint32) * 255 // most).astype(np.uint8)
    return scaled.reshape(height, width, channels)


DECODERS: tuple[tuple[str, Callable[[bytes], np.ndarray]], ...] = (("map", map_pixels), ("png", png_pixels))


def pixels_of(data: bytes, decoders: Sequence[tuple[str, Callable[[bytes], np.ndarray]]] = DECODERS) -> tuple[str | None, np.ndarray | None, str | None]:
    """(decoder, pixels, what each decoder said against it)."""
    said = []
    for name, decode in decoders:
        try:
            return name, decode(data), None
        except (ValueError, zlib.error) as error:
            said.append(f"{name}: {error}")
    return None, None, "; ".join(said)


def fallen_back(files: DataFrame) -> DataFrame:
    """(origin, height, width, channels, data, decoder, error) of (path, content) by the decoders here."""
    schema = pa.schema([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("decoder", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):  # an image a batch: each may be large
                decoder, pixels, error = pixels_of(content.as_py() or b"")
                shape = (None, None, None) if pixels is None else pixels.shape
                data = None
                if pixels is not None:
                    order = [2, 1, 0, 3][: pixels.shape[2]] if pixels.shape[2] > 1 else [0]
                    data = np.ascontiguousarray(pixels[:, :, order]).tobytes()
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip((path.as_py(), *shape, data, decoder, error), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "origin string, height int, width int, channels int, data binary, decoder string, error string")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, channels, data, decoder, error) of every file of a folder; where no decoder can, data is null. Files without
    a byte have no row, as in all of Spark's sources.

    Files that Spark's source decodes are read once; the others are told by their names and read again, so only
    their bytes are shuffled where Spark finds a filter on names worth its while. Count errors for the log.
    """
    ensure_importable(spark)
    image = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    fine = F.coalesce(F.col("height") > 0, F.lit(False))
    own = image.where(fine).select("origin", "height", "width", F.col("nChannels").alias("channels"), "data", F.lit("spark").alias("decoder"), F.lit(None).cast("string").alias("error"))
    named = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("path")
    files = spark.read.format("binaryFile").load(path).select(named("path"), "content")
    rest = files.select("path").join(image.where(fine).select(named("origin")), "path", "left_anti")  # names alone
    return own.unionByName(fallen_back(files.join(rest, "path", "left_semi")))
