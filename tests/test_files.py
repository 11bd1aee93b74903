"""Numpy files and images, whole and broken."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pytest

from weftline.sources import arrays, images


def load(spark, path, **options):
    arrays.register(spark)
    return spark.read.format("npy").options(**options).load(str(path))


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<f2", "|i1", "<i2", ">i4", "<i8", "|u1", "<u2", "<u4", "|b1"])
@pytest.mark.parametrize("split", [1, 10**9])
def test_arrays_come_back(tmp_path, dtype, split):
    value = (np.arange(2 * 3 * 7) % 100).reshape(7, 3, 2).astype(dtype)
    np.save(tmp_path / "a.npy", value)
    options = {"path": str(tmp_path / "a.npy"), "splitbytes": str(split)}
    header = next(arrays.arrays_of(options))[3]
    reader = arrays.NumpyReader(options, header.value)
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == (7 if split == 1 else 1) and [r["row"] for r in rows] == list(range(7))
    assert np.array_equal(np.array([r["value"] for r in rows]).reshape(7, 3, 2), value.astype(dtype[1:].replace("b1", "?") if dtype != "|b1" else bool))


def test_folders_archives_and_scalars(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 8)).astype(np.float32), rng.random((3, 8)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    np.savez_compressed(tmp_path / "y.npz", first=y, second=y[:0], third=y + 1)
    got = {(r.file, r.member, r.row): r.value for r in load(spark, tmp_path, splitBytes=1000).collect()}
    want = {("x.npy", None, k): v.tolist() for k, v in enumerate(x)} | {("y.npz", f"{n}.npy", k): v.tolist() for n, a in (("first", y), ("third", y + 1)) for k, v in enumerate(a)}
    assert got == want
    np.save(tmp_path / "one.npy", np.arange(4))
    assert [r.value for r in load(spark, tmp_path / "one.npy").orderBy("row").collect()] == [0, 1, 2, 3]
    np.save(tmp_path / "none.npy", np.empty((0, 2)))
    assert load(spark, tmp_path / "none.npy").count() == 0


def npy(header: bytes, data: bytes = b"", version: bytes = b"\1\0") -> bytes:
    return b"\x93NUMPY" + version + struct.pack("<H", len(header)) + header + data


@pytest.mark.parametrize(
    ("content", "said"),
    [
        (b"", "no .npy file"), (b"PK nothing of the kind", "no .npy file"), (npy(b"{'descr': '<f4'")[:12], "within its header"), (npy(b"{'descr': '<f4', "), "doesn't parse"),
        (npy(b"{'descr': '|O', 'fortran_order': False, 'shape': (1,)}"), "pickled objects"), (npy(b"{'descr': '<c8', 'fortran_order': False, 'shape': (1,)}"), "isn't read"),
        (npy(b"{'descr': '<f4', 'fortran_order': True, 'shape': (2, 2)}", b"\0" * 16), "Fortran"), (npy(b"{'descr': '<f4', 'fortran_order': False, 'shape': ()}", b"\0" * 4), "no rows"),
        (npy(b"__import__('os').abort()"), "doesn't parse"),
    ],
)
def test_headers_that_are_refused(content, said):
    with pytest.raises(ValueError, match=said):
        arrays.header_of(io.BytesIO(content), "f")


def test_files_that_are_refused(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((100, 4), np.float32))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="its header says"):
        load(spark, tmp_path / "cut.npy").collect()
    np.save(tmp_path / "b.npy", np.zeros((100, 4)))
    with pytest.raises(Exception, match="holds array<double>"):
        load(spark, tmp_path / "[ab].npy").collect()


# --- images ---------------------------------------------------------------------------------------------


def png(pixels: np.ndarray, colour: int, filters=(0, 1, 2, 3, 4), palette: bytes | None = None, interlaced: int = 0) -> bytes:
    """A PNG whose rows take the filters in turn, encoded a byte at a time."""
    height, width, step = pixels.shape
    body, above = b"", [0] * (width * step)
    for y in range(height):
        row, kind = pixels[y].ravel().tolist(), filters[y % len(filters)]
        out = []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            best = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - (0, a, b, (a + b) // 2, best)[kind % 5]) % 256)
        body += bytes([kind, *out])
        above = row
    chunks = [(b"IHDR", struct.pack(">2I5B", width, height, 8, colour, 0, 0, interlaced))] + ([(b"PLTE", palette)] if palette else []) + [(b"IDAT", zlib.compress(body)[:9]), (b"IDAT", zlib.compress(body)[9:]), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in chunks)


@pytest.mark.parametrize(("colour", "channels"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(colour, channels):
    pixels = np.random.default_rng(colour).integers(0, 256, (11, 7, channels), dtype=np.uint8)
    assert np.array_equal(images.png_pixels(png(pixels, colour)), pixels[:, :, :1] if colour == 4 else pixels)
    smooth = (np.arange(11 * 7 * channels) // 3 % 256).astype(np.uint8).reshape(11, 7, channels)
    assert np.array_equal(images.png_pixels(png(smooth, colour, (4, 3))), smooth[:, :, :1] if colour == 4 else smooth)


def test_png_palette_and_what_is_broken():
    index = np.random.default_rng(3).integers(0, 3, (5, 6, 1), dtype=np.uint8)
    palette = bytes(range(9))
    assert np.array_equal(images.png_pixels(png(index, 3, palette=palette)), np.frombuffer(palette, np.uint8).reshape(3, 3)[index[:, :, 0]])
    good = png(index, 0)
    for bad in (b"", good[:20], good[:60], good.replace(b"IDAT", b"IDAX"), png(index, 0, interlaced=1), png(index, 0, filters=(9,)), png(index, 3), png(index, 3, palette=palette[:3]), good[:8] + good[33:]):
        with pytest.raises((ValueError, zlib.error)):
            images.png_pixels(bad)


def test_portable_maps():
    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    assert np.array_equal(images.map_pixels(b"P6\n# a comment\n3 2\n255\n" + rgb.tobytes()), rgb)
    assert images.map_pixels(b"P5 2 1 3\n" + bytes([1, 3])).ravel().tolist() == [85, 255]
    for bad in (b"P5 2 2 255\nabc", b"P3 1 1 255\n1", b"P5 0 2 255\n", b"P5 9999999 9999999 255\n"):
        with pytest.raises(ValueError):
            images.map_pixels(bad)


def test_the_chain(spark, tmp_path):
    """What Spark decodes, what only the decoders here do, and what none does; pixels are equal whichever decoded."""
    rgb = np.random.default_rng(2).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(rgb, 2))
    (tmp_path / "b.ppm").write_bytes(b"P6 5 6 255\n" + rgb.tobytes())
    (tmp_path / "c.png").write_bytes(png(rgb, 2)[:70])
    (tmp_path / "d.txt").write_bytes(b"x")
    got = {r.origin.rsplit("/", 1)[-1]: r for r in images.decoded(spark, str(tmp_path)).collect()}
    assert {k: (r.decoder, r.error is None) for k, r in got.items()} == {"a.png": ("spark", True), "b.ppm": ("map", True), "c.png": (None, False), "d.txt": (None, False)}
    assert got["a.png"].data == got["b.ppm"].data == rgb[:, :, ::-1].tobytes() and (got["b.ppm"].height, got["b.ppm"].width, got["b.ppm"].channels) == (6, 5, 3)
    assert got["c.png"].data is None and "png:" in got["c.png"].error
