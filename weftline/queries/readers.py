"""Readers and joins of annotation files, on files written from the tables, and image arithmetic."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resolution
from ..functions.fixed_values import IMAGE
from ..functions.hashing import hash01, hash01_sql
from ..functions.vectors import quantise_pixel
from ..operators import relational, sequences
from ..scratch import scratch_dir
from ..session import ensure_importable
from ..sources import arrays, images, registry, shards, sinks
from ..tables import table
from .token_windows import _TOKENS, tokens


def _one_line(df: DataFrame) -> DataFrame:
    """A small table as a JSON array in one row."""
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("value"))


def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as JSON lines, a broken one after each conversation's first."""
    path = scratch_dir(spark)
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    table(spark, sf_dir, "conversations").select(F.explode(F.when(F.col("turn") == 0, F.array(line, F.lit('{"conv_id": 1, "tu'))).otherwise(F.array(line)))).write.text(path)
    return shards.json_lines(spark, path, "conv_id bigint, turn bigint, text string").drop("shard")


def json_object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member of a JSON object, as rows."""
    path = scratch_dir(spark)
    _one_line(table(spark, sf_dir, "nation")).select(F.concat(F.lit('{"info": {"v": 1}, "annotations": '), "value", F.lit("}"))).write.text(path)
    return shards.json_member(spark, path, "annotations", "struct<n_nationkey:int,n_name:string,n_regionkey:int>")


def json_mixed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and lines told apart by extension; rows without an image go."""
    root = scratch_dir(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("image"))
    _one_line(rows.where("id < 10")).write.text(f"{root}/a.json")
    rows.where("id >= 10").select(F.to_json(F.struct("id", "image"))).write.text(f"{root}/b.jsonl")
    return shards.json_or_lines(spark, [f"{root}/a.json", f"{root}/b.jsonl"], "id int, image string")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one extension in a folder, with their bytes."""
    path = scratch_dir(spark)
    table(spark, sf_dir, "nation").repartition(5, "n_regionkey").select(F.col("n_name")).write.text(path)
    found = shards.images(spark, path, ("txt", "log"))
    return found.select(F.explode(F.split(F.trim(F.col("content").cast("string")), "\n")).alias("n_name")).where("n_name != ''")


def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated and true image of each row, as read for scoring."""
    path = scratch_dir(spark)
    rows = table(spark, sf_dir, "nation").select(F.format_string("%05d.png", "n_nationkey").alias("image_path"), F.concat("n_name", F.lit(".jpg")).alias("image_gt_path"), F.lower("n_name").alias("caption"))
    _one_line(rows).write.text(path)
    return registry.build(spark, {"name": "image_pairs", "annt_file": path}).drop("pair")


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three evaluations appended to one log (K5)."""
    path, n = scratch_dir(spark), table(spark, sf_dir, "nation").count()
    for step in (1, 2, 3):
        sinks.append_metrics(spark, path, {"n": n * step, "half": n / 2}, step, step / 7)
    rows = spark.read.schema("metrics map<string,double>, step int, epoch double").json(path)
    return rows.select("step", "epoch", F.explode("metrics").alias("metric", "value"))


def confident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sure enough, those without a confidence too; the filter reaches the scan."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("confidence"))
    return relational.confident(rows, "confidence", 0.05)


def dense_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogs with the round that has relevance judgements, its question and what was said before."""
    turns = table(spark, sf_dir, "conversations")
    dialogs = relational.multimap(turns, "conv_id", "text", ["turn"]).withColumnRenamed("values", "rounds")
    dense = turns.where("role = 'assistant'").groupBy("conv_id").agg((F.max("turn") + 1).alias("round_id"), (F.count("*") / 10.0).alias("relevance"))
    joined = relational.dense_join(dialogs, dense, "conv_id", "round_id")
    return joined.select("conv_id", "round_id", "relevance", F.get("rounds", F.col("round_id").cast("int") - 1).alias("question"), F.array_join(F.slice("rounds", F.lit(1), F.col("round_id").cast("int") - 1), " | ").alias("before"))


def scattered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors at the image tokens of their sequence, in order."""
    features = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50 + 1).alias("seq"), F.floor(F.col("vec_id") / 50).alias("slot"), "embedding")
    out = sequences.scatter(tokens(spark, sf_dir), features, IMAGE)
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return out.select("seq", "pos", "token", "slot", first.alias("first"))


def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and windows of every transform on images of an order's size."""
    w, h = F.col("o_custkey") % 1500 + 200, F.col("o_orderkey") % 1100 + 180
    columns = {"resize": resolution.resized(w, h, 256), "window": resolution.center_window(w, h, 224), "center": resolution.center_crop(w, h, 256),
               "random": resolution.random_crop(w, h, 256, tuple(hash01(k, F.col("o_orderkey")) for k in (1, 2, 3)))}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(f"{name}_{k}") for name, cs in columns.items() for k, c in enumerate(cs)])


def _npy(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of a file as the bytes of a numpy array, even files on their own and odd ones in an archive."""
    for frame in frames:
        out = []
        for k, rows in zip(frame["k"], frame["rows"], strict=True):
            body, array = io.BytesIO(), np.array([r["embedding"] for r in rows], np.float32)
            if k % 2:
                np.savez_compressed(body, vectors=array)
            else:
                np.save(body, array)
            out.append((f"v{k}.npz" if k % 2 else f"v{k}.npy", body.getvalue()))
        yield pd.DataFrame(out, columns=["name", "content"])


def npy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as numpy files and read in ranges of rows."""
    path = scratch_dir(spark)
    files = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 8).alias("k")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    sinks.write_files(files.mapInPandas(_npy, "name string, content binary"), path, "name", "content")
    ensure_importable(spark)
    arrays.register(spark)
    read = spark.read.format("npy").option("splitBytes", 8_192).load(f"{path}/files")
    value = F.transform("value", lambda x: x.cast("double"))
    return read.select("file", "member", "row", F.size("value").alias("n"), F.round(F.aggregate(value, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


#: Vectors whose entries are the rows of one image.
IMAGE_ROWS = 64


def _drawn(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Grey images of byte rows: PNG, a portable map, and a PNG that is cut short, in turn; rows of a PNG are filtered in turn as well."""
    for frame in frames:
        out = []
        for k, rows in zip(frame["k"], frame["rows"], strict=True):
            pixels = np.array([r["levels"] for r in rows], np.uint8)
            if k % 3 == 1:
                out.append((f"i{k}.pgm", b"P5\n# grey\n%d %d\n255\n" % pixels.shape[::-1] + pixels.tobytes()))
                continue
            above = np.vstack([np.zeros_like(pixels[:1]), pixels[:-1]])
            body = b"".join(b"\2" + (row - up).tobytes() if y % 2 else b"\0" + row.tobytes() for y, (row, up) in enumerate(zip(pixels, above, strict=True)))
            chunks = ((b"IHDR", struct.pack(">2I5B", *pixels.shape[::-1], 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(body)), (b"IEND", b""))
            png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in chunks)
            out.append((f"i{k}.png", png if k % 3 == 0 else png[: len(png) // 2]))
        yield pd.DataFrame(out, columns=["name", "content"])


def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from vectors and decoded: by Spark, by the decoder of portable maps, or by none."""
    path = scratch_dir(spark)
    levels = F.transform("embedding", lambda x: quantise_pixel((x.cast("double") + 1) / 2))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / IMAGE_ROWS).alias("k"), "vec_id", levels.alias("levels"))
    drawn = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("vec_id", "levels"))).alias("rows")).mapInPandas(_drawn, "name string, content binary")
    sinks.write_files(drawn, path, "name", "content")
    out = images.decoded(spark, f"{path}/files")
    return out.select(F.regexp_extract("origin", "([^/]+)$", 1).alias("name"), "height", "width", "channels", F.when(F.col("data").isNotNull(), F.lower(F.hex("data"))).alias("pixels"), F.col("error").isNotNull().alias("broken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    npy_rows, decoded_images, json_lines_scan, json_object_scan, json_mixed_scan, listed_files, image_pairs, metrics_log, confident_rows, dense_dialogs, scattered_features, crop_windows,
)}

_SHRUNK = """greatest(length(bin(CAST(floor(least(w, h) / {s}) AS BIGINT))) - 1, 0)"""
ORACLE_SQL: dict[str, str] = {
    "npy_rows": """SELECT 'v' || vec_id % 8 || CASE WHEN vec_id % 2 = 1 THEN '.npz' ELSE '.npy' END AS file, CASE WHEN vec_id % 2 = 1 THEN 'vectors.npy' END AS member, row_number() OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) - 1 AS row,
        CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""",
    "decoded_images": f"""WITH v AS (SELECT vec_id // {IMAGE_ROWS} AS k, vec_id, array_to_string(list_transform(embedding, lambda x: lpad(lower(to_hex(CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1) / 2 * 255 + 0.5), 0), 255) AS INT))), 2, '0')), '') AS p, len(embedding) AS w FROM embeddings),
        i AS (SELECT k, CAST(count(*) AS INT) AS height, CAST(max(w) AS INT) AS width, string_agg(p, '' ORDER BY vec_id) AS pixels FROM v GROUP BY k)
        SELECT 'i' || k || CASE WHEN k % 3 = 1 THEN '.pgm' ELSE '.png' END AS name, CASE WHEN k % 3 <> 2 THEN height END AS height, CASE WHEN k % 3 <> 2 THEN width END AS width, CASE WHEN k % 3 <> 2 THEN 1 END AS channels,
            CASE WHEN k % 3 <> 2 THEN pixels END AS pixels, k % 3 = 2 AS broken FROM i""",
    "json_lines_scan": "SELECT conv_id, turn, text FROM conversations",
    "json_object_scan": "SELECT * FROM nation",
    "json_mixed_scan": "SELECT n_nationkey AS id, n_name AS image FROM nation WHERE n_regionkey > 0",
    "listed_files": "SELECT n_name FROM nation",
    "image_pairs": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') || '.png' AS image_path, n_name || '.jpg' AS image_gt_path, lower(n_name) AS caption FROM nation",
    "metrics_log": """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nation), s AS (SELECT CAST(i AS INT) AS step, round(i / 7.0, 2)::DOUBLE AS epoch FROM range(1, 4) t(i))
        SELECT step, epoch, 'n' AS metric, n * step AS value FROM s, n UNION ALL SELECT step, epoch, 'half', n / 2 FROM s, n""",
    "confident_rows": "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS confidence FROM lineitem WHERE l_discount >= 0.05 OR l_discount IS NULL",
    "dense_dialogs": """WITH d AS (SELECT conv_id, list(text ORDER BY turn) AS r, max(turn) FILTER (role = 'assistant') + 1 AS round_id, count(*) FILTER (role = 'assistant') / 10.0::DOUBLE AS relevance FROM conversations GROUP BY conv_id)
        SELECT conv_id, round_id, relevance, r[round_id] AS question, coalesce(array_to_string(r[1:round_id - 1], ' | '), '') AS before FROM d WHERE round_id IS NOT NULL""",
    "scattered_features": f"""WITH {_TOKENS}, i AS (SELECT seq, pos, token, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS slot FROM tokens WHERE token = {IMAGE})
        SELECT i.seq, pos, token, slot, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM i LEFT JOIN embeddings e ON e.vec_id % 50 + 1 = i.seq AND e.vec_id // 50 = slot""",
    "crop_windows": f"""WITH o AS (SELECT o_orderkey, o_custkey % 1500 + 200 AS w, o_orderkey % 1100 + 180 AS h, CAST(floor({hash01_sql('1', 'o_orderkey')} * 65) AS BIGINT) + 256 AS s,
            {hash01_sql('2', 'o_orderkey')} AS u, {hash01_sql('3', 'o_orderkey')} AS v FROM orders),
        k AS (SELECT *, {_SHRUNK.format(s='256')} AS kc, {_SHRUNK.format(s='s')} AS kr FROM o),
        f AS (SELECT *, floor(w / pow(2.0, kc)) AS wc, floor(h / pow(2.0, kc)) AS hc, floor(w / pow(2.0, kr)) AS wr, floor(h / pow(2.0, kr)) AS hr FROM k),
        z AS (SELECT *, CAST(round_even(wc * (256 / least(wc, hc)), 0) AS BIGINT) AS cw, CAST(round_even(hc * (256 / least(wc, hc)), 0) AS BIGINT) AS ch, CAST(round_even(wr * (s / least(wr, hr)), 0) AS BIGINT) AS rw, CAST(round_even(hr * (s / least(wr, hr)), 0) AS BIGINT) AS rh FROM f)
        SELECT o_orderkey, CASE WHEN w <= h THEN 256 ELSE CAST(floor(256 * w / h) AS BIGINT) END AS resize_0, CASE WHEN h <= w THEN 256 ELSE CAST(floor(256 * h / w) AS BIGINT) END AS resize_1,
            CAST(round_even((w - 224) / 2.0, 0) AS BIGINT) AS window_0, CAST(round_even((h - 224) / 2.0, 0) AS BIGINT) AS window_1, cw AS center_0, ch AS center_1, CAST(floor((cw - 256) / 2) AS BIGINT) AS center_2, CAST(floor((ch - 256) / 2) AS BIGINT) AS center_3,
            rw AS random_0, rh AS random_1, CAST(floor(u * (rw - 256 + 1)) AS BIGINT) AS random_2, CAST(floor(v * (rh - 256 + 1)) AS BIGINT) AS random_3 FROM z""",
}
