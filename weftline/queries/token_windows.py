"""Token-sequence analytics on events: a user is a sequence, a signup BOS, a purchase SOI, a click an image token."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import pad, pad_mask, trim_generated, truncate_keep_image
from ..functions.fixed_values import BOS, IMAGE, PAD, SOI
from ..operators import packing, sequences
from ..tables import table

_TOKEN = {"signup": BOS, "purchase": SOI, "click": IMAGE, "error": PAD}


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, token): events of a user in order of time; other types are text, by their id."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    token = F.lit(None).cast("long")
    for kind, value in _TOKEN.items():
        token = F.when(F.col("event_type") == kind, F.lit(value).cast("long")).otherwise(token)
    return sequences.number(events, "user_id", "ts", "event_id").select(F.col("user_id").alias("seq"), "pos", F.coalesce(token, 100 + F.col("event_id") % 1000).alias("token"))


def nearest_bos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.nearest_bos(tokens(spark, sf_dir))


def running_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.last_seen(tokens(spark, sf_dir))


def noimage_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.no_image_mask(tokens(spark, sf_dir)).select("seq", "pos", "no_image")


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.labels(tokens(spark, sf_dir), prompt=3, ignore_no_image=True).select("seq", "pos", "label")


def prev_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.previous_image(tokens(spark, sf_dir))


def visibility_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.visibility(tokens(spark, sf_dir))


def rel_image_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.relative_image_rank(sequences.visibility(tokens(spark, sf_dir)))


def seq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequence_stats(tokens(spark, sf_dir))


def slide20_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.sliding_stats(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return out.select("event_id", F.round("slide_avg", 6).alias("slide_avg"), "slide_max", "latest", "slide_median")


def ragged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("batch", F.col("conv_id") % 8)
    return sequences.offsets(counts, "batch", "conv_id", "n")


def position_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.position_ids(tokens(spark, sf_dir).withColumn("mask", (F.col("token") != PAD).cast("long"))).select("seq", "pos", "position_id")


def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.every_kth(table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", "ts"), "user_id", "ts", 3).select("user_id", "event_id")


def pack_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of 8 shards of users cut every 64 (Q1)."""
    rows = tokens(spark, sf_dir).withColumn("shard", F.col("seq") % 8)
    out = packing.pack_fixed(rows.withColumnRenamed("seq", "user"), "shard", ["user", "pos"], 64)
    return out.groupBy("shard", "seq").agg(F.sum("token").alias("sum_token"), F.count("*").alias("n"), F.sum(F.col("at") * F.col("token")).alias("weighted"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, ord, ids): a BOS, text, and for every third document an image of four tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    text = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 40 + 1).cast("int")), lambda i: (i + 100).cast("long"))
    image = F.when(F.col("doc_id") % 3 != 1, F.concat(F.array(F.lit(SOI).cast("long")), F.array_repeat(F.lit(IMAGE).cast("long"), 4))).otherwise(F.array().cast("array<bigint>"))
    return docs.select((F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("ord"), F.concat(F.array(F.lit(BOS).cast("long")), text, image, F.array(F.lit(2).cast("long"))).alias("ids"))


def next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source into bins of 5,000 characters by next fit (Q8)."""
    return packing.next_fit(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 5000)


def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in batches of 8, padded to the longest, left or right (Q6, Q7, Q11)."""
    rows = packing.batches(_samples(spark, sf_dir), "shard", "ord", 8)
    most = rows.groupBy("shard", "batch").agg(F.max(F.size("ids")).alias("most"))
    held = rows.join(most, ["shard", "batch"])
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return held.select("ord", "batch", text(pad(F.col("ids"), F.col("most"))).alias("right"), text(pad(F.col("ids"), F.col("most"), left=True)).alias("left"), text(pad_mask(F.col("ids"), F.col("most"))).alias("mask"))


def trunc_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples cut to 20 ids, a trailing image kept; and generated ids trimmed."""
    ids = F.col("ids")
    trimmed = trim_generated(ids, 4, force_image=True)
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return _samples(spark, sf_dir).select("ord", text(truncate_keep_image(ids, 20, 4)).alias("cut"), text(trimmed["ids"]).alias("trimmed"), trimmed["stopped"].alias("stopped"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    nearest_bos, running_last, noimage_mask, label_mask, prev_image, visibility_join, rel_image_rank, seq_stats, slide20_stats, ragged_offsets, position_ids, every_kth,
    pack_fixed, next_fit, batch_pad, trunc_tail,
)}

_TOKENS = f"""tokens AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _TOKEN.items())} ELSE 100 + event_id % 1000 END AS BIGINT) AS token FROM events)"""
_SEEN = f"""{_TOKENS}, seen AS (SELECT *, coalesce(max(CASE WHEN token = {BOS} THEN pos END) OVER w, -1) AS last_bos, coalesce(max(CASE WHEN token = {SOI} THEN pos END) OVER w, -1) AS last_soi
    FROM tokens WINDOW w AS (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
_NEAR = f"""{_SEEN}, near AS (SELECT * FROM (SELECT seq, pos, token, coalesce(max(CASE WHEN token = {BOS} THEN pos END) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearest_bos FROM tokens) WHERE token = {SOI}),
    images AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY pos) - 1 AS img, pos AS start, nearest_bos FROM near)"""
_VISIBLE = f"{_NEAR}, visible AS (SELECT t.seq, t.pos, i.img FROM seen t JOIN images i ON i.seq = t.seq AND i.start > t.last_bos AND i.start <= t.pos)"
_SAMPLES = f"""samples AS (SELECT doc_id % 4 AS shard, doc_id AS ord,
    list_concat(list_concat([CAST({BOS} AS BIGINT)], list_transform(range(1, n_chars % 40 + 2), lambda i: CAST(i + 100 AS BIGINT))), list_concat(CASE WHEN doc_id % 3 != 1 THEN [CAST({SOI} AS BIGINT), {IMAGE}, {IMAGE}, {IMAGE}, {IMAGE}] ELSE [] END, [CAST(2 AS BIGINT)])) AS ids FROM documents)"""
_TEXT = "array_to_string({}, ' ')"

ORACLE_SQL: dict[str, str] = {
    "nearest_bos": f"WITH {_NEAR} SELECT seq, pos, nearest_bos FROM near",
    "running_last": f"WITH {_SEEN} SELECT * FROM seen",
    "noimage_mask": f"WITH {_SEEN} SELECT seq, pos, last_soi < last_bos OR last_soi < 0 AS no_image FROM seen",
    "label_mask": f"""WITH {_SEEN}, n AS (SELECT *, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM seen)
        SELECT seq, pos, CAST(CASE WHEN nxt IS NULL OR nxt IN ({PAD}, {IMAGE}, {BOS}) OR (token = {BOS} AND nxt = {SOI}) OR pos + 1 < 3 OR last_soi < last_bos OR last_soi < 0 THEN -100 ELSE nxt END AS BIGINT) AS label FROM n""",
    "prev_image": f"WITH {_NEAR} SELECT seq, img, start, nearest_bos, CASE WHEN lag(start) OVER (PARTITION BY seq ORDER BY start) >= nearest_bos THEN img - 1 END AS previous FROM images",
    "visibility_join": f"WITH {_VISIBLE} SELECT * FROM visible",
    "rel_image_rank": f"WITH {_VISIBLE} SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY img DESC) AS rank FROM visible",
    "seq_stats": f"""WITH {_NEAR} SELECT t.seq, CAST(max(CASE WHEN pos = 0 AND token IN ({SOI}, {IMAGE}) THEN 1 ELSE 0 END) AS BIGINT) AS is_first_token_image,
        CAST(coalesce(any_value(u), 0) AS BIGINT) AS uncond_image_cnt, CAST(coalesce(any_value(c), 0) AS BIGINT) AS image_cnt
        FROM tokens t LEFT JOIN (SELECT seq, count(*) AS c, sum(CASE WHEN start - nearest_bos <= 1 THEN 1 ELSE 0 END) AS u FROM images GROUP BY 1) i USING (seq) GROUP BY t.seq""",
    "slide20_stats": """SELECT event_id, round(avg(value) OVER w, 6) AS slide_avg, max(value) OVER w AS slide_max, value AS latest, quantile_disc(value, 0.5) OVER w AS slide_median
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "ragged_offsets": """SELECT conv_id, n, batch, CAST(coalesce(sum(n) OVER (PARTITION BY batch ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM (SELECT conv_id, count(*) AS n, conv_id % 8 AS batch FROM conversations GROUP BY conv_id)""",
    "position_ids": f"""WITH {_TOKENS} SELECT seq, pos, CAST(CASE WHEN token = {PAD} THEN 1 ELSE sum(CASE WHEN token = {PAD} THEN 0 ELSE 1 END) OVER (PARTITION BY seq ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 END AS BIGINT) AS position_id FROM tokens""",
    "every_kth": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS rn FROM events WHERE event_type = 'signup') WHERE rn % 3 = 0",
    "pack_fixed": f"""WITH {_TOKENS}, r AS (SELECT seq % 8 AS shard, token, row_number() OVER (PARTITION BY seq % 8 ORDER BY seq, pos) - 1 AS rn FROM tokens)
        SELECT shard, CAST(rn // 64 AS BIGINT) AS seq, CAST(sum(token) AS BIGINT) AS sum_token, count(*) AS n, CAST(sum((rn % 64) * token) AS BIGINT) AS weighted FROM r GROUP BY shard, rn // 64 HAVING count(*) = 64""",
    "next_fit": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        f AS (SELECT source, doc_id, n_chars, k, CAST(0 AS BIGINT) AS bin, n_chars AS fill FROM d WHERE k = 1
              UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.k, CASE WHEN f.fill + d.n_chars > 5000 AND f.fill > 0 THEN f.bin + 1 ELSE f.bin END,
                               CASE WHEN f.fill + d.n_chars > 5000 AND f.fill > 0 THEN d.n_chars ELSE f.fill + d.n_chars END FROM f JOIN d ON d.source = f.source AND d.k = f.k + 1)
        SELECT source, doc_id, n_chars, bin FROM f""",
    "batch_pad": f"""WITH {_SAMPLES}, b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY ord) - 1) // 8 AS batch FROM samples),
        m AS (SELECT *, max(len(ids)) OVER (PARTITION BY shard, batch) AS most, count(*) OVER (PARTITION BY shard, batch) AS n FROM b)
        SELECT ord, CAST(batch AS BIGINT) AS batch, {_TEXT.format(f"list_concat(ids, list_transform(range(most - len(ids)), lambda i: CAST({PAD} AS BIGINT)))")} AS "right",
               {_TEXT.format(f"list_concat(list_transform(range(most - len(ids)), lambda i: CAST({PAD} AS BIGINT)), ids)")} AS "left",
               {_TEXT.format("list_concat(list_transform(ids, lambda i: 1), list_transform(range(most - len(ids)), lambda i: 0))")} AS mask FROM m WHERE n = 8""",
    "trunc_tail": f"""WITH {_SAMPLES}, t AS (SELECT ord, ids, list_slice(ids, 2, len(ids) - 1) AS body FROM samples)
        SELECT ord, {_TEXT.format("CASE WHEN len(ids) > 20 THEN list_concat(list_slice(ids, 1, 14), list_slice(ids, len(ids) - 5, len(ids))) ELSE ids END")} AS cut,
               {_TEXT.format(f"list_concat(CASE WHEN body[len(body)] = {SOI} THEN body ELSE list_concat(body, [CAST({SOI} AS BIGINT)]) END, [CAST({IMAGE} AS BIGINT), {IMAGE}, {IMAGE}, {IMAGE}])")} AS trimmed, true AS stopped FROM t""",
}
