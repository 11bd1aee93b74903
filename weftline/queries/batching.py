"""Packing by DataFrame and by SQL, and batches laid out by mode, on samples made from documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import BOS, EOS, IMAGE, PAD, SOI
from ..operators import collating, packing, table_functions
from ..tables import table
from .token_windows import _SAMPLES, _samples

LENGTH, N_IMAGE, MAX_IMAGES, FEW_SHOT = 128, 4, 4, 2


def _sums(packed: DataFrame) -> DataFrame:
    return packed.select("shard", "seq", F.size("ids").cast("long").alias("n"), "is_truncated", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


def pack_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples packed to 128 tokens and four images at most, cut by image (Q1-Q4)."""
    return _sums(packing.pack_images(_samples(spark, sf_dir), "shard", "ord", "ids", LENGTH, N_IMAGE, MAX_IMAGES, "image"))


def pack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cut by sample, few-shot boundaries off (Q2, Q3, Q5)."""
    return _sums(packing.pack_images(_samples(spark, sf_dir), "shard", "ord", "ids", LENGTH, N_IMAGE, MAX_IMAGES, "sample", few_shot=FEW_SHOT))


def _by_sql(spark: SparkSession, sf_dir: str, more: str) -> DataFrame:
    table_functions.register(spark)
    name = f"samples_{uuid.uuid4().hex}"
    _samples(spark, sf_dir).createOrReplaceTempView(name)
    call = f"pack_sequences(TABLE({name}), shard => 'shard', ord => 'ord', ids => 'ids', length => {LENGTH}, n_image => {N_IMAGE}, max_images => {MAX_IMAGES}, {more})"
    return _sums(spark.sql(f"SELECT * FROM {call}"))


def pack_images_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_images by the table function (Q1-Q4)."""
    return _by_sql(spark, sf_dir, "level => 'image'")


def pack_samples_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_samples by the table function (Q2, Q3, Q5)."""
    return _by_sql(spark, sf_dir, f"level => 'sample', few_shot => {FEW_SHOT}")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with an image for two documents of three, targets, and three options, as ids."""
    n = F.col("n_chars")
    run = lambda size, first: F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: (i + first).cast("long"))
    seen = F.col("doc_id") % 3 != 1
    image = F.when(seen, F.concat(F.array(F.lit(SOI).cast("long")), F.array_repeat(F.lit(IMAGE).cast("long"), 4))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 4).alias("shard"),
        "doc_id",
        F.concat(F.array(F.lit(BOS).cast("long")), image, run(n % 10 + 1, 100)).alias("prompt"),
        F.concat(run(n % 7 + 1, 200), F.array(F.lit(EOS).cast("long"))).alias("target"),
        F.when(seen, F.array(F.concat(F.lit("img"), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.array(*[run((n + k) % 3 + 1, 300 + k) for k in range(3)]).alias("options"),
    )


def _text(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _collated(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = packing.batches(_prompts(spark, sf_dir), "shard", "doc_id", 8, partial=True)
    negative = F.array(*[F.lit(t) for t in (SOI, *[IMAGE] * 4)])
    out = collating.collate(rows, ["shard", "batch"], "place", mode, negative=negative)
    return out.select(*[_text(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in out.schema.fields])


def collate_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches: prompts with their targets, labels that leave the prompt out (Q7, Q10, Q11)."""
    return _collated(spark, sf_dir, "train")


def collate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to generate texts from: prompts, padded on the left (Q11)."""
    return _collated(spark, sf_dir, "texts")


def collate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to generate images from: prompts, padded on the right, and the negative prompt (Q11)."""
    return _collated(spark, sf_dir, "images")


def collate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches to score options by: prompts, and all options at one width (Q11)."""
    return _collated(spark, sf_dir, "scores")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    pack_images, pack_samples, pack_images_sql, pack_samples_sql, collate_train, collate_texts, collate_images, collate_scores,
)}


def _packed_sql(level: str, few_shot: int) -> str:
    """A cut's end hangs on the window of `length` tokens after its start alone, so cuts are a recursion over starts."""
    k, m, length = N_IMAGE, MAX_IMAGES, LENGTH
    over = f"s[{m}] + {k}" if level == "image" else f"CASE WHEN list_max(list_filter(o, lambda x: x < s[{m + 1}])) > s[{m}] THEN list_max(list_filter(o, lambda x: x < s[{m + 1}])) - 1 ELSE s[{m + 1}] - 1 END"
    back = "ls - 1" if level == "image" else "CASE WHEN coalesce(list_max(list_filter(o, lambda x: x <= e0)), 0) > 1 THEN list_max(list_filter(o, lambda x: x <= e0)) - 1 ELSE ls - 1 END"
    step = f"""SELECT shard, t, p, s, o, e0, ls, back, ls - 1 >= e0 - {k} AS split, CASE WHEN ls - 1 >= e0 - {k} AND back > 0 THEN back ELSE e0 END AS e FROM (SELECT *, {back} AS back FROM (SELECT *, list_max(list_filter(s, lambda x: x <= e0)) AS ls FROM (
        SELECT *, CASE WHEN len(list_filter(w, lambda x: x = {IMAGE})) // {k} > {m} THEN {over} ELSE {length} END AS e0 FROM (
        SELECT *, list_filter(range(1, {length + 1}), lambda i: w[i] = {SOI}) AS s, list_filter(range(1, {length + 1}), lambda i: w[i] = {BOS}) AS o FROM (
        SELECT *, t[p + 1:p + {length}] AS w FROM %s WHERE last - p >= {length} OR len(t) - p = {length})))))"""
    kept = "u" if few_shot < 2 else f"list_filter(u, lambda x, i: NOT list_contains(d, i) AND NOT (x = {EOS} AND list_contains(d, i + 1)))"
    return f"""WITH RECURSIVE {_SAMPLES}, t AS (SELECT shard, flatten(list(ids ORDER BY ord)) AS t, CAST(sum(len(ids)) - arg_max(len(ids), ord) AS BIGINT) AS last FROM samples GROUP BY shard),
        c AS (SELECT shard, t, last, CAST(0 AS BIGINT) AS p FROM t UNION ALL SELECT c.shard, c.t, c.last, CAST(c.p + x.e AS BIGINT) FROM c JOIN ({step % "c"}) x ON c.shard = x.shard AND c.p = x.p),
        x AS (SELECT shard, p, CASE WHEN split THEN 1 ELSE 0 END AS is_truncated, t[p + 1:p + e] AS u FROM ({step % "c"})),
        y AS (SELECT shard, p, is_truncated, u, list_filter(list_filter(range(1, len(u) + 1), lambda i: u[i] = {BOS}), lambda b, i: (i - 1) % {max(few_shot, 1)} <> 0) AS d FROM x WHERE len(list_filter(u, lambda x: x = {IMAGE})) // {k} > 0),
        z AS (SELECT *, {kept} AS v FROM y)
        SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY p) - 1 AS seq, CAST(len(v) AS BIGINT) AS n, CAST(coalesce(is_truncated, 0) AS INT) AS is_truncated, CAST(list_sum(v) AS BIGINT) AS sum_ids FROM z"""


def _collate_sql(mode: str) -> str:
    run = lambda size, first: f"list_transform(range(1, {size} + 2), lambda i: CAST(i + {first} AS BIGINT))"
    left = mode in ("texts", "scores")
    fill = lambda what, value: (f"list_concat(list_transform(range(width - len({what})), lambda i: CAST({value} AS BIGINT)), {what})" if left else f"list_concat({what}, list_transform(range(width - len({what})), lambda i: CAST({value} AS BIGINT)))")
    joined = lambda c, where="": f"coalesce(string_agg(array_to_string({c}, ' '), ' ' ORDER BY place){where}, '')"
    more = ""
    if mode != "images":
        more += ", string_agg(CAST(len(prompt) AS VARCHAR), ' ' ORDER BY place) AS prompt_lengths"
    if mode == "train":
        more += f", {joined('labels')} AS labels"
    if mode == "images":
        more += f", '{SOI} {IMAGE} {IMAGE} {IMAGE} {IMAGE}' AS negative_ids"
    if mode == "scores":
        padded = lambda value, own: f"array_to_string(flatten(list_transform(options, lambda o: list_concat({own}, list_transform(range(owidth - len(o)), lambda i: CAST({value} AS BIGINT))))), ' ')"
        more += ", string_agg('3', ' ') AS options_per_row, CAST(any_value(owidth) AS INT) AS option_width"
        more += f", string_agg({padded(PAD, 'o')}, ' ' ORDER BY place) AS option_ids, string_agg({padded(0, 'list_transform(o, lambda x: CAST(1 AS BIGINT))')}, ' ' ORDER BY place) AS option_mask"
    has = " FILTER (WHERE doc_id % 3 <> 1)"
    return f"""WITH s AS (SELECT doc_id, doc_id % 4 AS shard, list_concat(list_concat([CAST({BOS} AS BIGINT)], CASE WHEN doc_id % 3 <> 1 THEN [CAST({SOI} AS BIGINT), {IMAGE}, {IMAGE}, {IMAGE}, {IMAGE}] ELSE [] END), {run("n_chars % 10", 100)}) AS prompt,
            list_concat({run("n_chars % 7", 200)}, [CAST({EOS} AS BIGINT)]) AS target, [{", ".join(run(f"(n_chars + {k}) % 3", 300 + k) for k in range(3))}] AS options FROM documents),
        b AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS rn, {"list_concat(prompt, target)" if mode == "train" else "prompt"} AS own FROM s),
        w AS (SELECT *, CAST(rn // 8 AS BIGINT) AS batch, rn % 8 AS place, max(len(own)) OVER (PARTITION BY shard, rn // 8) AS width, max(list_max(list_transform(options, lambda o: len(o)))) OVER (PARTITION BY shard, rn // 8) AS owidth,
            coalesce(sum(CASE WHEN doc_id % 3 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY shard, rn // 8 ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
        p AS (SELECT *, {fill("own", PAD)} AS m, {fill("list_transform(own, lambda x: CAST(1 AS BIGINT))", 0)} AS k, {fill("list_transform(own, lambda x, i: CASE WHEN i <= len(prompt) THEN -100 ELSE x END)", -100)} AS labels FROM w)
        SELECT shard, batch, CAST(count(*) AS INT) AS rows, CAST(any_value(width) AS INT) AS width, {joined("m")} AS ids, {joined("k")} AS mask, coalesce(string_agg('img' || doc_id, ' ' ORDER BY place){has}, '') AS images,
            string_agg(CASE WHEN doc_id % 3 <> 1 THEN '1' ELSE '0' END, ' ' ORDER BY place) AS images_per_row, string_agg(CAST(before AS VARCHAR), ' ' ORDER BY place) AS image_offsets,
            coalesce(string_agg(CAST(place AS VARCHAR), ' ' ORDER BY place){has}, '') AS image_rows, coalesce(string_agg(CAST(list_position(m, {SOI}) - 1 AS VARCHAR), ' ' ORDER BY place){has}, '') AS image_columns,
            coalesce(string_agg(CAST(list_position(m, {BOS}) - 1 AS VARCHAR), ' ' ORDER BY place){has}, '') AS image_bos, CAST({0 if left else 1} AS DOUBLE) AS loss_image_weight, CAST({0 if mode == "images" else 1} AS DOUBLE) AS loss_text_weight{more}
        FROM p GROUP BY shard, batch"""


ORACLE_SQL: dict[str, str] = {
    "pack_images": _packed_sql("image", 0),
    "pack_samples": _packed_sql("sample", FEW_SHOT),
    "pack_images_sql": _packed_sql("image", 0),
    "pack_samples_sql": _packed_sql("sample", FEW_SHOT),
} | {f"collate_{mode}": _collate_sql(mode) for mode in collating.MODES}
