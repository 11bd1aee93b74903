"""Ingestion on archives and records made from the tables, so that what comes out can be held against them."""

from __future__ import annotations

import io
import itertools
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import BOS, IMAGE, PAD, SOI
from ..functions.hashing import hash01, hash01_sql
from ..operators import packing
from ..operators.sequences import labels
from ..plans import scoring
from ..scratch import scratch_dir
from ..sources import shards, sinks
from ..tables import table
from . import batching
from .token_windows import _SAMPLES, _TOKENS, _samples, tokens


#: Conversations in an archive, on average.
ZIP_CONVERSATIONS = 200


def _zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of archives of conversations as JSON lines, written as files of their own, with one that is broken."""

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, turns in zip(frame["shard"], frame["turns"], strict=True):
                name, body = f"docs_shard_{shard}_v2.jsonl", io.BytesIO()
                lines = "\n".join(json.dumps({"conv_id": int(t["conv_id"]), "turn": int(t["turn"]), "text": t["text"]}) for t in turns)
                with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(name, lines)
                yield pd.DataFrame([(f"{name}.zip", body.getvalue() if shard >= 0 else b"not an archive")], columns=["name", "content"])

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = -(-conv.agg(F.count_distinct("conv_id")).first()[0] // ZIP_CONVERSATIONS) or 1
    turns = F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("turns")
    groups = conv.groupBy((F.col("conv_id") % n).cast("int").alias("shard")).agg(turns).unionByName(conv.limit(1).groupBy(F.lit(-1).alias("shard")).agg(turns))
    path = scratch_dir(spark)
    sinks.write_files(groups.mapInPandas(pack, "name string, content binary"), path, "name", "content")
    return shards.zipped_lines(spark, f"{path}/files")


def unpack_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of zipped shards; the broken archive gives none."""
    lines = _zipped(spark, sf_dir).where("value IS NOT NULL")
    record = F.from_json("value", "conv_id bigint, turn bigint, text string")
    return lines.select("shard", record.alias("r")).select("shard", "r.*")


def zip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that could not be read, counted."""
    return _zipped(spark, sf_dir).where("error IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n"))


#: Documents in an archive, on average.
TAR_DOCS = 50


def tar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of tar members by base name; a repeated extension begins the next (S3)."""

    def pack(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = itertools.chain.from_iterable(zip(f["shard"].tolist(), f["doc_id"].tolist(), strict=True) for f in frames)
        for shard, docs in itertools.groupby(rows, lambda r: r[0]):
            body = io.BytesIO()
            with tarfile.open(fileobj=body, mode="w") as archive:
                for _, d in docs:
                    for ext in ("txt", "json", "txt") if d % 5 == 0 else ("TXT", "json"):
                        data = f"{ext} {d}".encode()
                        info = tarfile.TarInfo(f"part/{d:09d}.{ext}")
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
                    archive.members.clear()  # it would hold every header
            yield pd.DataFrame([(f"{shard}.tar", body.getvalue())], columns=["name", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = -(-docs.count() // TAR_DOCS) or 1
    # documents stream through the sorted partition, so a task holds one archive
    groups = docs.select(F.floor(hash01("tar", F.col("doc_id")) * n).cast("int").alias("shard"), "doc_id").repartition("shard").sortWithinPartitions("shard", "doc_id")
    path = scratch_dir(spark)
    sinks.write_files(groups.mapInPandas(pack, "name string, content binary"), path, "name", "content")
    samples = shards.grouped_members(shards.tar_members(spark, f"{path}/files"))
    return samples.select("shard", "key", F.array_join(F.array_sort(F.map_keys("files")), ",").alias("files")).groupBy("shard", "key", "files").agg(F.count("*").alias("n"))


def caption_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that are a string or a list of strings, as one text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    one, many = F.to_json(F.struct(F.col("t").alias("caption"))), F.to_json(F.struct(F.array("t", F.lit("two")).alias("caption")))
    v = F.try_parse_json(F.when(F.col("doc_id") % 2 == 0, one).otherwise(many))
    as_list = F.try_variant_get(v, "$.caption", "array<string>")
    texts = F.coalesce(as_list, F.array(F.try_variant_get(v, "$.caption", "string")))
    return docs.select("doc_id", F.lower(F.array_join(texts, " ")).alias("caption"))


#: Documents that a shard's name stands for.
SHARD_DOCS = 100


def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that each source's brace pattern stands for."""

    def expand(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame.assign(name=[shards.expand_braces(p) for p in frame["pattern"]]).explode("name")
            yield names.assign(place=names.groupby("source").cumcount())[["source", "place", "name"]]

    last = F.floor((F.count("*") - 1) / SHARD_DOCS)
    patterns = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.format_string("{train,val}_{0..%d}_v2.jsonl", last).alias("pattern"))
    return patterns.mapInPandas(expand, "source string, place bigint, name string")


def scored_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the stub model to every user's turn."""
    prompts = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("USER: "), "text").alias("prompt"))
    return scoring.generate(prompts, "prompt").select("conv_id", "turn", "generated")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each language's documents under prefixed keys (X11)."""
    return scoring.evaluate_by(table(spark, sf_dir, "documents"), "lang", {"mean_chars": F.round(F.avg("n_chars"), 6), "n": F.count("*")})


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss over labels that count, of log-probabilities from a hash."""
    rows = labels(tokens(spark, sf_dir)).withColumn("logp", -hash01(19, F.col("seq"), F.col("pos")))
    return scoring.losses(rows, "logp", "label").select(F.round("loss", 9).alias("loss"))


def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token loss and that of images, each vector a prediction of the one after it, its label the length of its condition."""
    rows = labels(tokens(spark, sf_dir)).withColumn("logp", -hash01(19, F.col("seq"), F.col("pos")))
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", "label", F.col("embedding").alias("truth")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("predicted")), "vec_id")
    out = scoring.total_loss(scoring.losses(rows, "logp", "label"), scoring.image_losses(pairs, "truth", "predicted", "label"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def rank_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of ranks in the shape of the answer files (K3, M8)."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("caption"))
    return sinks.vqa_results(rows, vizwiz=True)


def pack_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that packing gives out against those that went in, a shard each (Q1-Q3)."""
    samples = _samples(spark, sf_dir)
    fed = samples.groupBy("shard").agg(F.sum(F.size("ids")).alias("fed"))
    out = packing.pack_images(samples, "shard", "ord", "ids", batching.LENGTH, batching.N_IMAGE, batching.MAX_IMAGES, "image").groupBy("shard").agg(F.sum(F.size("ids")).alias("packed"))
    return fed.join(out, "shard").select("shard", "fed", "packed", (F.col("fed") >= F.col("packed")).alias("no_more"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    unpack_zip, zip_errors, tar_groups, caption_union, shard_names, scored_rounds, metric_table, token_loss, weighted_loss, rank_gather, pack_conserved,
)}

ORACLE_SQL: dict[str, str] = {
    "unpack_zip": f"SELECT 'docs_shard_' || conv_id % (SELECT greatest(ceil(count(DISTINCT conv_id) / {ZIP_CONVERSATIONS}.0), 1)::INT FROM conversations) || '_v2.jsonl' AS shard, conv_id, turn, text FROM conversations",
    "zip_errors": "SELECT DISTINCT 'docs_shard_-1_v2.jsonl' AS shard, CAST(1 AS BIGINT) AS n FROM conversations",
    "tar_groups": f"""WITH d AS (SELECT doc_id, CAST(floor({hash01_sql("'tar'", "doc_id")} * (SELECT ceil(count(*) / {TAR_DOCS}.0) FROM documents)) AS INT) || '.tar' AS shard, 'part/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key FROM documents)
        SELECT shard, key, 'json,txt' AS files, CAST(1 AS BIGINT) AS n FROM d UNION ALL SELECT shard, key, 'txt', 1 FROM d WHERE doc_id % 5 = 0""",
    "caption_union": "SELECT doc_id, lower(text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' two' END) AS caption FROM documents",
    "shard_names": f"""WITH s AS (SELECT coalesce(source, 'none') AS source, (count(*) - 1) // {SHARD_DOCS} AS last FROM documents GROUP BY 1), n AS (SELECT *, unnest(range(0, last + 1)) AS k FROM s)
        SELECT source, CAST(k + i * (last + 1) AS BIGINT) AS place, p || '_' || k || '_v2.jsonl' AS name FROM n, (VALUES (0, 'train'), (1, 'val')) t(i, p)""",
    "metric_table": """SELECT coalesce(lang, 'null') || '_mean_chars' AS metric, round(avg(n_chars), 6) AS value FROM documents GROUP BY lang
        UNION ALL SELECT coalesce(lang, 'null') || '_n', CAST(count(*) AS DOUBLE) FROM documents GROUP BY lang""",
    "token_loss": f"""WITH {_TOKENS}, n AS (SELECT *, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM tokens)
        SELECT round(avg({hash01_sql('19', 'seq', 'pos')}), 9) AS loss FROM n WHERE NOT (nxt IS NULL OR nxt IN ({PAD}, {IMAGE}, {BOS}) OR (token = {BOS} AND nxt = {SOI}))""",
    "weighted_loss": f"""WITH {_TOKENS}, n AS (SELECT *, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM tokens)
        , t AS (SELECT avg({hash01_sql('19', 'seq', 'pos')}) AS t FROM n WHERE NOT (nxt IS NULL OR nxt IN ({PAD}, {IMAGE}, {BOS}) OR (token = {BOS} AND nxt = {SOI}))),
        i AS (SELECT avg(CASE WHEN a.label > 2 THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) / len(a.embedding) ELSE 0 END) AS i FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT round(t, 9) AS loss_txt, round(i, 9) AS loss_img, round(t + 10 * i, 9) AS loss FROM t, i""",
    "pack_conserved": f"""SELECT shard, fed, packed, fed >= packed AS no_more FROM (SELECT shard, CAST(sum(n) AS BIGINT) AS packed FROM ({batching.ORACLE_SQL["pack_images"]}) GROUP BY shard)
        JOIN (WITH {_SAMPLES} SELECT shard, CAST(sum(len(ids)) AS BIGINT) AS fed FROM samples GROUP BY shard) USING (shard)""",
    "rank_gather": "SELECT 'VizWiz_val_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.jpg' AS image, lang AS answer FROM documents",
}
