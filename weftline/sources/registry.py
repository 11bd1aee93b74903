"""Sources by name (S14): one configuration, one DataFrame; unknown names are refused."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, sampling
from . import shards

Config = Mapping[str, Any]
SOURCES: dict[str, Callable[[SparkSession, Config], DataFrame]] = {}


def source(*names: str) -> Callable:
    def add(build: Callable[[SparkSession, Config], DataFrame]) -> Callable[[SparkSession, Config], DataFrame]:
        SOURCES.update(dict.fromkeys(names, build))
        return build

    return add


def build(spark: SparkSession, config: Config) -> DataFrame:
    """The source that config['name'] names, cut to total_length rows where that is given."""
    if config["name"] not in SOURCES:
        raise NotImplementedError(f"no such source: {config['name']}")
    out = SOURCES[config["name"]](spark, config)
    return out.limit(config["total_length"]) if config.get("total_length") else out


@source("mmc4_wds")
def interleaved(spark: SparkSession, config: Config) -> DataFrame:
    """Zipped shards; images under the similarity threshold go, then documents with too few."""
    docs = shards.interleaved(spark, shards.expand_braces(config["annt_root"].rstrip("/") + "/" + config["input_shards"] + ".zip"))
    least = config.get("sim_threshold", 0.24)
    kept = docs.withColumn("image_info", F.filter("image_info", lambda x: x["matched_sim"] >= least))
    return kept.where(F.size("image_info") >= max(1, config.get("min_num_images", 1)))


@source("laion_wds", "coco_karpathy")
def pairs(spark: SparkSession, config: Config) -> DataFrame:
    return shards.captions(spark, shards.expand_braces(config["input_shards"]))


@source("coco", "lncoco", "image2paragraph")
def annotations(spark: SparkSession, config: Config) -> DataFrame:
    """COCO-style annotations; one caption an image where dedup is asked for."""
    rows = shards.json_member(spark, config["annt_file"], "annotations", "struct<image_id:bigint,caption:string>") if not config["annt_file"].endswith(".jsonl") else shards.json_lines(spark, config["annt_file"], "image_id bigint, caption string").drop("shard")
    if config["name"] == "image2paragraph":
        return relational.keep_last(rows, ["image_id"], ["caption"])
    return relational.keep_first(rows, ["image_id"], ["caption"]) if config.get("dedup_image") else rows


@source("nocaps", "flickr30k")
def captioned_images(spark: SparkSession, config: Config) -> DataFrame:
    """Annotations with their image's file, each image known."""
    images = shards.json_member(spark, config["annt_file"], "images", "struct<id:bigint,file_name:string>").withColumnRenamed("id", "image_id")
    notes = shards.json_member(spark, config["annt_file"], "annotations", "struct<image_id:bigint,caption:string>")
    return relational.checked_join(notes, images, ["image_id"], one_to_one=False)


@source("vqav2", "okvqa", "textvqa")
def questions(spark: SparkSession, config: Config) -> DataFrame:
    """Answers joined to their questions, one to one, images agreeing."""
    asked = shards.json_member(spark, config["question_file"], "questions", "struct<image_id:bigint,question_id:bigint,question:string>").withColumnRenamed("image_id", "asked_of")
    told = shards.json_member(spark, config["annt_file"], "annotations", "struct<image_id:bigint,question_id:bigint,question_type:string,answer_type:string,multiple_choice_answer:string,answers:array<struct<answer:string,answer_id:int>>>")
    out = relational.checked_join(told, asked, ["question_id"])
    if out.where("image_id != asked_of").limit(1).count():
        raise ValueError("a question and its answers are of different images")
    return out.drop("asked_of")


@source("vizwiz_vqa")
def vizwiz(spark: SparkSession, config: Config) -> DataFrame:
    rows = shards.json_array(spark, config["annt_file"], "image string, question string, answer_type string, answerable int, answers array<struct<answer:string>>")
    return rows.withColumn("image_id", F.regexp_extract(F.substring_index("image", "_", -1), r"^([0-9]+)\.", 1).cast("bigint"))


@source("visdial")
def dialogs(spark: SparkSession, config: Config) -> DataFrame:
    """A row a round: image, round, question, answer, options, decoded from the shared dictionaries."""
    schema = "data struct<dialogs:array<struct<image_id:bigint,caption:string,dialog:array<struct<question:int,answer:int,answer_options:array<int>>>>>,questions:array<string>,answers:array<string>>"
    held = spark.read.schema(schema).option("multiLine", True).json(config["annt_file"]).select("data.*")
    texts = lambda c, name: held.select(F.posexplode(c).alias("ix", name))
    rounds = held.select(F.explode("dialogs").alias("d")).select("d.image_id", "d.caption", F.posexplode("d.dialog").alias("round", "r")).select("image_id", "caption", (F.col("round") + 1).alias("round_id"), "r.*")
    asked = rounds.join(texts("questions", "q").withColumnRenamed("ix", "question"), "question").join(texts("answers", "a").withColumnRenamed("ix", "answer"), "answer")
    keyed = asked.withColumn("_k", F.struct("image_id", "round_id"))
    options = relational.decode_list(keyed.select("_k", "answer_options"), "_k", "answer_options", texts("answers", "t"), "ix", "t")
    return keyed.join(options, "_k").select("image_id", "caption", "round_id", F.col("q").alias("question"), F.col("a").alias("answer"), F.col("texts").alias("options"))


@source("vist")
def stories(spark: SparkSession, config: Config) -> DataFrame:
    """A row an image of a story, in order."""
    return spark.read.schema("annotations map<string,array<struct<sequence_index:int,image_id:string,caption:string>>>").option("multiLine", True).json(config["annt_file"]).select(
        F.explode("annotations").alias("story_id", "s")).select("story_id", F.inline(F.array_sort("s")))


@source("pororo", "flintstones")
def cartoons(spark: SparkSession, config: Config) -> DataFrame:
    """Items with their followers, from a table converted once; those without exactly four go."""
    rows = spark.read.parquet(config["annt_file"]).where(F.size("followings") == 4)
    return relational.with_followers(rows, "id", "followings", "id")


@source("llava_instruct", "weighted_concat_dataset")
def instructions(spark: SparkSession, config: Config) -> DataFrame:
    """Conversations cut into rounds of two turns; files may be weighted, weights apply to rows."""
    paths = config["annt_files"]
    weights = config.get("weights") or [1.0] * len(paths)
    out = None
    for path, w in zip(paths, weights, strict=True):
        rows = shards.json_or_lines(spark, [path], "id string, image string, conversations array<struct<value:string>>").withColumn("weight", F.lit(float(w)))
        out = rows if out is None else out.unionByName(rows)
    pairs_ = F.transform(F.sequence(F.lit(0), F.floor(F.size("conversations") / 2).cast("int") - 1), lambda k: F.struct(k.alias("round"), F.get("conversations", 2 * k)["value"].alias("query"), F.get("conversations", 2 * k + 1)["value"].alias("label")))
    return out.where(F.size("conversations") >= 2).select("id", "image", "weight", F.inline(pairs_))


@source("refcoco", "refcoco+", "refcocog", "vgvqa", "grit", "grit_grounding")
def grounding(spark: SparkSession, config: Config) -> DataFrame:
    """Boxes with their sentences; unsure ones go before anything is decoded."""
    schema = "image string, bbox array<double>, sent string, question string, answer string, confidence double"
    paths = shards.indexed_paths(config["annt_file"], config["start_idx"], config["end_idx"]) if "start_idx" in config else [config["annt_file"]]
    rows = shards.json_lines(spark, paths, schema)
    sane = (F.get("bbox", F.lit(0)) <= F.get("bbox", F.lit(2))) & (F.get("bbox", F.lit(1)) <= F.get("bbox", F.lit(3)))
    return rows.where((F.coalesce("confidence", F.lit(1.0)) >= config.get("confidence_threshold", 0.0)) & sane)


@source("vg", "refcocog_caption")
def regions(spark: SparkSession, config: Config) -> DataFrame:
    return shards.json_member(spark, config["annt_file"], "annotations", "struct<image_id:bigint,image:string,caption:string,query:string,bbox:array<double>>")


@source("flickr30k_entities")
def entities(spark: SparkSession, config: Config) -> DataFrame:
    from ..functions.boxes import grounded_objects

    return shards.json_lines(spark, config["annt_file"], "image string, sent string").withColumn("objects", grounded_objects(F.col("sent")))


@source("ade20k")
def segmentation(spark: SparkSession, config: Config) -> DataFrame:
    return shards.json_array(spark, config["annt_file"], "image_id string, caption string")


@source("random_mix")
def mixture(spark: SparkSession, config: Config) -> DataFrame:
    """Sources of one shape interleaved by weight; the label travels with the row."""
    out = None
    for name, part in config["datasets"].items():
        rows = build(spark, part).select(F.to_json(F.struct("*")).alias("record"), F.lit(name).alias("source"))
        out = rows if out is None else out.unionByName(rows)
    order = F.md5(F.concat_ws("|", F.lit(config.get("seed", 0) + config.get("epoch", 0)), F.col("record")))
    return sampling.mix(out, "source", order, config.get("weights"), config.get("sampling_type", "sum"), keep=("record",))


@source("image_pairs")
def image_pairs(spark: SparkSession, config: Config) -> DataFrame:
    """Paths to be compared."""
    return shards.json_array(spark, config["annt_file"], "image_path string, image_gt_path string, caption string").withColumn("pair", F.monotonically_increasing_id())
