"""Shard patterns and the readers of sharded annotations.

Archives are read in byte ranges by the data sources of archives.py; a bad archive or line is skipped and
counted, as the published loader logs and goes on.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ensure_importable
from . import archives

#: Interleaved documents, pairs and inference documents.
INTERLEAVED = ("text_list array<string>, image_info array<struct<image_name:string,matched_text_index:int,matched_sim:double>>, similarity_matrix array<array<double>>")
INFERENCE = ("sentences array<string>, images array<string>, sentence_ixs array<int>, image_first array<boolean>, generate_mode string, num_iter int, multiround_context array<string>")

_RANGE = re.compile(r"(-?\d+)\.\.(-?\d+)$")


def expand_braces(pattern: str) -> list[str]:
    """'{a,b}' and '{00..10}' expanded, leftmost slowest; widths of padded numbers are kept, nesting is allowed."""
    depth, start, parts, cut = 0, -1, [], 0
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start, parts, cut = i, [], i + 1
            depth += 1
        elif c == "," and depth == 1:
            parts.append(pattern[cut:i])
            cut = i + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts.append(pattern[cut:i])
                if len(parts) == 1 and (m := _RANGE.match(parts[0])):
                    a, b = int(m[1]), int(m[2])
                    width = max(len(x.lstrip("-")) for x in m.groups()) if any(re.match(r"-?0\d", x) for x in m.groups()) else 0
                    choices = [f"{k:0{width + (k < 0)}d}" for k in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
                elif len(parts) == 1:
                    choices = ["{" + inner + "}" for inner in expand_braces(parts[0])]
                else:
                    choices = list(itertools.chain.from_iterable(map(expand_braces, parts)))
                return [pattern[:start] + x + rest for x in choices for rest in expand_braces(pattern[i + 1 :])]
    return [pattern]


def indexed_paths(template: str, start: int, end: int) -> list[str]:
    """Files of a half-open index range."""
    return [template.format(i) for i in range(start, end)]


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Records and where they come from; lines that are no JSON go."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(paths if isinstance(paths, str) else list(paths))
    return rows.withColumn("shard", F.col("_metadata.file_name")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_member(spark: SparkSession, path: str, member: str, element: str) -> DataFrame:
    """The elements of one member of a JSON object, as rows."""
    return spark.read.schema(f"{member} array<{element}>").option("multiLine", True).json(path).select(F.inline(member))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON object that maps keys to values."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_or_lines(spark: SparkSession, paths: Iterable[str], schema: str, need: str = "image") -> DataFrame:
    """Files by their extension: .json arrays, .jsonl lines; rows without `need` go."""
    out = None
    for path in paths:
        part = json_array(spark, path, schema) if path.endswith(".json") else json_lines(spark, path, schema).drop("shard")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out.where(F.col(need).isNotNull())


def captions(spark: SparkSession, paths: str | Sequence[str], text_member: str = "caption") -> DataFrame:
    """(image, captions): a member that is a string or a list of strings, always as an array."""
    rows = spark.read.text(paths if isinstance(paths, str) else list(paths))
    parsed = rows.select(F.try_parse_json("value").alias("v"))
    as_list = F.try_variant_get("v", f"$.{text_member}", "array<string>")
    as_text = F.try_variant_get("v", f"$.{text_member}", "string")
    # a list read as text is its JSON, so the list comes first
    return parsed.where("v IS NOT NULL").select(F.try_variant_get("v", "$.image", "string").alias("image"), F.coalesce(as_list, F.array(as_text)).alias("captions")).where("image IS NOT NULL")


def _load(spark: SparkSession, source: str, paths: str | Sequence[str], **options: object) -> DataFrame:
    ensure_importable(spark)
    archives.register(spark)
    return spark.read.format(source).options(paths=json.dumps([paths] if isinstance(paths, str) else list(paths)), **options).load()


def zipped_lines(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """(shard, member, line_no, value, error): lines of the member that bears the archive's name, or of `member`.

    What can't be read gives one row with its error and no value; filter on value for the
    data, count errors for the log.
    """
    return _load(spark, "zipped_lines", paths, **options)


def interleaved(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Documents of zipped shards: text_list, image_info, similarity_matrix, shard, line_no; bad lines go."""
    rows = zipped_lines(spark, paths).where("value IS NOT NULL")
    return rows.select("shard", "line_no", F.from_json("value", INTERLEAVED, {"mode": "PERMISSIVE"}).alias("d")).where("d.text_list IS NOT NULL").select("d.*", "shard", "line_no")


def tar_members(spark: SparkSession, paths: str | Sequence[str], **options: object) -> DataFrame:
    """(shard, place, name, content, error) of the regular files of tar archives."""
    return _load(spark, "tar_members", paths, **options)


def grouped_members(members: DataFrame) -> DataFrame:
    """(shard, sample, key, files map): neighbours of one base name form a sample; a new name or a repeated
    extension begins the next (S3). Names before the first dot of the last path part are keys, extensions lower-case."""
    named = members.where("name IS NOT NULL").withColumns({"key": F.regexp_extract("name", r"^((?:.*/|)[^/.]+)\.", 1), "ext": F.lower(F.regexp_extract("name", r"^(?:.*/|)[^/.]+\.([^/]*)$", 1))}).where("key != ''")
    by_place = W.partitionBy("shard").orderBy("place")
    runs = named.withColumn("run", F.sum((F.coalesce(F.lag("key").over(by_place), F.lit("")) != F.col("key")).cast("int")).over(by_place))
    again = runs.withColumn("nth", F.row_number().over(W.partitionBy("shard", "run", "ext").orderBy("place")))
    first = again.withColumn("part", F.max("nth").over(W.partitionBy("shard", "run").orderBy("place")))
    out = first.groupBy("shard", "run", "part", "key").agg(F.min("place").alias("at"), F.map_from_entries(F.collect_list(F.struct("ext", "content"))).alias("files"))
    return out.select("shard", (F.row_number().over(W.partitionBy("shard").orderBy("at")) - 1).cast("long").alias("sample"), "key", "files")


def images(spark: SparkSession, path: str, extensions: Sequence[str] = ("bmp", "jpg", "jpeg", "pgm", "png", "ppm", "tif", "tiff", "webp")) -> DataFrame:
    """(path, content) of a folder's images, in no order, so that no bytes are shuffled; images.py decodes them."""
    glob = "*.{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def size_catalog(spark: SparkSession, sizes: dict[str, int] | str, shards: Iterable[str]) -> DataFrame:
    """One row (n_samples, n_shards) over the listed shards; those that the catalog lacks count zero."""
    held = json.loads(sizes) if isinstance(sizes, str) else sizes
    names = [s.rsplit("/", 1)[-1] for s in shards]
    listed = spark.createDataFrame([(n, held.get(n)) for n in names], "shard string, n bigint")
    return listed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_samples"), F.count("*").alias("n_shards"))
