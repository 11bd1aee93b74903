"""From raw documents to training tokens: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents. Rows go where a stage
rejects them: bad quality, near copies but one of each group, documents with a benchmark item. Line
dedup changes texts and n_chars and drops no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, common, decontaminate, line_dedup, near_copies, quality
from weftline.session import ensure_importable
from weftline.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return line_dedup.clean(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and the digest of the bytes that they decode to; no other column.

    Null and empty texts have no tokens; long ones are encoded whole; null ids stay null; repeated rows give repeated
    results; no documents give no rows; other columns, whatever their names, are not read.
    """
    ensure_importable(spark)
    out = byte_bpe.round_trip(docs, as_list=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Anchors, automata of merges and retrieval bounds have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
