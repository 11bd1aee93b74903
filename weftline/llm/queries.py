"""Queries of this subpackage: one a operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import byte_bpe, decontaminate, fill_middle, line_dedup, lm_score, pii, quality, secrets, sharding, simhash, spelling, substring_dedup, vector_copies


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_crf": lambda spark, sf_dir: pii.digests(documents(spark, sf_dir)),
    "op2_secret_cnn": lambda spark, sf_dir: secrets.digests(documents(spark, sf_dir)),
    "op3_phrase_automata": lambda spark, sf_dir: substring_dedup.digests(documents(spark, sf_dir)),
    "op4_simhash_covering": lambda spark, sf_dir: simhash.digests(documents(spark, sf_dir)),
    "op5_minimax_shards": lambda spark, sf_dir: sharding.shard(documents(spark, sf_dir)),
    "op6_winnowed_lines": lambda spark, sf_dir: line_dedup.digests(documents(spark, sf_dir)),
    "op7_bm25_leaks": lambda spark, sf_dir: decontaminate.digests(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op8_deleted_interpolation": lambda spark, sf_dir: lm_score.score(documents(spark, sf_dir)),
    "op9_adaptive_rules": lambda spark, sf_dir: quality.digests(documents(spark, sf_dir)),
    "op10_byte_bpe": lambda spark, sf_dir: byte_bpe.digests(documents(spark, sf_dir)),
    "op11_spelling_halves": lambda spark, sf_dir: spelling.groups(documents(spark, sf_dir)),
    "op12_fill_middle": lambda spark, sf_dir: fill_middle.digests(documents(spark, sf_dir)),
    "op13_pstable_vectors": lambda spark, sf_dir: vector_copies.grouped(table(spark, sf_dir, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_phrase_automata": substring_dedup.ORACLE, "op5_minimax_shards": sharding.ORACLE, "op6_winnowed_lines": line_dedup.ORACLE, "op7_bm25_leaks": decontaminate.ORACLE, "op9_adaptive_rules": quality.ORACLE,
    "op11_spelling_halves": spelling.ORACLE, "op12_fill_middle": fill_middle.ORACLE, "op13_pstable_vectors": vector_copies.ORACLE,
}
