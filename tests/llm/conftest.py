"""Fixtures of awkward documents: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int, lines: int = 1) -> str:
    """Invented words, the same for the same seed."""
    rng = random.Random(seed)
    syllables = "an on er th re in ou ti le de en is la ca mo ri so ver ich que".split()
    flat = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(flat[i : i + step]) for i in range(0, words, step))


def awkward_rows() -> list[tuple]:
    shared = prose(1, 90, 6)
    rows = [
        (1, shared, "en", "a"), (2, shared, "en", "a"), (3, "Before it. " + shared + "\nand after", "en", "b"),
        (4, None, "en", "a"), (5, "", None, "a"), (6, " \n\t ", "en", None), (None, prose(2, 60, 3), "en", "a"), (None, None, None, None),
        (7, "one", "en", "a"), (8, "one two", "en", "a"), (9, prose(3, 4000, 40), "fr", "a"), (10, "x" * 50_000, "fr", "a"),
        (11, prose(4, 70, 4), "en", "a"), (11, prose(4, 70, 4), "en", "a"), (12, prose(5, 80, 5) + "\n" + prose(5, 80, 5), "en", "b"),
        (13, "é ß \x1c\U0001f600 " + prose(6, 55), "de", "b"), (14, "the the the the " * 30, "en", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with columns that bear the operators' working names."""
    from pyspark.sql import functions as F

    names = ["fp", "digest", "key", "block", "shard", "size", "kept", "n_words", "lines", "spots", "gone", "h", "w", "root", "component_id", "ids", "group", "rate", "payload", "_key", "_place", "base_failed", "_id", "_md5", "_digest"]
    return awkward.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    return [(r[0], r[1]) for r in awkward_rows()]
