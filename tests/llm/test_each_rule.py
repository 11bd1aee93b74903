"""Every adaptive rule can reject a document that passes the base rule."""

from __future__ import annotations

import random

import pytest
from conftest import prose

from weftline.llm import quality


def odd(rate: str) -> str:
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 10**6)}" for _ in range(n))
    return {
        "chars_per_word": " ".join(f"{k}" + "x" * 40 for k in range(80)),
        "symbols_per_word": " ".join(f"$${k}##" for k in range(80)),
        "dup_line_share": "\n".join(["a line"] * 60 + [fresh(6) for _ in range(45)]),
        "repeat_word_share": "\n".join([fresh(46), "one two three four " * 11]),
    }[rate]


@pytest.mark.parametrize("rate", list(quality.RATES))
def test_rule_rejects(spark, rate):
    rows = [(i, prose(40 + i, 90, 5), "en", "a") for i in range(30)] + [(99, odd(rate), "en", "a")]
    got = {r.doc_id: r for r in quality.digests(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[99].base_failed and not got[99].kept
    assert all(got[i].kept for i in range(30))
