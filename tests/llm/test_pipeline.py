"""The whole pipeline against a plain version, on a small folder with planted cases."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from conftest import prose
from test_near_copies import survivors

import corpus_pipeline
from weftline.llm import byte_bpe, common, decontaminate, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good texts, short and repetitive ones, near copies, a passage that many share, and leaks of the benchmark."""
    rng, path = random.Random(12), tmp_path_factory.mktemp("pipeline")
    items = [(i, prose(900 + i, 40) + ". " + prose(950 + i, 12)) for i in range(6)]
    shared = prose(7, 60)
    rows: list[tuple] = []

    def add(text: str | None) -> None:
        rows.append((len(rows), text, rng.choice(["en", "de"]), rng.choice("ab"), len(text or "")))

    for k in range(24):
        text = prose(100 + k, rng.randint(70, 200), rng.randint(2, 6))
        add(text)
        words = text.split(" ")
        if k % 4 == 0:  # a near copy
            words[len(words) // 2] = "changed"
            add(" ".join(words))
        if k % 4 == 1:  # an exact one
            add(text)
        if k % 4 == 2:
            add(prose(300 + k, 80, 3) + "\n" + shared + "\n" + prose(400 + k, 50, 2))
        if k % 6 == 3:
            add(prose(500 + k, 70, 2) + " " + items[k % 6][1] + " " + prose(600 + k, 30))
    for text in (None, "", "too short", "again and " * 100, shared):
        add(text)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def sql(query: str, rows: list[tuple], items: list[tuple]) -> list[dict]:
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return con.sql(query).df().to_dict("records")


def good(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    kept = {r["doc_id"] for r in sql(quality.ORACLE, rows, items) if r["kept"]}
    return [r for r in rows if r[0] in kept]


def without_repeats(rows: list[tuple]) -> list[tuple]:
    seen, out = set(), []
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        worded = [j for j, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i in range(len(worded)):
            for k in range(1, min(3, len(worded) - i) + 1):
                window = tuple(lines[j] for j in worded[i : i + k])
                if k == 3 or sum(len(WORD.findall(x)) for x in window) > 50 or k == len(worded):
                    gone |= set(worded[i : i + k]) if window in seen else set()
                    seen.add(window)
        text = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def distinct(rows: list[tuple]) -> list[tuple]:
    kept = set(survivors([r[:2] for r in rows]))
    return [r for r in rows if str(r[0]) in kept]


def clean(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    leaks = {r["doc_id"] for r in sql(decontaminate.ORACLE, rows, items)}
    return [r for r in rows if r[0] not in leaks]


def test_stages_and_run(spark, folder):
    path, rows, items = folder
    plain = [lambda r: good(r, items), without_repeats, distinct, lambda r: clean(r, items)]
    docs, want = spark.read.parquet(f"{path}/documents.parquet"), rows
    for (name, stage), own in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before = want
        want = own(want)
        docs = common.written(stage(spark, docs, path))
        assert sorted(map(tuple, docs.collect())) == sorted(want), name
        assert want != before, name
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.parse_ranks(f)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    told = sorted((r[0], len(ids := encoding.encode_ordinary(r[1])), ids, hashlib.sha256(r[1].encode()).hexdigest()) for r in want)
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, path).collect())) == told
    got = sorted(map(tuple, corpus_pipeline.run(spark, path).collect()))
    assert got == told and 0 < len(got) < len(rows)


def test_empty_folder(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").where("false").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
