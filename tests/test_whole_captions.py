"""bleu_stats, cider_like and rouge_scores over all documents and whole texts, against plain Python."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.queries import evaluation


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(11), tmp_path_factory.mktemp("captions")
    text = lambda n: " ".join(rng.choice("ABCDEfghij") for _ in range(n))
    docs, items = [(i, text(rng.randint(20, 90))) for i in range(25)], [(i, text(rng.randint(20, 90))) for i in range(7)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    words = [t.lower().split() for _, t in items]
    return str(path), {i: t.lower().split() for i, t in docs}, {i: {j % 7: words[j % 7] for j in (i, i + 1)} for i, _ in docs}


def grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_whole_bleu(spark, corpus):
    path, docs, refs = corpus
    logs = []
    for n in range(1, 5):
        hit = total = 0
        for i, w in docs.items():
            best = Counter()
            for r in refs[i].values():
                best |= grams(r, n)
            c = grams(w, n)
            hit, total = hit + sum((c & best).values()), total + sum(c.values())
        logs.append(math.log(hit / total + 1e-15))
    c = sum(map(len, docs.values()))
    r = sum(min((abs(len(x) - len(w)), len(x)) for x in refs[i].values())[1] for i, w in docs.items())
    bp = 1.0 if c >= r else math.exp(1 - r / c)
    got = evaluation.bleu_stats(spark, path).first().asDict()
    assert got == {f"bleu_{n}": pytest.approx(math.exp(sum(logs[:n]) / n) * bp, abs=2e-9) for n in range(1, 5)}


def test_whole_cider(spark, corpus):
    path, docs, refs = corpus
    cos = defaultdict(list)
    for n in range(1, 5):
        seen = Counter(g for of in refs.values() for g in {g for r in of.values() for g in grams(r, n)})
        weigh = lambda w: {g: k * math.log(len(docs) / seen.get(g, 1)) for g, k in grams(w, n).items()}  # noqa: B023, E731
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        for i, w in docs.items():
            a = weigh(w)
            for r in refs[i].values():
                b = weigh(r)
                both = size(a) * size(b)
                cos[i].append(sum(x * b.get(g, 0) for g, x in a.items()) / both if both else 0.0)
    got = {r.id: r.cider for r in evaluation.cider_like(spark, path).collect()}
    assert got == {i: pytest.approx(10 * sum(x) / len(x), abs=2e-6) for i, x in cos.items()}


def test_cider_shuffles_no_row_a_gram(spark, corpus):
    """A candidate's n-grams stay in its row; and the references' grams may take several passes."""
    path, _, _ = corpus
    plan = evaluation.cider_like(spark, path)._jdf.queryExecution().toString()
    assert not re.search(r"\bgram#", plan)
    docs, refs = evaluation._captions(spark, path)
    one, many = ({r.id: round(r.cider, 9) for r in metrics.cider(docs, refs, "id", F.col("w"), gram_bytes=n).collect()} for n in (metrics.GRAM_BYTES, 16 * 300))
    assert one == pytest.approx(many, abs=1e-8) and len(one) == 25


def test_whole_rouge(spark, corpus):
    path, docs, refs = corpus

    def lcs(a: list[str], b: list[str]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    def score(a: list[str], b: list[str]) -> float:
        p, r = lcs(a, b) / len(a), lcs(a, b) / len(b)
        return 2.44 * p * r / (r + 1.44 * p)

    got = {(r.id, r.ref_id): r.rouge_l for r in evaluation.rouge_scores(spark, path).collect()}
    assert got == {(i, j): pytest.approx(score(w, r), abs=2e-6) for i, w in docs.items() for j, r in refs[i].items()}


def test_a_subsequence_takes_a_step_a_common_word():
    """Against the plain table; and two long texts, of which a row of the table a word would take a minute."""
    rng = random.Random(6)
    for n, m in ((0, 5), (1, 1), (30, 70), (200, 90)):
        a, b = ([rng.randrange(9) for _ in range(k)] for k in (n, m))
        row = [0] * (m + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert metrics.common_subsequence(a, b) == row[-1]
    began = time.process_time()
    a, b = ([rng.randrange(50) for _ in range(n)] for n in (200_000, 60))
    for _ in range(10):
        metrics.common_subsequence(a, b)
    assert time.process_time() - began < 5


def test_rouge_of_odd_pairs(spark):
    rows = [(1, ["a", "b"], None), (2, None, ["a"]), (3, [], []), (4, ["a", "b", "a"], ["a", "a"]), (5, ["é", "x"], ["é"])]
    pairs = spark.createDataFrame(rows, "id int, c array<string>, r array<string>").repartition(1)
    got = {r.id: round(r.rouge_l, 6) for r in metrics.rouge_l(pairs, "c", "r").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: round(2.44 * 2 / 3 / (1 + 1.44 * 2 / 3), 6), 5: round(2.44 * 0.5 / (1 + 1.44 * 0.5), 6)}
