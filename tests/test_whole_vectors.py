"""beam_topk, covariance and logprob_score over whole vectors and tables, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from weftline.queries import vectors


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect())


def test_whole_covariance(spark, sf_dir, rows):
    want = np.cov(np.array([r.embedding for r in rows], float), rowvar=False)
    got = {(r.i, r.j): r.cov for r in vectors.covariance(spark, sf_dir).collect()}
    assert got == {(i, j): pytest.approx(want[i, j], abs=2e-9) for i in range(64) for j in range(i, 64)}


def test_whole_log_softmax(spark, sf_dir, rows):
    want = {}
    for r in rows:
        x = np.array(r.embedding, float)
        want.setdefault(r.label, []).append(x[r.label] - np.log(np.exp(x).sum()))
    got = {r.label: (r.score, r.n) for r in vectors.logprob_score(spark, sf_dir).collect()}
    assert got == {k: (pytest.approx(sum(v), abs=2e-6), len(v)) for k, v in want.items()}


def test_every_batch_of_beams(spark, sf_dir, rows):
    flat = {}
    for r in rows:
        flat.setdefault(r.vec_id // 4, []).extend((-x, r.vec_id % 4 * 64 + t) for t, x in enumerate(r.embedding))
    want = {(b, k + 1, ix // 64, ix % 64) for b, f in flat.items() for k, (_, ix) in enumerate(sorted(f)[:8])}
    assert {tuple(r) for r in vectors.beam_topk(spark, sf_dir).select("batch", "rank", "beam", "token").collect()} == want and len(flat) > 25
