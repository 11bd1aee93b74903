"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weftline.llm import near_copies, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def survivors(rows: list[tuple]) -> list[str]:
    """The smallest id of every component of texts with a similarity of 0.8 or more."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[top(i)] = top(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(key)
    return sorted(str(min((k for k in g if k is not None), default=None)) for g in groups.values())


def planted() -> list[tuple]:
    """Forty texts with three copies each that differ in one word to five, and a line that all of them have."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))]
        for edits in (0, 1, 3, 5):
            mine = list(words)
            for at in rng.sample(range(len(mine)), edits):
                mine[at] = f"new{rng.randint(0, 10**9)}"
            rows.append((1000 + len(rows), " ".join(mine) + "\nthis very common line is in every one of the texts"))
    return rows


@pytest.mark.parametrize(("least", "tile"), [(2, 2), (32, 2_048)])
def test_near_copies_go(spark, sf_dir, awkward, monkeypatch, least, tile):
    monkeypatch.setattr(near_copies.frequent, "__defaults__", (least,))
    monkeypatch.setattr(near_copies, "TILE", tile)
    docs = awkward.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in planted()], awkward.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect())
    assert kept == survivors(rows)
    assert len(kept) < simhash.keep_one(docs).count() - 30


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(9)
    facts, want = [], []
    for n in (0, 1, 40, 64, 65, 300, 1000):
        base = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        for changed in (0, n // 50, n // 10, n // 5, n // 2):
            other = np.concatenate([base[changed:], rng.integers(-(2**63), 2**63 - 1, changed + n // 7, dtype=np.int64)])
            facts.append([len(s).to_bytes(4, "big") + near_copies.sketch(s) for s in (base, other)])
            differ = len(np.setxor1d(base, other))
            a, b = (np.frombuffer(f[4:], np.uint8)[None] for f in facts[-1])
            assert near_copies.sketch_distances(a, b)[0] <= differ
            want.append(9 * differ <= 2 * n + n // 7)
    held = near_copies._may_link(*(pa.array(c, pa.large_binary()) for c in zip(*facts, strict=True)))
    assert all(h for h, w in zip(held, want, strict=True) if w) and not held.all()


def test_a_large_group_of_copies(spark, sf_dir):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{i}" if j in (i % 60, 60 + i % 59) else w for j, w in enumerate(words))) for i in range(150)]
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    assert sorted(str(r.doc_id) for r in got.collect()) == survivors(rows)


@pytest.mark.parametrize("tile", [3, 50])
def test_a_large_group_of_distant_copies(spark, sf_dir, monkeypatch, tile):
    """Copies of one text of which most are too far apart to link: chains and pairs among them are found all the same."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 500)}" for _ in range(150)]
    rows = []
    for i in range(160):
        mine = list(words)
        for at in rng.sample(range(150), rng.randint(0, 6)):
            mine[at] = f"x{rng.randint(0, 10**9)}"
        rows.append((i, " ".join(mine)))
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), sf_dir)
    want = survivors(rows)
    assert sorted(str(r.doc_id) for r in got.collect()) == want and 20 < len(want) < 140


def test_frequent_shingles_cost_a_set_its_own_length():
    """A million frequent shingles: a set looks its own up in them, and doesn't go through them all."""
    rng = np.random.default_rng(4)
    last = np.unique(rng.integers(-(2**63), 2**63 - 1, 1_000_000, dtype=np.int64))
    sets = [np.sort(np.concatenate([rng.integers(-(2**63), 2**63 - 1, 80, dtype=np.int64), rng.choice(last, 40, False)]).view(np.uint64)).view(np.int64) for _ in range(300)]
    began = time.process_time()
    places = [near_copies._prefix(s, last) for s in sets]
    assert time.process_time() - began < 3
    for s, at in zip(sets, places, strict=True):
        late = np.isin(s, last[np.searchsorted(last, s) % len(last)])
        assert at.tolist() == [*np.flatnonzero(~late), *np.flatnonzero(late)][: near_copies.prefix_length(len(s))]
    assert near_copies._prefix(sets[0], last[:0]).tolist() == list(range(near_copies.prefix_length(len(sets[0]))))


def test_fingerprints_are_majorities_and_meet_at_anchors():
    """Each word is the majority of its mix; sets that differ in fewer than (EXCESS + 1) * WORDS bits meet at an anchor."""
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)) for n in (0, 1, 2, 77, 500)]
    words = near_copies.fingerprints(sets)
    for s, own in zip(sets, words, strict=True):
        for m, word in zip(near_copies._MIXES, own.tolist(), strict=True):
            mixed = near_copies.bl.scrambled(s.view(np.uint64) * m).tolist()
            assert word % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(s))
    n, excess = near_copies.WORDS, near_copies.EXCESS
    for _ in range(50):
        a = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        b = a.copy()
        for bit in rng.choice(64 * n, (excess + 1) * n - 1, False).tolist():
            b[bit // 64] ^= np.uint64(1 << bit % 64).view(np.int64)
        homes = simhash.covering(a, 0)[1]
        row, anchor, _ = simhash.covering(b, excess)
        assert len(homes) == n and any(homes[k] in anchor[row == k] for k in range(n))


def test_the_stage_searches_by_covering(spark, sf_dir, monkeypatch):
    """Most links are found at the anchors, and what meets there is far less than all pairs."""
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string")
    found, covered = [], near_copies.covered
    monkeypatch.setattr(near_copies, "covered", lambda of_set: found.append(covered(of_set)) or found[0])
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.dedup_near(spark, docs, sf_dir).collect())
    assert kept == survivors(planted())
    of = {near_copies.signature(near_copies.shingle_sets([t.encode()])[0]): shingles(t) for _, t in planted()}
    pairs = {(r.a, r.b) for r in found[0].collect()}
    links = {(a, b) for a in of for b in of if a < b and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])}
    assert len(pairs) <= near_copies.NEAREST * len(of)
    assert len({s for p in pairs & links for s in p}) >= 0.8 * len({s for p in links for s in p})
