"""Operators 11 to 13 against brute force, on awkward rows and on planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_middle, spelling, vector_copies
from weftline.tables import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, words, lines=1):
    rng = random.Random(seed)
    syllables = "an on er th re in ou ti le de en is la ca mo ri so ver ich que".split()
    flat = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(flat[i : i + step]) for i in range(0, words, step))


# --- 11 -------------------------------------------------------------------------------------------------


def words_of(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups_of(rows):
    n = words_of(rows)
    near = {w: [x for x in n if x != w and is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def spelled():
    """Frequent words with rarer variants of them, in chains, over awkward letters and lengths."""
    frequent = ["language", "languages", "über×größe", "À" * 9, "x" * 3000]
    text = lambda k: " ".join([*frequent, "langxage" if k % 10 == 0 else "", "langxxage" if k in (1, 2) else "", "langage" if k % 9 == 0 else "", "lanuage" if k % 9 == 0 else "", "langua" if k % 7 == 0 else "", "À" * 8 if k % 40 == 0 else "", "y" + "x" * 2999 if k % 50 == 0 else ""])
    return [(k, text(k).upper() if k % 3 == 0 else text(k), "en", "a", 1) for k in range(300)] + [(k, prose(k, 400), "en", "a", 1) for k in range(300, 330)]


@pytest.mark.parametrize("shard_chars", [spelling.SHARD_CHARS, 200])
def test_spelling_equals_brute_force(spark, shard_chars):
    rows = spelled()
    got = [tuple(r) for r in spelling.groups(spark.createDataFrame(rows, SCHEMA), shard_chars=shard_chars).collect()]
    want = groups_of([r[:2] for r in rows])
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want), "no chain in the fixture"


def test_spelling_awkward(awkward, clashing, empty, texts):
    want = groups_of(texts)
    for docs in (awkward, clashing):
        assert {tuple(r) for r in spelling.groups(docs).collect()} == want
    assert spelling.groups(empty).count() == 0


def test_halves_find_every_pair_once():
    rng = np.random.default_rng(1)
    for _ in range(40):
        some = sorted({"".join(rng.choice(["a", "b"], rng.integers(7, 12))) for _ in range(60)})
        shards = [spelling.Shard(True), spelling.Shard(False)]
        for shard in shards:
            for w in some:
                shard.add(w, 1)
            shard.automaton.make_automaton()
        for w in some:
            assert sorted(x for s in shards for x, _ in s.near(w)) == [x for x in some if len(x) <= len(w) and x != w and is_near(w, x)]


# --- 12 -------------------------------------------------------------------------------------------------


def rearranged(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def lines():
    ends = ["<", "<S", "P>a", ">b\n", "\n\n\n", "a\r\nb\r\n", "é\n\U0001f600", "\x85a b\n", "<P>\n", "x<M>y", "<S>", "\n"]
    return [(k, e * (1 + k % 4), None, None, 1) for k, e in enumerate(ends * 30)] + [(k, prose(k, 200, 15), "en", "a", 1) for k in range(400, 440)] + [(999, "long\n" * 100_000, "en", "a", 1)]


def test_fill_middle_equals_brute_force(spark):
    rows = lines()
    got = [tuple(r) for r in fill_middle.digests(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(rearranged(*r[:2]) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_awkward(awkward, clashing, empty, texts):
    want = sorted(map(str, (rearranged(*t) for t in texts)))
    for docs in (awkward, clashing):
        assert sorted(str(tuple(r)) for r in fill_middle.digests(docs).collect()) == want
    assert fill_middle.digests(empty).count() == 0


def test_fill_middle_other_units_and_rates(spark):
    """Words as units, half of the texts, none in spm: the output restores the text and the middle is whole words."""
    docs = spark.createDataFrame([(k, prose(k, 30, 3), "en", "a", 1) for k in range(200)], SCHEMA)
    out = fill_middle.transform(docs, unit=r"\S+\s*|\s+", rate=50, spm_rate=0).withColumn("again", fill_middle.restored_text())
    rows = out.join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.again == r.text for r in rows) and {r.form for r in rows} == {"plain", "psm"} and 60 < sum(r.form == "psm" for r in rows) < 140
    assert all(len(r.output) == len(r.text) + 9 for r in rows if r.form == "psm")


def test_units_are_never_listed():
    """Offsets come from lazy matches: a pattern that counts its matches sees no more than the second rank asks for."""
    seen = 0

    class Spy:
        def finditer(self, text):
            nonlocal seen
            for m in re.finditer(fill_middle.LINES, text):
                seen += 1
                yield m

    assert fill_middle.offsets(Spy(), "a\n" * 1000, 3, 5) == (6, 10) and seen == 5


# --- 13 -------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """Links, components and who stays, by all pairs."""
    fine = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    groups = {}
    for k in fine:
        groups.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for own in groups.values():
        x = np.array([rows[k][1] for k in own], np.float32).astype(float)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if a != b:
                links[own[a]].add(own[b])
    return links


def summary(rows, links):
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            reach, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - reach
                reach |= new
                todo += new
            seen |= dict.fromkeys(reach, min((rows[j][0] for j in reach if rows[j][0] is not None), default=None))
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] is not None and rows[k][0] == seen[k]))
    return sorted(map(str, out))


def vectors(seed, n, dims=16, copies=40):
    """Random vectors with near copies, exact and scaled copies, and what can't link."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dims)).astype(np.float32)
    base[n // 2 :] = base[: n - n // 2] + rng.standard_normal((n - n // 2, dims)).astype(np.float32) * 0.1
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(base)]
    rows = [(k, v, k % (n // 2) % 3) for k, v, _ in rows]
    rows += [(n + k, rows[0][1], rows[0][2]) for k in range(copies)] + [(2 * n + k, [2 * x for x in rows[1][1]], rows[1][2]) for k in range(3)]
    bad = [None, [], [0.0] * dims, [float("nan"), *[1.0] * (dims - 1)], [float("inf"), *[1.0] * (dims - 1)], [None, *[1.0] * (dims - 1)], rows[0][1][:-1]]
    rows += [(3 * n + k, v, 0) for k, v in enumerate(bad)] + [(4 * n, rows[0][1], None), (None, rows[2][1], rows[2][2]), (None, [1e-40] * dims, 1), (None, [3e38] * dims, 1), (None, None, None)]
    return rows + [rows[5], rows[5]]


@pytest.mark.parametrize("tile", [vector_copies.TILE, 8])
def test_vectors_equal_brute_force(spark, tile):
    rows = vectors(3, 300)
    got = vector_copies.grouped(spark.createDataFrame(rows, VECTORS), tile=tile, recall=0.999999).collect()
    assert sorted(str(tuple(r)) for r in got) == summary(rows, brute(rows))


def test_vectors_of_one_dense_group(spark):
    """Near copies of one vector, a fifth of them linked, meet in tiles; each link is counted once."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(24)
    rows = [(k, (base + rng.standard_normal(24) * 0.2).astype(np.float32).tolist(), 1) for k in range(600)]
    got = vector_copies.grouped(spark.createDataFrame(rows, VECTORS), tile=64, recall=0.999999).collect()
    assert sorted(str(tuple(r)) for r in got) == summary(rows, brute(rows))


def test_vectors_empty_and_clashing(spark):
    rows = vectors(4, 60)
    docs = spark.createDataFrame(rows, VECTORS)
    want = sorted(map(str, vector_copies.grouped(docs).collect()))
    names = ["fp", "v", "times", "n", "code", "tile", "kept", "doc_id", "digest", "component_id", "n_links", "m", "least"]
    assert sorted(map(str, vector_copies.grouped(docs.select("*", *[F.lit("x").alias(n) for n in names])).collect())) == want
    assert vector_copies.grouped(docs.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    """Production parameters over the table's vectors and three copies of each, of cosines from 0.9 to 1: at least 0.99 of the links, none of them wrong."""
    rng = np.random.default_rng(9)
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding", "label").collect()]
    for k, v, label in list(rows):
        for j, size in enumerate(rng.random(3) * 0.45):
            noise = rng.standard_normal(len(v))
            rows.append((10_000 * (j + 1) + k, (np.array(v) / np.linalg.norm(v) + size * noise / np.linalg.norm(noise)).astype(np.float32).tolist(), label))
    want = {rows[k][0]: len(v) for k, v in brute(rows).items()}
    got = {r.vec_id: r.n_links for r in vector_copies.grouped(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 500


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just above 0.93, the hardest ones: at least 0.9 are found."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        c = 0.9301 + 0.002 * rng.random()
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = vector_copies.grouped(spark.createDataFrame(rows, VECTORS)).where("n_links > 0").count()
    assert got >= 0.9 * 600
    assert 0.9 < 1 - (1 - vector_copies.one_step(np.sqrt(2 - 2 * 0.93)) ** 16) ** vector_copies.tables_for(16)
