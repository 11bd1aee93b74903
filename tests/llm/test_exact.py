"""Operators against brute force on the awkward rows and on the driver's smallest tables."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import blocks, byte_bpe, common, decontaminate, line_dedup, lm_score, pii, quality, secrets, sharding, simhash, substring_dedup
from weftline.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir, awkward):
    more = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    return awkward.unionByName(more)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want) -> None:
    assert Counter(map(str, got)) == Counter(map(str, want))


def test_base_patterns(rows):
    odd = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567 +1--", "a@a@a.b.c@d.e", "9" * 40, "+49", ".1.2.3.4", "١٢٣"]
    for text in odd + [t for _, t in rows]:
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text[:3000])]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text[:3000]) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text[:3000]):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text[:3000]) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
        assert pii.base_spans(text[:3000]) == want


def test_secret_patterns(rows):
    odd = ['Password="abcdef"', "pAsswd : 12345", "api-key=abcdef", "API_KEY = 'x.y/z+1'", "token==abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 23, "f" * 24, "ſecret=abcdef", "toKen=abcdef"]
    order = ["assign", "access", "hex"]
    for text in odd + [t for _, t in rows]:
        want = [("assign", *m.span()) for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want, key=lambda s: (s[1], order.index(s[0])))


def test_scans_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "+1" + " " * 400_000, "token" + " " * 400_000, "@" * 200_000, "a.b@" * 100_000):
        pii.base_spans(text)
        secrets.base_spans(text)


def test_field_on_held_out_rows():
    field = pii.Field(*pii.default_field())
    test = pii.labelled_table(300, seed=99)
    found = field.decode([w for w, _ in test])
    hit = sum(((p == np.array(g)) & (p > 0)).sum() for p, (_, g) in zip(found, test, strict=True))
    assert hit / sum((p > 0).sum() for p in found) > 0.95
    assert hit / sum((np.array(g) > 0).sum() for _, g in test) > 0.95


def test_viterbi_is_the_best_path():
    field = pii.Field(*pii.default_field())
    test = [w[:5] for w, _ in pii.labelled_table(15, seed=5)]
    gains, starts = field.gains(test)
    for words, at, got in zip(test, starts, field.decode(test), strict=True):
        e = np.zeros((len(words), len(pii.LABELS)))
        e[:, 1:] = gains[at : at + len(words)]
        paths = np.stack(np.meshgrid(*[range(len(pii.LABELS))] * len(words), indexing="ij"), -1).reshape(-1, len(words))
        score = field.first[paths[:, 0]] + e[np.arange(len(words)), paths].sum(1) + field.moves[paths[:, :-1], paths[:, 1:]].sum(1)
        mine = np.array(got)
        assert field.first[mine[0]] + e[np.arange(len(words)), mine].sum() + field.moves[mine[:-1], mine[1:]].sum() == pytest.approx(score.max(), abs=1e-3)


def test_net_on_held_out_findings():
    net = secrets.default_net()
    test = secrets.labelled_findings(600, seed=77)
    p, gold = net.probability([r[:3] for r in test]), np.array([r[3] for r in test])
    assert (p[gold > 0] >= net.threshold).mean() >= 0.95
    assert (p[gold == 0] >= net.threshold).mean() <= 0.05


def test_net_reads_long_candidates_in_stretches():
    net = secrets.default_net()
    rng = np.random.default_rng(3)
    for n in (5_000, 4_097, 20_001):
        text = "key = " + "".join(rng.choice(list("abcXYZ0123456789+/"), n)) + "\nnext"
        want = net.forward(*net.inputs([(text, 6, 6 + n)]))[0][0]
        assert net.long_logit(text, 6, 6 + n) == pytest.approx(want, abs=1e-4)
    text = "a1" * 10_000_000
    tracemalloc.start()
    assert 0 <= net.probability([(text, 0, len(text))])[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_threshold_keeps_recall():
    p, gold = np.linspace(0, 1, 200), np.ones(200)
    for recall in (0.5, 0.9, 0.99, 1.0):
        assert (p >= secrets.threshold_for(p, gold, recall)).mean() >= recall


@pytest.mark.parametrize(("block", "at_once"), [(3_000, 2), (4 << 20, 8000)])
def test_substring_dedup(docs, rows, block, at_once):
    got = substring_dedup.dedup(docs, block_bytes=block, phrases_at_once=at_once).collect()
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got], [(i, *w) for (i, _), w in zip(rows, substring_dedup.brute_force([t for _, t in rows]), strict=True)])


def test_substring_dedup_overlaps(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[10:60]), " ".join(words[59:]), "a " * 36, "b " * 35, " ".join(words[:34])]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    want = [w[1] for w in substring_dedup.brute_force(texts)]
    assert [got[i] for i in range(len(texts))] == want == [90, 50, 41, 36, 0, 0]


def brute_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints: list[tuple]) -> list[tuple]:
    up = list(range(len(fingerprints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j][1]).bit_count() <= 2:
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(fingerprints):
        least[top(i)] += [key] if key is not None else []
    return [(key, f"{fp:016x}", min(least[top(i)], default=None)) for i, (key, fp) in enumerate(fingerprints)]


def test_simhash(docs, rows):
    short = [(i, t) for i, t in rows]
    want = components([(i, brute_fingerprint(t)) for i, t in short])
    same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digests(docs).collect()], want)


def test_links_of_chains_and_balls(spark):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for s in seeds.tolist():
        x = s
        for _ in range(12):  # chains of one or two flips each
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 3), replace=False).tolist():
                x ^= 1 << b
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & mask).bit_count() <= 2}
    assert got == want and simhash.links(df).count() == len(want)
    tops = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    by_index = components([(i, x & mask) for i, x in enumerate(signed)])
    least = defaultdict(list)
    for x, w in zip(signed, by_index, strict=True):
        least[w[2]].append(x)
    assert all(tops.get(x, x) == min(least[w[2]]) for x, w in zip(signed, by_index, strict=True))


def test_covering_loses_no_pair():
    rng = np.random.default_rng(4)
    values = rng.integers(-(2**63), 2**63 - 1, 400, dtype=np.int64)
    row, anchor, excess = simhash.covering(values)
    homes = dict(zip(row[excess == 0].tolist(), anchor[excess == 0].tolist(), strict=True))
    assert len(homes) == len(values)
    for i, v in enumerate(values.tolist()):
        flips = rng.choice(64, rng.integers(0, 3), replace=False).tolist()
        other = np.array([(v & (2**64 - 1)) ^ sum(1 << b for b in flips)], np.uint64).view(np.int64)
        assert homes[i] in set(simhash.covering(other)[1].tolist())


def test_keep_one_stays_once(docs, rows):
    kept = simhash.keep_one(docs).collect()
    want = {c for *_, c in components([(i, brute_fingerprint(t)) for i, t in rows])}
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, want))


def test_minimax_shards(docs, rows):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    text_of = defaultdict(set)
    for r in got:
        sizes[r["shard"]] += r["size"]
        text_of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in text_of.values())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    order = [groups[k] for k in sorted(groups)]

    def fits(capacity):
        used, n = 0, 1
        for g in order:
            if g > capacity:
                return False
            if used + g > capacity:
                used, n = 0, n + 1
            used += g
        return n <= 8

    best = next(c for c in range(max(max(order), -(-sum(order) // 8)), sum(order) + 1) if fits(c))
    assert max(sizes.values()) <= best and sum(sizes.values()) == sum(order)


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_minimax_on_even_texts(spark, shards):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    got = Counter(r["shard"] for r in sharding.shard(df, shards).collect())
    assert max(got.values()) <= -(-40 // shards) + 1 and len(got) == shards


def test_line_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = lambda r: ((r[0] is not None, r[0] or 0), hashlib.md5(r[1].encode()).hexdigest())
    unique = sorted({r for r in rows if r[1] is not None}, key=key)
    seen, gone = set(), defaultdict(set)
    for r in unique:
        lines = [x for x in r[1].split("\n") if WORD.search(x)]
        for i in range(len(lines)):
            for k in range(1, min(3, len(lines) - i) + 1):
                window = tuple(lines[i : i + k])
                if k == 3 or sum(len(WORD.findall(x)) for x in window) > 50 or k == len(lines):
                    gone[r] |= set(range(i, i + k)) if window in seen else set()
                    seen.add(window)
    want = []
    for r in rows:
        kept, k = [], 0
        for line in (r[1] or "").split("\n"):
            if WORD.search(line):
                if k not in gone[r]:
                    kept.append(line)
                k += 1
            else:
                kept.append(line)
        want.append((r[0], k, len(gone[r]), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    same([tuple(r) for r in line_dedup.digests(docs).collect()], want)


def test_leaks_against_shared_triples(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    triples = defaultdict(set)
    of_item = {}
    for r in items.collect():
        w = decontaminate.words_of(r.text)
        of_item[r.item_id] = set(zip(w, w[1:], w[2:], strict=False))
        for t in of_item[r.item_id]:
            triples[t].add(r.item_id)
    want = set()
    for r in docs.collect():
        w = decontaminate.words_of(r.text)
        shared = defaultdict(set)
        for t in zip(w, w[1:], w[2:], strict=False):
            for i in triples.get(t, ()):
                shared[i].add(t)
        want |= {(r.doc_id, i) for i, s in shared.items() if len(s) > len(of_item[i]) / 2}
    assert {(r.doc_id, r.item_id) for r in decontaminate.digests(docs, items).collect()} == want and want


def test_block_max_bounds_prune_nothing():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 12)))) for i in range(37)]
    index = decontaminate.Index.of(items)
    words = [rng.choice(len(index.vocabulary), rng.integers(1, 30), replace=False) for _ in range(50)]
    passage = np.repeat(np.arange(50), [len(w) for w in words])
    p, i, s = index.retrieve(passage, np.concatenate([np.sort(w) for w in words]), 50, 0.4)
    weights = defaultdict(dict)
    for t in range(len(index.vocabulary)):
        for e in range(index.word_at[t], index.word_at[t + 1]):
            for k in range(index.first[e], index.first[e + 1]):
                weights[int(index.item[k])][t] = index.weight[k]
    want = {(a, b) for a, w in enumerate(words) for b, x in weights.items() if sum(x.get(int(t), 0) for t in w) >= 0.4}
    assert set(zip(p.tolist(), i.tolist(), strict=True)) == want and len(s) == len(want)


@pytest.mark.parametrize("size", [60, 300, 5_000])
def test_shards_change_nothing(spark, monkeypatch, size):
    """Items that share words: pairs, scores and overlaps are those of one shard, however they are dealt."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    text = lambda n: " ".join(words[int(i)] for i in rng.zipf(1.3, n) % 50)
    items = [(i, text(int(rng.integers(6, 70))) + (". " + text(6) if i % 2 else "")) for i in range(40)] + [(40, None), (41, "..."), (42, "w1")]
    docs = [(i, text(20) + " " + items[i % 40][1] + " " + text(int(rng.integers(5, 120)))) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = Counter(map(tuple, decontaminate.digests(d, b).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
    assert Counter(map(tuple, decontaminate.digests(d, b).collect())) == one and len(one) >= 30


def test_lm_counts(docs, rows):
    got = lm_score.score(docs, block_bytes=5_000).collect()
    want = lm_score.brute_force(rows)
    same([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], [(*w[:5], round(w[5], 6)) for w in want])
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


def test_lm_scores(docs, rows):
    """The model's score by dictionaries: counts, deleted estimates, the mixture learned a cell at a time, all texts."""
    tokens = [(lm_score.is_held_out(i), t.encode().lower().split() + [None]) for i, t in rows]
    one, two, before = Counter(), Counter(), Counter()
    for held, words in tokens:
        for v, w in zip([None, *words], words, strict=False):
            if not held:
                one[w] += 1
                two[v, w] += 1
    total, v_plus = sum(one.values()), len(one) + 1
    before = one  # a token's count as a context, the end's too
    bucket = lambda c: min(int(np.log2(c)) + 1, lm_score.BUCKETS - 1) if c > 0 else 0
    step = lambda x: min(int(-lm_score.FINE * np.log2(x)) + 1, lm_score.STEPS - 1) if x > 0 else 0
    cells = defaultdict(lambda: [0, 0.0, 0.0])
    for held, words in tokens:
        for v, w in zip([None, *words], words, strict=False):
            if not held:
                c = before[v] - 1
                p2, p1 = (two[v, w] - 1) / c if c > 0 else 0.0, (one[w] - 1) / (total - 1)
                cell = cells[bucket(c), step(p2), step(p1)]
                cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + p2, cell[2] + p1
    weights = {b: [1 / 3] * 3 if b else [0.0, 0.5, 0.5] for b in range(lm_score.BUCKETS)}
    for _ in range(lm_score.ITERATIONS):
        sums = defaultdict(lambda: [0.0] * 3)
        for (b, _, _), (n, s2, s1) in cells.items():
            part = [x * p for x, p in zip(weights[b], (s2 / n, s1 / n, 1 / v_plus), strict=True)]
            for k in range(3):
                sums[b][k] += n * part[k] / max(sum(part), 1e-300)
        weights |= {b: [x / sum(s) for x in s] for b, s in sums.items()}
    seen = {b for b, _, _ in cells}
    for b in range(1, lm_score.BUCKETS):
        if b not in seen:
            weights[b] = weights[b - 1] if b > 1 else [1 / 3] * 3
    if 0 not in seen:
        rest = [sum(weights[b][k] for b in range(1, lm_score.BUCKETS)) for k in (1, 2)]
        weights[0] = [0.0, rest[0] / sum(rest), rest[1] / sum(rest)]
    weights = {b: [x / sum(w) * (1 - 1e-6) for x in w] for b, w in weights.items()}

    def score(words: list) -> float:
        out = 0.0
        for v, w in zip([None, *words], words, strict=False):
            c = before[v]
            a, u, z = weights[bucket(c)]
            out += np.log10(a * (two[v, w] / c if c else 0.0) + u * one[w] / total + (z + 1e-6) / v_plus)
        return out

    want = sorted((str(i), score(w)) for (i, _), (_, w) in zip(rows, tokens, strict=True))
    got = sorted((str(r.doc_id), r.score) for r in lm_score.score(docs, block_bytes=5_000).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-6, abs=1e-6)


def test_lm_beats_the_base_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = [r for r in lm_score.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    n = 20_000
    from_pair = rng.random(n) < 0.7
    two, one = np.where(from_pair, 0.5, 1e-4), np.where(from_pair, 1e-4, 0.5)
    cells = [(5, 1, float(a), float(b)) for a, b in zip(two, one, strict=True)]
    assert lm_score.learned(cells, 1e-6)[5, 0] == pytest.approx(0.7, abs=0.02)


def test_lm_probabilities_sum_to_one():
    w = lm_score._floor_mix(lm_score.learned([(3, 10, 0.2, 0.1), (0, 5, 0.0, 0.1)], 0.01))
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0


def test_quality_counts(docs, rows):
    want = []
    for i, t in rows:
        words = WORD.findall(t)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(words)
        want.append((i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n))
    got = quality.digests(docs).collect()
    same([tuple(r)[:7] for r in got], want)
    assert not any(r.kept and r.base_failed for r in got)


def test_sketches_merge(spark, docs):
    rated = written(quality.rates(quality.counted(docs, docs["text"], [docs["lang"], docs["source"], docs["doc_id"]])))
    rules = quality.Rules()
    whole = quality.sketches(rated, rules)
    parts = quality.sketches(rated.where("doc_id % 2 = 0"), rules).unionByName(quality.sketches(rated.where("doc_id % 2 != 0 OR doc_id IS NULL"), rules))
    merged = parts.groupBy("lang", "source", "rate", "bin").sum("n")
    same([tuple(r) for r in merged.collect()], [tuple(r) for r in whole.collect()])


def test_bpe_as_tiktoken(docs, rows):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.parse_ranks(f)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        if i == 10:  # one word of 50,000 letters, on which that library takes minutes
            continue
        ids = own.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.digests(docs).collect()]
    same([r for r in got if r[0] != 10], want)
    assert [r[3] for r in got if r[0] == 10] == [hashlib.sha256(b"x" * 50_000).hexdigest()]


def test_bpe_offsets_and_split_characters(spark):
    text = "né \U0001f600\U0001f9ff <|endoftext|> ok"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = byte_bpe.encode(df, offsets=True).collect()[0]
    codec = byte_bpe.codec_for(*byte_bpe.default_vocabulary())
    assert r.starts[0] == 0 and r.ends[-1] == len(text) and all(a < b for a, b in zip(r.starts, r.ends, strict=True))
    assert "".join(codec.decode_text(r.ids)) == text
    whole = [text[a:b].encode() for a, b in zip(r.starts, r.ends, strict=True)]
    assert all(codec.token_bytes[i] in w for i, w in zip(np.frombuffer(r.ids, "<u4").tolist(), whole, strict=True))


def test_many_stretches(docs, rows, monkeypatch):
    """More stretches of the hash range than entries in most blocks: the same results, and bounded groups."""
    monkeypatch.setattr(blocks, "GROUP_ENTRIES", 1)
    assert blocks.parts_for(1 << 40) == 1 << 40
    got = substring_dedup.dedup(docs, block_bytes=20_000).collect()
    same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got], [(i, *w) for (i, _), w in zip(rows, substring_dedup.brute_force([t for _, t in rows]), strict=True)])


def test_block_sizes():
    assert blocks.block_bytes_for(10**9, 4 << 20) == 4 << 20
    assert blocks.block_bytes_for(10**14, 4 << 20) == 32 << 20


def test_no_scratch_without_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="share"):
        common.scratch_dir(Cluster)


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 10, None, "b" * 300, "", "c" * 50, "d" * 50, "e"])], names=["k", "t"])
    parts = list(common.slices(batch, 1, rows=3, size=100))
    assert [r for p in parts for r in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 100) for p in parts)


def test_components_of_a_large_star(spark):
    n = 100_000
    star = spark.range(1, n).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(n, n + 40).select("id", (F.col("id") + 1).alias("b")).toDF("a", "b")
    roots = simhash.components(star.unionByName(chain)).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in roots} == {0: n, n: 41}


def test_block_lists_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        high, low, counts, place = blocks.distinct(rng.integers(0, 50, n).astype(np.uint64) << np.uint64(50), rng.integers(0, 3, n).astype(np.uint64))
        h, lo, c = blocks.receive(blocks.send(high, low, counts))
        assert (h == high).all() and (n == 0 or (lo == low).all()) and (c == counts).all() and counts.sum() == n and len(place) == n
        for said in (counts > 1, counts.astype(np.uint32)):
            assert (blocks.open_reply(blocks.pack_reply(said)) == said).all()
