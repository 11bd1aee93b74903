"""Language-model scores by deleted interpolation (operator 8).

Tokens are the ASCII-lower-cased words and one end a document. From the training documents (crc32 of
the id as text, mod 10, not 0) come exact counts of tokens and of token pairs; a document's first
token follows the end token, as if of the document before. The probability of a token w after v is

    a(b) c(v, w) / c(v)  +  u(b) c(w) / N  +  z(b) / (V + 1)

with weights of the bucket b of v's count (its binary logarithm; a bucket of its own for unseen v).
The weights are learned by expectation-maximisation on held-out counts in the deleted way: every
training token is scored by the counts without its own occurrence. The tokens' two estimates are
gathered over all training documents in cells of half a power of two (count and sums, so a
cell's mean is exact); the table of cells is of fixed size at most, and the iterations run on it.

Counts are exchanged by blocks of documents (see blocks.py): what is gathered grows with the corpus,
no vocabulary is broadcast, and no token is a hot key.

Defined cases: null text is empty (one token, the end); a null id has remainder 0; repeated rows count
each; without training documents N is 0, all counts are 0 and the model is uniform; an empty table
gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl

BLOCK_BYTES = 8 << 20
FOLDS, HELD_OUT = 10, 0
SMOOTHING = 0.1
#: Cells a power of two, steps of an estimate that are told apart, and buckets of the context's count. So there are fewer than
#: BUCKETS * STEPS * STEPS cells, 442,368, whatever the corpus.
FINE, STEPS = 2, 96
BUCKETS = 48
ITERATIONS = 200

_END = bl.word_hashes([b"\n"])  # no word holds white space
_PAIR = bl.multipliers(2, 9)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """A block's tokens in a row, with the hashes of tokens and of pairs."""

    def __init__(self, ids: list[int | None], texts: list[bytes]) -> None:
        self.held = np.array([is_held_out(i) for i in ids], bool)
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()
            parts += (bl.word_hashes(words), _END)
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.token = bl.scrambled(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        self.before = np.empty_like(self.token)
        if len(self.token):
            self.before[1:] = self.token[:-1]
            self.before[self.starts] = bl.scrambled(_END)[0]  # the end token: as of the document before
        self.pair = bl.scrambled(self.token * _PAIR[0] + self.before * _PAIR[1])
        self.train = np.repeat(~self.held, self.sizes)

    def lists(self) -> tuple[tuple, tuple]:
        weight = self.train.astype(np.int64)
        return bl.distinct(self.token, None, weight), bl.distinct(self.pair, None, weight)

    def counts(self, token_said: np.ndarray, pair_said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of each token, of the token before it and of the pair."""
        (keys, _, _, place), (_, _, _, pair_place) = self.lists()
        own = token_said[place].astype(np.int64)
        end = int(token_said[np.searchsorted(keys, bl.scrambled(_END)[0])]) if len(keys) else 0
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[self.starts] = end
        return own, context, pair_said[pair_place].astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the binary logarithm of its count."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def estimates(own: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of a token after its context, and of the token."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), own / max(total, 1)


def learned(cells: list[tuple[int, int, float, float]], uniform: float, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation on (bucket, tokens, mean pair and mean token estimate)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0.0, 0.5, 0.5)
    if not cells:
        weights[:] = (0.0, 0.0, 1.0)
        return weights
    bucket, n, two, one = (np.array(x) for x in zip(*cells, strict=True))
    p = np.stack([two, one, np.full(len(n), uniform)], 1)
    for _ in range(iterations):
        part = weights[bucket] * p
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, k], minlength=BUCKETS) for k in range(3)], 1)
        all_ = sums.sum(1, keepdims=True)
        weights = np.where(all_ > 0, sums / np.maximum(all_, 1e-300), weights)
    # a bucket without tokens takes the weights of the nearest lower one that has some
    have = np.bincount(bucket, n, minlength=BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not have[b]:
            weights[b] = weights[b - 1] if b > 1 else (1 / 3, 1 / 3, 1 / 3)
    if not have[0]:
        rest = weights[:, 1:].sum(0)
        weights[0] = (0.0, *(rest / max(rest.sum(), 1e-300)))
    weights[0, 0] = 0.0
    return weights / weights.sum(1, keepdims=True)


def _floor_mix(weights: np.ndarray) -> np.ndarray:
    """Every text gets a probability over zero: at least a millionth of each bucket's weight is uniform."""
    out = weights * (1 - 1e-6)
    out[:, 2] += 1e-6
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    packed = bl.pack(docs, id_col, text_col, block_bytes)
    n_words = packed.agg(F.sum("n_words")).first()[0] or 0

    def lists(ids: list, texts: list[bytes], earlier: list[bytes]) -> list:
        return [(x[0], None, x[2]) for x in Tokens(ids, texts).lists()]

    replies = bl.totals(packed, lists, n_words, 2, False)
    parts_of_one = bl.parts_for(n_words)

    def said(reply_rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts, payloads = reply_rows.column("part").to_pylist(), reply_rows.column("payload")
        order = sorted(range(len(parts)), key=parts.__getitem__)
        both = [[bl.open_reply(payloads[i].as_py()) for i in order if (parts[i] >= parts_of_one) == late] for late in (False, True)]
        return tuple(np.concatenate(x) if x else np.empty(0, np.uint32) for x in both)

    sums = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("two", pa.float64()), ("one", pa.float64())])
    of_tokens = replies.where(F.col("block").isNull() & (F.col("part") < parts_of_one)).agg(F.sum("n_distinct"), F.sum("n_all")).first()
    vocabulary, total = of_tokens[0] or 0, of_tokens[1] or 0

    def gathered(block_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        if not block_rows.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in sums], schema=sums)
        t = Tokens(*bl.unpack(block_rows.column("payload")[0].as_py()))
        own, context, pair = (x[t.train] for x in t.counts(*said(reply_rows)))
        two, one = estimates(own - 1, context - 1, pair - 1, total - 1)  # each token's own occurrence deleted
        step = lambda x: np.where(x > 0, np.minimum((-FINE * np.log2(np.maximum(x, 1e-300))).astype(np.int64) + 1, STEPS - 1), 0)
        cell = (bucket_of(context - 1) << 20) + (step(two) << 10) + step(one)
        keys, index = np.unique(cell, return_inverse=True)
        columns = [keys, np.bincount(index, minlength=len(keys)), np.bincount(index, two, minlength=len(keys)), np.bincount(index, one, minlength=len(keys))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, sums, strict=True)], schema=sums)

    table = bl.with_replies(packed, replies, gathered, "cell bigint, n bigint, two double, one double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))
    uniform = 1 / (vocabulary + 1)
    # bounded by the number of cells, which doesn't grow with the corpus
    cells = sorted((r[0] >> 20, r[1], r[2] / r[1], r[3] / r[1]) for r in table.toLocalIterator())
    weights = _floor_mix(learned(cells, uniform))
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(block_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        if not block_rows.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in out], schema=out)
        ids, texts = bl.unpack(block_rows.column("payload")[0].as_py())
        t = Tokens(ids, texts)
        own, context, pair = t.counts(*said(reply_rows))
        two, one = estimates(own, context, pair, total)
        w = weights[bucket_of(context)]
        model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * uniform)
        base = np.log10((own + SMOOTHING) / (total + SMOOTHING * (vocabulary + 1)))
        by_doc = lambda x: np.add.reduceat(x, t.starts)
        columns = [ids, t.held, t.sizes, by_doc((own > 0).astype(np.int64)), np.full(len(ids), total), by_doc(base), by_doc(model)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    ddl = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return bl.with_replies(packed, replies, scored, ddl).withColumnRenamed("doc_id", id_col)


def brute_force(rows: list[tuple[int | None, str]]) -> list[tuple[int | None, bool, int, int, int, float]]:
    """All contract columns but the model's score, by dictionaries; for tests."""
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts: dict = {}
    for i, tokens in docs:
        if not is_held_out(i):
            for w in tokens:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(i, is_held_out(i), len(t), sum(w in counts for w in t), n, float(sum(np.log10((counts.get(w, 0) + SMOOTHING) / (n + SMOOTHING * (v + 1))) for w in t))) for i, t in docs]
