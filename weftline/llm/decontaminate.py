"""Benchmark decontamination (operator 7): a BM25 inverted index of the test items, searched by block-max WAND.

The index holds, for every word of the items, which items have it and with which BM25 weight, each
divided by the item's weight with itself, so that 1 means that a passage has all the item's words.
Items stand in blocks; a word has one bound a block, its largest weight there, and one over all. Every
passage of every document (windows of twice the longest item, moved by half, so that any item lies whole
in some window) is a query of its distinct words. WAND goes set by set: a passage's words are put in
ascending order of their bounds over all blocks, and the pivot is the first at which the bounds add up
to the threshold. Items without a word from the pivot on can't reach it, so only blocks that such words
have are looked at, passages without a pivot not at all; of those blocks only the ones whose own bounds
add up to the threshold are scored. All items at or over it are retrieved, and no other is scored.
Retrieved pairs are then verified: shares of the five-word shingles of the item, of its question and of
its answer (the last sentence) that the passage has (64-bit hashes).

Numbers of items, document frequencies, mean and longest length are taken over all items first, in a
Spark aggregation. Items are then indexed in shards of bounded size (SHARD_BYTES of text, by a hash of
the item's id and text); each shard is one broadcast and one pass over the documents. As the statistics
are those of all items, scores and verdicts don't depend on how items are dealt to shards. A full shard
of 16 MB of text (47,523 items of 60 words, measured) is 122 MB as a broadcast and 150 MB in a worker.

Words are compared in lower case, without other characters than letters and digits at their ends.

Defined cases: null texts are empty; null ids are carried; an item without words can't be found; an item,
question or answer of fewer than five words is one shingle, which only a passage of just these words has
(short questions and answers are not asked for); items that are equal are each found; repeated rows give
repeated results; empty tables give empty results; only ids and texts are read, except in `keep_clean`,
which carries all columns in a struct.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import multipliers, scrambled
from .common import restored, row_struct, written

K1, B = 1.2, 0.75
BLOCK = 8
THRESHOLD = 0.5
OVERLAP, PART_OVERLAP = 0.6, 0.3
SHINGLE = 5
LEAST_STRIDE = 64
SHARD_BYTES = 16 << 20
#: Entries of one dense table of bounds or scores.
DENSE = 4_000_000
#: Words that a task remembers, and the longest of them in bytes.
MEMO, MEMO_BYTES = 500_000, 64

_TIMES = multipliers(SHINGLE, 23)

_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?])\s+(\S.*)$")


def normal(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else _ENDS.sub("", low)


def words_of(text: str) -> list[str]:
    return [w for w in map(normal, text.encode("utf-8", "replace").decode("utf-8").translate(_TO_SPACE).split(" ")) if w]


_TO_SPACE = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a single sentence is a question."""
    m = _LAST_SENTENCE.match(text.strip())
    return (m[1], m[2]) if m else (text, "")


def _shingles(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of n word numbers, ascending; of the whole where there are fewer."""
    if not len(ids):
        return np.empty(0, np.uint64)
    width = min(n, len(ids))
    at = np.arange(len(ids) - width + 1)
    sums = np.full(len(at), width, np.uint64)
    for k, m in enumerate(_TIMES[:width]):
        sums += (ids[at + k].astype(np.uint64) + np.uint64(2)) * m
    return np.unique(scrambled(sums))


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs to know of all items: how many have words, the mean and the largest number of them, and for
    each word of a shard how many items have it."""

    items: int
    mean: float
    longest: int
    having: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> Statistics:
        """From all items at once, where they are few."""
        told = [w for w in (words_of(t or "") for _, t in items) if w]
        return cls(len(told), sum(map(len, told)) / max(len(told), 1), max(map(len, told), default=0), dict(Counter(w for words in told for w in set(words))))


@dataclass
class Index:
    """Blocks of items in compressed rows by word; plain arrays, so that it travels well."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    item_ids: list = field(default_factory=list)
    longest: int = 0

    @classmethod
    def of(cls, items: list[tuple[object, str]], all_items: Statistics | None = None) -> Index:
        """An index of some items under the statistics of all (of these, if none are given)."""
        self, known = cls(), all_items or Statistics.of(items)
        told = [(i, words_of(t or ""), t or "") for i, t in items]
        told = sorted((x for x in told if x[1]), key=lambda x: (sorted(x[1])[0], x[2], str(x[0])))
        self.item_ids = [i for i, _, _ in told]
        self.longest = known.longest
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words, _ in told for w in words}))}
        word, item, weight = array("q"), array("q"), array("d")
        parts: list[list[np.ndarray]] = [[], [], []]
        self.asked = np.zeros((len(told), 3), bool)  # whether a part has a whole shingle
        for k, (_, words, text) in enumerate(told):
            weights = {}
            for w, c in Counter(words).items():
                have = known.having[w]
                idf = math.log(1 + (known.items - have + 0.5) / (have + 0.5))
                weights[w] = idf * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / known.mean))
            total = sum(weights.values())
            for w, x in weights.items():
                word.append(self.vocabulary[w])
                item.append(k)
                weight.append(x / total)
            for p, own in enumerate((words, *map(words_of, question_and_answer(text)))):
                parts[p].append(_shingles(np.array([self.vocabulary[w] for w in own], np.int64)))
                self.asked[k, p] = len(own) >= SHINGLE
        self.parts = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in parts]
        self.part_at = [np.cumsum([0, *map(len, x)]) for x in parts]
        self.blocks = -(-len(told) // BLOCK)
        # postings by word and item; (word, block) entries with their bounds over them
        words_, items_, weights_ = np.array(word, np.int64), np.array(item, np.int64), np.array(weight)
        order = np.lexsort((items_, words_))
        self.item, self.weight = items_[order], weights_[order]
        entry = words_[order] * max(self.blocks, 1) + self.item // BLOCK
        at = np.flatnonzero(np.diff(entry, prepend=-1))
        self.block = entry[at] % max(self.blocks, 1)
        self.bound = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.first = np.append(at, len(entry))
        self.word_at = np.searchsorted(entry[at] // max(self.blocks, 1), np.arange(len(self.vocabulary) + 1))
        self.top = np.maximum.reduceat(self.bound, self.word_at[:-1]) if len(at) else np.empty(0)
        return self

    def shares(self, item: int, shingles: np.ndarray) -> list[float]:
        """Of the item's, its question's and its answer's shingles the shares that are among these."""
        out = []
        for part, at in zip(self.parts, self.part_at, strict=True):
            own = part[at[item] : at[item + 1]]
            out.append(float(np.isin(own, shingles).sum()) / len(own) if len(own) else 0.0)
        return out

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, self.longest)

    def retrieve(self, passage: np.ndarray, word: np.ndarray, passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or over the threshold, from the distinct (passage, word) pairs, passages ascending."""
        out: list[tuple[np.ndarray, ...]] = []
        least = threshold - 1e-9
        # the pivot: words of a passage in ascending order of their bounds, added up within the passage
        order = np.lexsort((self.top[word], passage))
        passage, word = passage[order], word[order]
        upto = np.cumsum(self.top[word])
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        upto -= np.repeat((upto - self.top[word])[starts], np.diff(np.append(starts, len(passage))))
        essential = upto >= least
        step = max(1, DENSE // max(self.blocks, 1))
        for low in range(0, passages, step):
            lo, hi = np.searchsorted(passage, [low, low + step])
            after = np.flatnonzero(essential[lo:hi]) + lo
            if not len(after):
                continue
            own, at = _expanded(self.word_at, word[after])
            looked = np.zeros(min(step, passages - low) * self.blocks, bool)
            looked[(passage[after][own] - low) * self.blocks + self.block[at]] = True
            with_pivot = np.zeros(min(step, passages - low), bool)
            with_pivot[passage[after] - low] = True
            some = np.flatnonzero(with_pivot[passage[lo:hi] - low]) + lo
            own, at = _expanded(self.word_at, word[some])
            pair = (passage[some][own] - low) * self.blocks + self.block[at]
            live = looked[pair]
            pair, at = pair[live], at[live]
            bounds = np.bincount(pair, self.bound[at], minlength=1)
            hot = bounds >= least
            live = hot[pair]
            if not live.any():
                continue
            pair, at = pair[live], at[live]
            number = np.cumsum(hot) - 1  # of the pairs that are scored
            own, post = _expanded(self.first, at)
            slot = number[pair[own]] * BLOCK + self.item[post] % BLOCK
            scores = np.bincount(slot, self.weight[post], minlength=1)
            got = np.flatnonzero(scores >= least)
            of = np.flatnonzero(hot)[got // BLOCK]
            out.append((of // self.blocks + low, of % self.blocks * BLOCK + got % BLOCK, scores[got]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _expanded(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in rows, entry) for all entries of the compressed rows."""
    count = starts[rows + 1] - starts[rows]
    own = np.repeat(np.arange(len(rows)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[rows], count)


class Search:
    """An index with a task's memo of words."""

    def __init__(self, index: Index, threshold: float = THRESHOLD) -> None:
        self.index, self.threshold = index, threshold
        self.memo: dict[bytes, int] = {}

    def word_id(self, raw: bytes) -> int:
        """-2 for a word of no letters or digits, -1 for one that no item has."""
        w = normal(raw.decode("utf-8", "replace"))
        got = self.index.vocabulary.get(w, -1) if w else -2
        if len(raw) <= MEMO_BYTES:
            self.memo[raw] = got
        return got

    def hits(self, texts: list[bytes]) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each text: item -> best score and the overlaps of item, question and answer, verified only."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, stride = self.memo, self.index.stride
        ids, owner, place = [], [], []
        first = [0]
        for k, text in enumerate(texts):
            got = np.array([memo[w] if w in memo else self.word_id(w) for w in text.split()], np.int64)
            got = got[got > -2]
            ids.append(got)
            known = np.flatnonzero(got >= 0)
            at = known // stride
            windows = max(1, -(-len(got) // stride))
            # a place lies in the window that begins with its stretch and in the one before
            for shift in (0, 1):
                owner.append((first[-1] + at - shift)[at >= shift])
                place.append(got[known][at >= shift])
            first.append(first[-1] + windows)
        out: list[dict[int, tuple[float, float, float, float]]] = [{} for _ in texts]
        if not self.index.blocks:
            return out
        size = max(len(self.index.vocabulary), 1)
        pairs = np.unique(np.concatenate(owner) * size + np.concatenate(place))
        passage, item, score = self.index.retrieve(pairs // size, pairs % size, first[-1], self.threshold)
        of = np.searchsorted(first, passage, side="right") - 1
        for p, k, i, s in zip(passage.tolist(), of.tolist(), item.tolist(), score.tolist(), strict=True):
            low = (p - first[k]) * stride
            shares = self.index.shares(i, _shingles(ids[k][low : low + 2 * stride]))
            asked = self.index.asked[i, 1:]
            if shares[0] >= OVERLAP and all(x >= PART_OVERLAP for x, a in zip(shares[1:], asked, strict=True) if a):
                out[k][i] = max(out[k].get(i, (0.0, 0.0, 0.0, 0.0)), (round(s, 9), *shares))
        return out


def item_shards(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[object, str]], Statistics]]:
    """The items in lists of about SHARD_BYTES of text, by a hash of id and text, each with the statistics of all
    items for its words. What the driver holds at once is one shard and its words' counts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(words, pa.list_(pa.string()))], names=["item_id", "text", "words"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = written(rows.mapInArrow(told, f"item_id {kind}, text string, words array<string>").where(F.size("words") > 0))
    n, mean, longest, size = known.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words")), F.sum(F.octet_length("text"))).first()
    distinct = lambda df: df.select(F.explode(F.array_distinct("words")).alias("word"))
    shards = -(-(size or 0) // SHARD_BYTES)
    having = written(distinct(known).groupBy("word").agg(F.count("*").alias("n"))) if shards else None
    for k in range(shards):
        own = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        counts = having.join(distinct(own).distinct(), "word")
        yield [(r.item_id, r.text) for r in own.select("item_id", "text").collect()], Statistics(n, mean, longest, {r.word: r.n for r in counts.collect()})


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_md5, item_id, score, overlap, question_overlap, answer_overlap): a row for every verified pair of a document and an item."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = "doc_id bigint, text_md5 string, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("text_md5"))
    spark = docs.sparkSession
    parts = []
    for shard, known in item_shards(items, item_id_col, item_text_col):
        held = spark.sparkContext.broadcast(Index.of(shard, known))  # of SHARD_BYTES of text: the bound is by construction

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(held.value, threshold)
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    to, size = at, 0
                    while to < batch.num_rows and (size < 2 << 20 or to == at):
                        size += len(batch.column(1)[to].as_buffer() or b"") if batch.column(1)[to].is_valid else 0
                        to += 1
                    part = batch.slice(at, to - at)
                    at = to
                    texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                    found = [(k, i, x) for k, hits in enumerate(search.hits(texts)) for i, x in hits.items()]
                    if found:
                        ids, sums = part.column(0).to_pylist(), part.column(2).to_pylist()
                        table = [(ids[k], sums[k], search.index.item_ids[i], *x) for k, i, x in found]
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*table, strict=True), schema, strict=True)], schema=schema)

        parts.append(rows.mapInArrow(run, ddl))
    if not parts:
        return spark.createDataFrame([], ddl)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those in which an item was verified, columns as they were.

    What was found is written first, so the planner knows its size and broadcasts it only if it is small.
    """
    dirty = written(find(docs, items).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct())
    rows = docs.select(row_struct(docs).alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & F.md5(F.col("_row.text").cast("string")).eqNullSafe(F.col("_md5"))
    return restored(rows.join(dirty, same, "left_anti"), docs.columns)


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified pairs, scores rounded to six places."""
    numbers = ["score", "overlap", "question_overlap", "answer_overlap"]
    return find(docs, items).select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in numbers])


def _sql_words(text: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '')"


def _sql_shingles(words: str) -> str:
    return f"CASE WHEN len({words}) >= {SHINGLE} THEN list_distinct(list_transform(range(len({words}) - {SHINGLE - 1}), lambda i: array_to_string({words}[i + 1:i + {SHINGLE}], ' '))) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


def _sql_share(part: str) -> str:
    return f"CASE WHEN len({part}) > 0 THEN len(list_intersect({part}, have)) / CAST(len({part}) AS DOUBLE) ELSE 0.0::DOUBLE END"


_SPLIT = r"'(?s)^(.*[.!?])\s+(\S.*)$'"
_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
#: The same by scoring every item that has a word in common with a window, with no index and no bounds.
ORACLE = f"""
WITH docs AS (SELECT doc_id, {_sql_words("coalesce(text, '')")} AS w FROM documents),
items AS (SELECT * FROM (SELECT item_id, {_sql_words("text")} AS w,
    {_sql_words(f"CASE WHEN regexp_matches({_TRIMMED}, {_SPLIT}) THEN regexp_extract({_TRIMMED}, {_SPLIT}, 1) ELSE text END")} AS q,
    {_sql_words(f"CASE WHEN regexp_matches({_TRIMMED}, {_SPLIT}) THEN regexp_extract({_TRIMMED}, {_SPLIT}, 2) ELSE '' END")} AS a FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)) WHERE len(w) > 0),
facts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean, greatest({LEAST_STRIDE}, max(len(w))) AS stride FROM items),
counts AS (SELECT item_id, word, any_value(l) AS l, CAST(count(*) AS DOUBLE) AS c FROM (SELECT item_id, len(w) AS l, unnest(w) AS word FROM items) GROUP BY item_id, word),
having_ AS (SELECT word, CAST(count(*) AS DOUBLE) AS h FROM counts GROUP BY word),
weights AS (SELECT item_id, word, ln(1 + (n - h + 0.5) / (h + 0.5)) * c * ({K1} + 1) / (c + {K1} * (1 - {B} + {B} * l / mean)) AS x FROM counts JOIN having_ USING (word), facts),
shares AS (SELECT item_id, word, x / sum(x) OVER (PARTITION BY item_id) AS x FROM weights),
places AS (SELECT doc_id, word, (k - 1) // stride AS stretch FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs), facts WHERE word IN (SELECT word FROM having_)),
passages AS (SELECT DISTINCT doc_id, stretch - s AS win, word FROM places, (VALUES (0), (1)) v(s) WHERE stretch >= s),
found AS (SELECT doc_id, win, item_id, sum(x) AS s FROM passages JOIN shares USING (word) GROUP BY doc_id, win, item_id HAVING sum(x) >= {THRESHOLD} - 1e-9),
cut AS (SELECT doc_id, win, item_id, s, d.w[win * stride + 1:(win + 2) * stride] AS w FROM found JOIN docs d USING (doc_id), facts),
told AS (SELECT c.doc_id, c.item_id, c.s, {_sql_shingles("c.w")} AS have, {_sql_shingles("i.w")} AS iw, {_sql_shingles("i.q")} AS iq, {_sql_shingles("i.a")} AS ia, len(i.q) >= {SHINGLE} AS asks_q, len(i.a) >= {SHINGLE} AS asks_a FROM cut c JOIN items i USING (item_id)),
rated AS (SELECT doc_id, item_id, round(s, 9) AS s, {_sql_share("iw")} AS o, {_sql_share("iq")} AS oq, {_sql_share("ia")} AS oa, asks_q, asks_a FROM told),
best AS (SELECT doc_id, item_id, max([s, o, oq, oa]) AS b FROM rated WHERE o >= {OVERLAP} AND (NOT asks_q OR oq >= {PART_OVERLAP}) AND (NOT asks_a OR oa >= {PART_OVERLAP}) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, round(b[1], 6) AS score, round(b[2], 6) AS overlap, round(b[3], 6) AS question_overlap, round(b[4], 6) AS answer_overlap FROM best"""
