"""Spelling variants: words one edit apart, grouped under their frequent forms (operator 11).

Words are runs of letters (A-Z in lower case), of which a hash of document and run shortens one in 31 by a
letter; kept are those of at least 7 letters and 2 occurrences. Two words are near if one inserted,
deleted or replaced code point turns one into the other.

Each word is cut into two halves. One edit leaves a half as it is: the first half then begins the other
word, or the second half ends it. Aho-Corasick automata, one a shard, hold the halves of all words, and all
words are scanned through them; a match counts only where a first half lies at offset 0 or a second
half at the end, and where the lengths differ by one at most; then the distance is verified. A pair that both
halves find is counted by the first, and one of unequal lengths where the longer word is scanned.

Shards: every half has at least three letters, so a first half is dealt by the hash of its first
three letters, a second half by that of its last three, and a word is scanned where its own first and last
three lead: twice, however many words there are. The number of shards grows with the halves. A shard
that a common beginning fills beyond SHARD_CHARS is split by the hash of its words, in parts of bounded size;
the words scanned there are dealt to as many blocks, and each part meets each block. Halves come before words in
a sorted partition, so a task holds one automaton and one batch of words. Under a half the words are kept
by the halves of their other half, one of which is also as it was, so that a common beginning isn't compared
with all words that have it.

A word has no more near words than its letters times the alphabet, whatever the corpus, so pairs don't grow with
the square; they are counted where they are found, and a count and the best form leave the task.

Defined cases: null text has no words; a null id is hashed as no digits; repeated rows count each; an empty table
gives an empty result; words of any length are whole; only the id and the text column are read.
"""

from __future__ import annotations

import functools
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_TIMES = 7, 2
#: One occurrence in so many loses a letter.
SHORTENED = 31
#: A form is this many times as frequent as the word.
FORM_RATIO = 10
#: Letters by which halves and words find each other's shard: no half has fewer.
KEY_CHARS = LEAST_CHARS // 2
#: Characters of the halves in one automaton.
SHARD_CHARS = 1 << 18
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000


def shortened(word: str, seed: int) -> str:
    """The word, or without the letter that its checksum picks; seed: the checksum of what comes before it."""
    h = zlib.crc32(word.encode(), seed)
    return word if h % SHORTENED else word[: (i := h % len(word))] + word[i + 1 :]


def text_words(doc_id: int | None, text: str, pattern: re.Pattern[str]) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text; a document's equal runs share their hash."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lower = text.encode().lower().decode()  # bytes: A-Z only
    for run, times in Counter(pattern.findall(lower)).items():
        word = shortened(run, seed)
        if len(word) >= LEAST_CHARS:
            yield word, times


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of the corpus that occur often enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs below the least length can't become longer; the quantifier is greedy, so matches are whole runs
        pattern = re.compile(f"[{LETTERS}]{{{LEAST_CHARS},}}")
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in ids_and_texts(batch):
                for word, times in text_words(doc_id, text, pattern):
                    held[word] += times
                if len(held) >= HELD_WORDS:
                    yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
                    held = Counter()
        yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

    texts = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def halves(word: str) -> tuple[str, str]:
    cut = len(word) // 2
    return word[:cut], word[cut:]


class Shard:
    """An automaton of halves, one side of the words: matches lead to the words that have the half."""

    def __init__(self, first: bool) -> None:
        self.first = first
        self.automaton = ahocorasick.Automaton()

    def add(self, word: str, n: int) -> None:
        half, other = halves(word) if self.first else halves(word)[::-1]
        held = self.automaton.get(half, None)
        if held is None:
            self.automaton.add_word(half, held := (len(half), {}))
        begins, ends = halves(other)
        held[1].setdefault((len(word), 0, begins), []).append((ends, word, n))
        held[1].setdefault((len(word), 1, ends), []).append((begins, word, n))

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """(near word, its n) for those of the shard's words that this side finds and that aren't longer, each once."""
        size = len(word)
        for end, (length, held) in self.automaton.iter(word):
            if end + 1 != (length if self.first else size):
                continue
            rest = word[length:] if self.first else word[: size - length]
            for other_size in (size - 1, size):
                if length != (other_size // 2 if self.first else other_size - other_size // 2):
                    continue
                cut = (other_size - length) // 2  # the halves of the other word's other half
                back = len(rest) - (other_size - length - cut)
                begins = rest[:cut]
                pieces = ((0, begins, rest[cut:]), (1, rest[back:], rest[:back]))
                for side, quarter, piece in pieces:
                    entries = held.get((other_size, side, quarter))
                    for left, other, n in one_off(entries, piece, other_size < size) if entries else ():
                        # a pair counts where its first half or quarter is in place
                        if (side == 0 or left != begins) and (self.first or not word.startswith(halves(other)[0])):
                            yield other, n


def one_off(entries: Sequence[tuple[str, str, int]], piece: str, shorter: bool) -> Sequence[tuple[str, str, int]]:
    """The entries whose first member, as long as piece or shorter by one, is exactly one edit from it."""
    if shorter:
        without = {piece[:k] + piece[k + 1 :] for k in range(len(piece))}
        return [e for e in entries if e[0] in without]
    return [e for e in entries if sum(map(operator.ne, piece, e[0])) == 1]


def neighbours(vocabulary: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near words; best: the most frequent, then the smallest of them."""
    key = lambda side: F.xxhash64(F.lit(side), F.substring("word", 1 if side == 0 else -KEY_CHARS, KEY_CHARS))
    both = vocabulary.select("word", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), key(s).alias("key")) for s in (0, 1)])).alias("x")).select("word", "n", "x.*")
    half_chars = F.ceil(F.length("word") / 2)
    total = vocabulary.agg(F.sum(half_chars)).first()[0] or 0
    dealt = both.withColumn("shard", F.pmod("key", F.lit(max(1, -(-total // shard_chars)))))
    load = dealt.groupBy("side", "shard").agg(F.ceil(F.sum(half_chars) / shard_chars).alias("parts"))
    sized = dealt.hint("merge").join(load, ["side", "shard"])
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    each = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    entries = sized.select("side", "shard", own.alias("part"), F.explode(each).alias("block"), F.lit(0).alias("role"), "word", "n")
    scanned = sized.select("side", "shard", F.explode(each).alias("part"), own.alias("block"), F.lit(1).alias("role"), "word", "n")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, built = None, None, False
        shorter: dict[str, list] = {}  # of the shard's words: count, best and its n among longer words

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            out = []
            for side, of, part, block, role, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (side, of, part, block) != at:
                    out += [(k, *v) for k, v in shorter.items()]
                    shorter = {}
                    at, shard, built = (side, of, part, block), Shard(side == 0), False
                if role == 0:
                    shard.add(word, n)
                    continue
                if not built:
                    shard.automaton.make_automaton()
                    built = len(shard.automaton) > 0
                found = list(shard.near(word)) if built else ()
                if found:
                    best, best_n = min(found, key=lambda x: (-x[1], x[0]))
                    out.append((word, len(found), best, best_n))
                for other, _ in found:
                    if len(other) < len(word):
                        held = shorter.setdefault(other, [0, word, n])
                        held[0] += 1
                        if (-n, word) < (-held[2], held[1]):
                            held[1:] = word, n
            yield rows(out)
        yield rows([(k, *v) for k, v in shorter.items()])

    keys = ["side", "shard", "part", "block"]
    sent = entries.unionByName(scanned).repartition(*keys).sortWithinPartitions(*keys, "role")
    found = sent.mapInArrow(run, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, from (word, form); forms are followed by doubling steps.

    A form is ten times as frequent as its word, so a chain has no cycle and no more steps than the
    counts have digits.
    """
    up = written(forms.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        further = up.hint("merge").join(above, "root", "left")
        if further.where("higher IS NOT NULL").isEmpty():
            return up
        up = written(further.select("word", F.coalesce("higher", "root").alias("root")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    vocabulary = written(words(docs, id_col, text_col))
    near = neighbours(vocabulary, shard_chars)
    frequent = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = vocabulary.hint("merge").join(near, "word", "left")
    formed = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")))
    of = roots(formed.where("form IS NOT NULL"))
    return formed.hint("merge").join(of, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The 256 terms of the CRC-32, from its polynomial.
_TABLE = "[" + ",".join(str(functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), k)) for k in range(256)) + "]"

ORACLE = rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ) WHERE length(run) >= 7 GROUP BY ALL),
sums AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS h FROM runs, (SELECT {_TABLE} AS t)),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM sums),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
holes AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM words, (SELECT unnest(range(1, (SELECT max(length(word)) FROM words) + 1)) AS k) WHERE k <= length(word)),
pairs AS (SELECT DISTINCT * FROM (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word)),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)),
chain AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN forms ON chain.at = forms.word WHERE forms.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
