"""Substring dedup by repeated-phrase automata (operator 3).

A window is 35 consecutive words of one document. Every word goes that lies in a window whose words
also begin anywhere else, in another document or in the same one; windows are judged on the input.

1. Anchors. Of the eight-word phrases in a window the one with the smallest hash is its anchor. Equal
   windows have equal anchors at equal places, so a window whose anchor was selected once is unique.
2. Confirmation. The windows of recurring anchors are counted by 128-bit hashes over the corpus; those
   that begin at two places or more are confirmed.
3. Automata. From the confirmed passages of each block, windows are taken so that they cover the same
   words (one every 35 words and the last), and compiled into Aho-Corasick automata by pyahocorasick.
   Automata are sharded by block of documents, and within a block by a bounded number of phrases. All
   documents are streamed through the automata of their block, and every occurrence is marked.

A block's automata hold the confirmed passages that occur in it, not those of the whole corpus: passages
grow with the corpus, so streaming every document through every automaton would cost the square of it
(the README has the measured figures), and a passage that doesn't begin in a block has no occurrence there.

Defined cases: null text has no words; null ids are carried; repeated rows are copies of each other
like any equal texts; an empty table gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as bl

WINDOW = 35
PHRASE = 8
BLOCK_BYTES = 4 << 20
#: Phrases in one automaton: about 2 million nodes at most for common words.
PHRASES = 8_000


class Words:
    """Words of a block's documents, in a row, and the windows in them."""

    def __init__(self, texts: list[bytes], window: int, phrase: int) -> None:
        self.docs = [t.split() for t in texts]  # bytes split at ASCII white space
        self.flat = list(itertools.chain.from_iterable(self.docs))
        self.sizes = np.array([len(d) for d in self.docs], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.hashes = bl.word_hashes(self.flat)
        self.window, self.phrase = window, phrase
        n = len(self.flat) - window + 1
        if n <= 0:
            self.windows = np.empty(0, np.int64)
        else:
            owner = np.repeat(np.arange(len(self.docs)), self.sizes)
            self.windows = np.flatnonzero(owner[:n] == owner[window - 1 :])

    def sums(self, at: np.ndarray, length: int, seed: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k, m in enumerate(bl.multipliers(length, seed)):
            out += self.hashes[at + k] * m
        return bl.scrambled(out)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each phrase, places of selected anchors, for each window the index of its anchor among them)."""
        if not len(self.windows):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        n = len(self.flat) - self.phrase + 1
        value = self.sums(np.arange(n), self.phrase, 1)
        best, width, span = np.arange(n), 1, self.window - self.phrase + 1
        while 2 * width <= span:  # the leftmost smallest of 1, 2, 4, ... phrases
            best = self._least(value, best[: len(best) - width], best[width:])
            width *= 2
        if span > width:
            best = self._least(value, best[: n - span + 1], best[span - width : span - width + n - span + 1])
        chosen, index = np.unique(best[self.windows], return_inverse=True)
        return value, chosen, index

    @staticmethod
    def _least(value: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(value[right] < value[left], right, left)

    def candidates(self, said: np.ndarray) -> np.ndarray:
        """Windows whose anchor recurs, by the answers for the block's distinct anchors."""
        value, chosen, index = self.anchors()
        *_, place = bl.distinct(value[chosen])
        return self.windows[said[place][index]]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sums(at, self.window, 2), self.sums(at, self.window, 3)


def _said(payloads: list[bytes]) -> np.ndarray:
    return np.concatenate([bl.open_reply(p) for p in payloads]) if payloads else np.empty(0, bool)


def phrases_of(words: Words, confirmed: np.ndarray) -> set[str]:
    """Windows that cover what all confirmed windows cover: along each run one every window, and its last."""
    if not len(confirmed):
        return set()
    last = np.flatnonzero(np.append(np.diff(confirmed) != 1, True))
    first = np.append(0, last[:-1] + 1)
    starts = np.unique(np.concatenate([np.append(np.arange(confirmed[a], confirmed[b], words.window), confirmed[b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
    # a character a byte, and a space at either end, so that a match is one of whole words
    return {" " + b" ".join(words.flat[s : s + words.window]).decode("latin-1") + " " for s in starts.tolist()}


def covered(words: Words, phrases: set[str], most: int = PHRASES) -> np.ndarray:
    """Which words lie in an occurrence of a phrase: every document is streamed through every automaton of the block."""
    marks = np.zeros(len(words.flat) + 1, np.int64)
    if not phrases:
        return marks[:-1] > 0
    texts = [" " + b" ".join(d).decode("latin-1") + " " for d in words.docs]
    for shard in itertools.batched(sorted(phrases), most):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in shard:
            automaton.add_word(p)
        automaton.make_automaton()
        for text, doc, end in zip(texts, words.docs, words.ends.tolist(), strict=True):
            if len(doc) < words.window:
                continue
            hits = [e for e, _ in automaton.iter(text)]
            if hits:
                spaces = np.cumsum([len(w) + 1 for w in doc])  # place of the space after each word
                to = end - len(doc) + np.searchsorted(spaces, hits) + 1
                np.add.at(marks, to - words.window, 1)
                np.add.at(marks, to, -1)
    return np.cumsum(marks)[:-1] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE, block_bytes: int = BLOCK_BYTES, phrases_at_once: int = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary: the words that stay, joined by a space) of every row."""
    if not 0 < phrase <= window:
        raise ValueError("a phrase has at least one word and no more than a window")
    packed = bl.pack(docs, id_col, text_col, block_bytes)
    n_words = packed.agg(F.sum("n_words")).first()[0] or 0

    def anchors(ids: list, texts: list[bytes], earlier: list[bytes]) -> list:
        value, chosen, _ = Words(texts, window, phrase).anchors()
        high, _, counts, _ = bl.distinct(value[chosen])
        return [(high, None, counts)]

    def windows(ids: list, texts: list[bytes], earlier: list[bytes]) -> list:
        words = Words(texts, window, phrase)
        high, low, counts, _ = bl.distinct(*words.keys(words.candidates(_said(earlier))))
        return [(high, low, counts)]

    first = bl.totals(packed, anchors, n_words // 8, 1, True)
    second = bl.totals(packed, windows, n_words // 2, 1, True, first)
    late_parts = bl.parts_for(n_words // 8)  # replies to the first question come first when both are sorted by part
    both = first.select("block", "part", "payload").union(second.select("block", (F.col("part") + late_parts).alias("part"), "payload"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def cleaned(block_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        if not block_rows.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
        ids, texts = bl.unpack(block_rows.column("payload")[0].as_py())
        words = Words(texts, window, phrase)
        parts = reply_rows.column("part").to_pylist()
        payloads = reply_rows.column("payload")
        of = lambda late: _said([payloads[i].as_py() for i in sorted(range(len(parts)), key=parts.__getitem__) if (parts[i] >= late_parts) == late])
        at = words.candidates(of(False)) if len(words.windows) else words.windows
        *_, place = bl.distinct(*words.keys(at))
        gone = covered(words, phrases_of(words, at[of(True)[place]] if len(at) else at), phrases_at_once)
        kept, removed = [], []
        for doc, end in zip(words.docs, words.ends.tolist(), strict=True):
            mine = gone[end - len(doc) : end]
            removed.append(int(mine.sum()))
            kept.append(b" ".join(itertools.compress(doc, ~mine) if removed[-1] else doc))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(words.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    return bl.with_replies(packed, both, cleaned, "doc_id bigint, n_words bigint, n_removed bigint, kept binary").withColumnRenamed("doc_id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return dedup(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by a dictionary of all windows; for tests."""
    docs = [t.encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for d in docs:
        for i in range(len(d) - window + 1):
            seen[tuple(d[i : i + window])] = seen.get(tuple(d[i : i + window]), 0) + 1
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - window + 1) if seen[tuple(d[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(d), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(d) if j not in gone)).hexdigest()))
    return out


#: The same by grouping all windows by their words.
ORACLE = rf"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM docs)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY key) > 1),
gone AS (SELECT DISTINCT doc_id, i + s AS i FROM again, range({WINDOW}) r(s)),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.i) AS kept FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM docs d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
