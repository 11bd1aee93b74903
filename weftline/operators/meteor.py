"""METEOR of captions: alignments of words and stems with the fewest chunks.

An alignment pairs words of the candidate with words of a reference, each at most once, that are equal or have one stem. Of
all alignments with the most pairs, and among them the most equal ones, the one with the fewest chunks counts, a
chunk being a stretch of pairs that are neighbours on both sides. It is searched from left to right over states (reference words
in use that another word could also take, place of the last pair), of which each holds its best count; only words
that occur more than once on the reference's side branch. Beyond BEAM states the best go on, which no caption that was seen
needs: alignment() says whether the search was exact.

Score: P and R are the shares of the words in pairs, stems counting STEM, F = P R / (ALPHA P + (1 - ALPHA) R), less GAMMA
times the share of chunks among pairs to the power BETA. Of several references the best counts. The corpus's score is made of the
sums over candidates, each with its best reference. Synonyms and paraphrases need tables that aren't here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.captions import caption_words, stem

#: Parameters of the metric as first published (fixed values).
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: What a pair of stems counts.
STEM = 1.0
BEAM = 256


@dataclass(frozen=True)
class Aligned:
    """Pairs, those of equal words among them, chunks, and whether no state was left out."""

    pairs: int
    equal: int
    chunks: int
    exact: bool = True


def alignment(candidate: Sequence[str], reference: Sequence[str], beam: int = BEAM) -> Aligned:
    stems = [stem(w) for w in reference]
    places: dict[str, list[int]] = {}
    for j, s in enumerate(stems):
        places.setdefault(s, []).append(j)
    left = Counter(stem(w) for w in candidate)
    # of each stem as many words stay without a pair as the reference has too few
    spare = {s: max(0, n - len(places.get(s, ()))) for s, n in left.items()}
    free = {s: len(js) == 1 and left[s] == 1 for s, js in places.items()}
    names = sorted(s for s in left if spare[s] and s in places)
    # (used, last place, spares left) -> (pairs, equal, -chunks)
    states: dict[tuple, tuple[int, int, int]] = {(0, -2, tuple(spare[s] for s in names)): (0, 0, 0)}
    exact = True
    for word in candidate:
        s, after = stem(word), {}
        for (used, last, spares), (pairs, equal, chunks) in states.items():
            steps = []
            k = names.index(s) if s in names else -1
            if s not in places:
                steps.append((used, -2, spares, (pairs, equal, chunks)))
            else:
                if k >= 0 and spares[k]:
                    steps.append((used, -2, (*spares[:k], spares[k] - 1, *spares[k + 1 :]), (pairs, equal, chunks)))
                for j in places[s]:
                    if not used >> j & 1:
                        taken = used if free[s] else used | 1 << j
                        steps.append((taken, j, spares, (pairs + 1, equal + (reference[j] == word), chunks - (j != last + 1))))
            for *key, value in steps:
                key = tuple(key)
                if key not in after or after[key] < value:
                    after[key] = value
        if len(after) > beam:
            exact = False
            after = dict(sorted(after.items(), key=lambda x: x[1], reverse=True)[:beam])
        states = after
    pairs, equal, chunks = max(states.values(), default=(0, 0, 0))
    return Aligned(pairs, equal, -chunks, exact)


def score(pairs: float, equal: float, chunks: float, words: float, told: float) -> float:
    """The metric of sums: pairs and equal ones among them, chunks, and words on both sides."""
    weight = equal + STEM * (pairs - equal)
    if not weight or not words or not told:
        return 0.0
    p, r = weight / words, weight / told
    f = p * r / (ALPHA * p + (1 - ALPHA) * r)
    return f * (1 - GAMMA * (chunks / pairs) ** BETA)


def meteor(captions: DataFrame, key: str, candidate: str, references: str) -> DataFrame:
    """(key, pairs, equal, chunks, words, told, score) of each candidate against the best of its references (an array of texts).

    Null texts have no words; without references, or without words on a side, the score is 0.
    """
    kind = captions.schema[key].dataType.simpleString()
    names = ["pairs", "equal", "chunks", "words", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, best = caption_words(text), None
                for reference in told or [None]:
                    other = caption_words(reference)
                    a = alignment(words, other)
                    row = (a.pairs, a.equal, a.chunks, len(words), len(other))
                    if best is None or score(*row) > best[-1]:
                        best = (*row, score(*row))
                rows.append(best)
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64()] * 5 + [pa.float64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["key", *names, "score"])

    rows = captions.select(F.col(key).alias("key"), F.col(candidate).alias("c"), F.col(references).alias("r"))
    return rows.mapInArrow(run, f"key {kind}, {', '.join(n + ' bigint' for n in names)}, score double").withColumnRenamed("key", key)


def corpus_meteor(rows: DataFrame) -> DataFrame:
    """One row (n, meteor) of what meteor() gives: the metric of the sums, as published for corpora."""
    s = {c: F.sum(c).alias(c) for c in ("pairs", "equal", "chunks", "words", "told")}
    weight = F.col("equal") + STEM * (F.col("pairs") - F.col("equal"))
    p, r = weight / F.col("words"), weight / F.col("told")
    f = p * r / (ALPHA * p + (1 - ALPHA) * r)
    value = f * (1 - GAMMA * F.pow(F.col("chunks") / F.col("pairs"), F.lit(BETA)))
    return rows.agg(F.count("*").alias("n"), *s.values()).select("n", F.when(F.col("pairs") > 0, value).otherwise(0.0).alias("meteor"))
