"""Alignments against all alignments of short captions; stems and tokens."""

from __future__ import annotations

import itertools
import random

import pytest

from weftline.functions.captions import caption_words, stem, tokens
from weftline.operators import meteor


def every_alignment(candidate, reference):
    """Best (pairs, equal, -chunks) over all ways to pair words of one stem."""
    best = (0, 0, 0)
    choices = [[None, *[j for j, r in enumerate(reference) if stem(r) == stem(c)]] for c in candidate]
    for way in itertools.product(*choices):
        used = [j for j in way if j is not None]
        if len(used) == len(set(used)):
            chunks = sum(j is not None and (i == 0 or way[i - 1] is None or way[i - 1] != j - 1) for i, j in enumerate(way))
            best = max(best, (len(used), sum(j is not None and reference[j] == candidate[i] for i, j in enumerate(way)), -chunks))
    return best


def test_alignments_are_the_best_of_all():
    rng = random.Random(4)
    words = ["run", "running", "runs", "cat", "cats", "the", "on", "mat"]
    for _ in range(400):
        a, b = ([rng.choice(words[: rng.choice([3, 5, 8])]) for _ in range(rng.randint(0, 6))] for _ in range(2))
        got = meteor.alignment(a, b)
        assert got.exact and (got.pairs, got.equal, -got.chunks) == every_alignment(a, b), (a, b)


def test_a_narrow_beam_says_so():
    assert not meteor.alignment(["the"] * 12, ["the"] * 10, beam=20).exact
    assert meteor.alignment("a b c d e f".split(), "f e d c b a".split(), beam=2).exact


def test_scores():
    assert meteor.score(0, 0, 0, 3, 3) == 0 and meteor.score(3, 3, 1, 3, 3) == pytest.approx(1 - 0.5 / 27)
    p, r = 2 / 4, 2 / 5
    assert meteor.score(2, 1, 2, 4, 5) == pytest.approx(p * r / (0.9 * p + 0.1 * r) * 0.5)


def test_captions(spark):
    rows = [(1, "The cat's on the mat.", ["A dog barks", "the cat is on the mats"]), (2, None, ["x"]), (3, "a word", None), (4, "", []), (5, "same", ["same", "same"])]
    out = meteor.meteor(spark.createDataFrame(rows, "id int, c string, r array<string>"), "id", "c", "r")
    got = {r.id: r for r in out.collect()}
    assert (got[1].pairs, got[1].equal, got[1].chunks, got[1].words, got[1].told) == (5, 4, 2, 6, 6)
    assert got[1].score == pytest.approx(meteor.score(5, 4, 2, 6, 6)) and got[2].score == got[3].score == got[4].score == 0 and got[5].score == 0.5
    one = meteor.corpus_meteor(out).first()
    assert one.n == 5 and one.meteor == pytest.approx(meteor.score(6, 5, 3, 6 + 2 + 1, 6 + 1 + 1))
    assert meteor.corpus_meteor(out.limit(0)).first().meteor == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Don't stop, it's 3,000.5 (ok)!", ["do", "n't", "stop", ",", "it", "'s", "3,000.5", "-lrb-", "ok", "-rrb-", "!"]),
        ('"U.S. x-rays" -- cannot...', ["``", "u.s.", "x-rays", "''", "--", "can", "not", "..."]),
        ("They’re at 4:30 .5 a.b", ["they", "'re", "at", "4:30", ".5", "a.b"]),
        (" \n", []), (None, []), ("end. Start", ["end", ".", "start"]), ("'s n't", ["'s", "n't"]),
    ],
)
def test_tokens(text, want):
    assert tokens(text) == want


def test_stems_and_what_is_left_out():
    pairs = "caresses:caress ponies:poni agreed:agre hopping:hop filing:file happy:happi relational:relat vietnamization:vietnam triplicate:triplic adjustable:adjust adoption:adopt controll:control cease:ceas sky:sky is:is"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split()))
    assert caption_words('A "dog", running - fast!') == ["a", "dog", "running", "fast"]
