"""Personal data (operator 1): fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans, which always stay. The field labels the words of every line from
their shapes and their neighbours' shapes, is trained on the driver from a small labelled table
(`labelled_table`, made by rule; its size is a parameter), and is decoded by Viterbi over padded
numpy batches. It adds spans of kinds that no fixed pattern can hold: people, street addresses,
national numbers, phone numbers without a plus sign and written-out mail addresses.

Defined cases: null text is empty and has no spans; repeated rows give repeated results; an empty
table an empty result; other columns of the input play no part. All scans are linear in the text.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import bounded, ids_and_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("person", "ssn", "address")
#: "local" is what stands before the "at" of a written-out mail address, so that none begins with it.
LABELS = ("O", "email", "phone", "person", "ssn", "address", "local")
SPANS = {"local": "email"}
KIND_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, as the groups are greedy
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the mail pattern, found from each @ so that long runs of local characters cost no more than their length."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        hit = _DOMAIN.match(text, at) if start < at else None
        low = hit.end() if hit else at + 1
        if hit:
            yield start, hit.end()
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches that don't overlap, kind by kind; those that fail their check are dropped."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- features -----------------------------------------------------------------------------------

#: Words whose identity counts as a feature; all others are known by shape alone.
CUES = frozenset(
    "mr mrs ms dr prof name named contact signed born call phone tel telephone mobile fax cell ssn social security number no "
    "street st avenue ave road rd lane ln drive boulevard blvd way court apt suite at (at) [at] dot (dot) [dot] mail email e-mail write address lives "
    "is am i my this dear by author patient attn regards sincerely thanks hello customer tenant employee ring text line reach "
    "ship send deliver visit billing com org net".split()
)
#: Cues that end with a point before a name.
TITLES = frozenset("mr mrs ms dr prof".split())
OFFSETS = (-2, -1, 0, 1, 2)
DIMENSIONS = 1 << 13
EDGE = "\x00edge"


def shape(word: str, runs: bool) -> str:
    """Letters as X or x, digits as d; with runs, a run of one kind counts once."""
    out = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", out) if runs else out


def features(word: str) -> tuple[str, ...]:
    """What the field sees of a word. Long words are seen by their run shape and length class only."""
    if word == EDGE:
        return ("edge",)
    core = word.strip(".,;:!?()[]\"'")
    low = core.lower()
    n = len(core)
    if core.isalpha():  # most words: the run shape needs no scan
        run = "rx" if core.islower() else "rX" if core.isupper() and n > 1 else "rXx" if core[0].isupper() and (n == 1 or core[1:].islower()) else "rXXx" if core[:2].isupper() else "rmixed"
        found = ["letters", run]
        ends = word[-1] if word[-1] in ".,;:!?" else ""
        if low in CUES:
            found.append("w" + low + ends)  # a cue that ends its sentence is none, and Mr. is one
        if ends:
            found.append("p" + ends)
        if word[0] in "([":
            found.append("open")
        return tuple(found)
    found = [f"n{min(n, 12)}"] if any("0" <= c <= "9" for c in core[:32]) else ["letters"]
    found.append("r" + shape(core[:32], True)[:12])
    if found[0] != "letters" and n <= 16:
        found.append("s" + shape(core, False))
    if low in CUES:
        found.append("w" + low + (word[-1] if word[-1] in ".,;:!?" else ""))
    if word[-1:] in ".,;:!?":
        found.append("p" + word[-1])
    if word[:1] in "([":
        found.append("open")
    return tuple(found)


#: What features() gives for any lower-case word of letters that is no cue.
PLAIN = ("letters", "rx")


def slot(offset: int, feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{offset}|{feature}".encode(), digest_size=4).digest(), "little") % DIMENSIONS


# --- the labelled table ---------------------------------------------------------------------------


def labelled_table(rows: int = 1800, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Sentences and the label of each word, by rule: invented words around invented personal data."""
    rng = random.Random(seed)
    syllables = "an on er th re in ou ti le de en is la ca mo ri so ver ich que ion el ar to ne".split()
    cues = sorted(c for c in CUES if c.isalpha())
    small = "the of and to in is that for it as was with be by on la de les der und el".split()

    def word(cap: float = 0.0) -> str:
        if rng.random() < 0.35:
            w = rng.choice(small)
        else:
            w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = w.upper() if rng.random() < 0.02 else w
        return w.capitalize() if rng.random() < cap else w

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> list[str]:
        part = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))).capitalize()
        last = rng.choice([part, part, part, lambda: "Mc" + part(), lambda: "O'" + part(), lambda: f"{part()}-{part()}"])
        return rng.choice([[part()], [part(), last()], [part(), last()], [part(), rng.choice("ABCDEFGHJ") + ".", last()]])

    def phone() -> list[str]:
        """Groups of digits, seven to eleven of them, in whatever way they are set apart."""
        first = rng.choice([f"({digits(3)})", f"(0{digits(rng.randint(1, 4))})", f"0{digits(rng.randint(1, 4))}", digits(3), "1-" + digits(3)])
        rest = rng.choice([(3, 4), (3, 4), (4, 4), (2, 2, 2, 2), (3, 3), (6,), (7,), (3, 3, 2), (2, 2, 2)])
        mark = rng.choice("  --./")
        groups = mark.join(digits(n) for n in rest)
        joint = " " if first.endswith(")") else rng.choice([mark, " ", "-", "/", "/"])
        return rng.choice([first + joint + groups, first + joint + groups, first + joint + groups, f"{digits(3)}{rng.choice('-. ')}{digits(4)}"]).split()

    def noise() -> list[str]:
        kind = rng.random()
        if kind < 0.15:  # a word over and over, cues and capitals among them
            cue = rng.choice(cues)
            again = rng.choice([word(1.0), word(1.0) + ".", cue, cue.capitalize(), cue.capitalize() + rng.choice(["", ".", ","]), rng.choice("ABDIO") + rng.choice(["", ","]), "St.", "Dr.", "la"])
            return [word(1.0)] * rng.randint(0, 3) + [again] * rng.randint(3, 40)
        if kind < 0.35:  # cue words at the ends and beginnings of sentences, ss in capitals for one letter
            cue = rng.choice([c for c in cues if c not in TITLES])
            begun = lambda: rng.choice([word(1.0), word(1.0), "SS" + word().lower()]) + rng.choice(["", "", ".", ","])
            ended = [rng.choice([cue, cue.capitalize()]) + rng.choice(".,!")] if rng.random() < 0.6 else [rng.choice(["this", "this", cue]), word() + rng.choice("..,")]
            return [*ended, begun(), *([begun()] if rng.random() < 0.4 else []), rng.choice([rng.choice(cues).capitalize(), rng.choice(cues), word()]), word()]
        if kind < 0.43:  # at without an address
            at = ["at"] * rng.randint(1, 3)
            return rng.choice([[word(), *at, word()], [word(), word(), *at, word(), word(), rng.choice(["", word()]) or word()], ["At", *at, word() + "."], [word(1.0) + "."] * 3 + ["At"] * rng.randint(2, 30)])
        if kind < 0.46:
            return [rng.choice(["no.", "part", "serial", "order", "isbn", "version", "page", "of", "total", "in"]), rng.choice("-. ").join(digits(rng.randint(1, 5)) for _ in range(rng.randint(1, 5)))]
        if kind < 0.49:
            return [digits(rng.randint(1, 6))]
        if kind < 0.55:
            return ["|", word(0.5), "|", digits(2)]
        if kind < 0.65:
            return [word().capitalize() + ".", word(1.0), word(1.0)]
        if kind < 0.75:
            return [digits(2) + "." + digits(2), digits(4) + "-" + digits(2) + "-" + digits(2)]
        if kind < 0.85:
            return [word() + rng.choice(["###", "%%%", "&&&", "***", "$$$"]), word().upper() + ".!!"]
        return [rng.choice(["number", "street", "name", "call", "at", "way", "no", "born", "court"]), word(), digits(3)]

    def entity() -> tuple[list[str], list[str], int]:
        kind = rng.choice([*LABELS[1:-1], "person", "person"])
        if kind == "person":
            title = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Mr", "Mrs", "Ms", "Dr", "Prof"]
            cue = rng.choice([*[[t] for t in title], ["name:"], ["Name:"], ["Contact:"], ["contact"], ["Signed:"], ["Attn:"], ["Author:"], ["my", "name", "is"], ["Dear", rng.choice(title)], ["named"],
                              ["I", "am"], ["This", "is"], ["by"], ["regards,"], ["Thanks,"], ["sincerely,"], ["Patient", "name:"], ["Patient:"], ["ask", "for"]])
            return cue, name(), LABELS.index(kind)
        if kind == "phone":
            cue = rng.choice([["call"], ["Call"], ["phone:"], ["phone"], ["tel"], ["Tel."], ["Fax:"], ["fax"], ["Mobile"], ["mobile:"], ["cell"], ["cell", "is"], ["number", "is"], ["ring"], ["text", "me", "on"], ["reach", "us", "on"], ["Telephone"], ["line:"]])
            return cue, phone(), LABELS.index(kind)
        if kind == "ssn":
            return rng.choice([["SSN"], ["ssn:"], ["social", "security", "number"], []]), [f"{digits(3)}-{digits(2)}-{digits(4)}"], LABELS.index(kind)
        if kind == "address":
            road = rng.choice(["Street", "St.", "Avenue", "Ave.", "Road", "Rd.", "Lane", "Drive", "Blvd", "Way", "Court"])
            return rng.choice([["address:"], ["Address"], ["lives", "at"], ["to"], ["at"], []]), [digits(rng.randint(1, 4)), word().capitalize(), road], LABELS.index(kind)
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
        own = rng.choice([[word() + digits(2)], [word()], [word(), dot, word()], [word(), dot, word()]])
        local.append(len(own))
        return rng.choice([["mail"], ["email:"], ["E-mail:"], ["write", "to"], ["email", "is"], ["send", "to"], ["under"], [], [], []]), [*own, at, word(), dot, rng.choice(["com", "org", "net", "de", "fr"])], LABELS.index(kind)

    local: list[int] = []  # words of the last mail address before its "at"
    out = []
    for _ in range(rows):
        words: list[str] = []
        labels: list[int] = []
        for _ in range(rng.randint(1, 3)):
            plain = [word(0.15) + (rng.choice(".,") if rng.random() < 0.15 else "") for _ in range(rng.randint(2, 7))]
            draw = rng.random()
            if draw > 0.9 and not words:
                plain = []  # a line may begin with what is to be found
            if draw < 0.4:
                plain += noise()
            words += plain
            labels += [0] * len(plain)
            if draw > 0.55:
                cue, own, label = entity()
                if rng.random() < 0.2:
                    own = [*own[:-1], own[-1] + rng.choice(".,;")]
                words += cue + own
                labels += [0] * len(cue) + [LABELS.index("local") if LABELS[label] == "email" and k < local[-1] else label for k in range(len(own))]
                if LABELS[label] == "person" and not own[-1].endswith((".", ",", ";")) and rng.random() < 0.3:
                    words.append(rng.choice(["lives", "is", "has", "and", "said", "name"]))
                    labels.append(0)
        out.append((words, labels))
    return out


# --- the field --------------------------------------------------------------------------------------


class Field:
    """Weights of a linear-chain conditional random field; memory grows with neither texts nor vocabulary."""

    MEMO = 500_000

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.moves, self.first = weights, moves, first
        self._clear()

    def _clear(self) -> None:
        self.classes: dict[str, int] = {}
        self.by_features: dict[tuple[str, ...], int] = {}
        self.rows: list[np.ndarray] = []
        self.table: np.ndarray | None = None

    def class_of(self, word: str) -> int:
        got = PLAIN if word.isalpha() and word.islower() and word not in CUES else features(word)
        if got not in self.by_features:
            self.by_features[got] = len(self.rows)
            self.rows.append(np.stack([self.weights[[slot(o, f) for f in got]].sum(0) for o in OFFSETS]))
            self.table = None
        self.classes[word] = self.by_features[got]
        return self.by_features[got]

    def gains(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """What each label other than O scores over O at every position of all sequences in a row, and each sequence's start.

        The word at t is fed by those at t-2 to t+2; two edge words stand between sequences.
        """
        if len(self.classes) > self.MEMO or len(self.rows) > self.MEMO // 10:
            self._clear()
        gap = (EDGE, EDGE)
        flat: list[str] = [*gap]
        for s in sequences:
            flat += s
            flat += gap
        known = self.classes
        ids = np.array([known[w] if w in known else self.class_of(w) for w in flat], np.int32)
        if self.table is None or len(self.table) != len(self.rows):
            rows = np.stack(self.rows).astype(np.float32)
            self.table = np.ascontiguousarray((rows[:, :, 1:] - rows[:, :, :1]).transpose(1, 0, 2))
        n = len(ids) - 4
        out = self.table[0][ids[:n]]
        for k in range(1, len(OFFSETS)):
            out += self.table[k][ids[k : k + n]]
        starts = np.zeros(len(sequences), np.int64)
        np.cumsum([len(s) + 2 for s in sequences[:-1]], out=starts[1:])
        return out, starts

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each (not empty) sequence, by Viterbi over sequences of about one length at a time.

        A sequence in which no position gains enough to pay for the moves into and out of any label has O
        throughout as its best path, so Viterbi is spared there; this is a bound, not an estimate.
        """
        if not sequences:
            return []
        gains, starts = self.gains(sequences)
        stay = self.moves[0, 0]
        enter = max((self.moves[0, 1:] - stay).max(), (self.first[1:] - self.first[0]).max())
        inside, leave = max((self.moves[1:, 1:] - stay).max(), 0), max((self.moves[1:, 0] - stay).max(), 0)
        open_ = gains.max(1) >= -max(inside, enter + leave)
        lengths = np.array([len(s) for s in sequences])
        upto = np.concatenate([[0], np.cumsum(open_)])
        wanted = np.flatnonzero(upto[starts + lengths] > upto[starts])
        out: list[np.ndarray] = [np.zeros(n, np.int8) for n in lengths.tolist()]
        order = wanted[np.argsort(lengths[wanted], kind="stable")]
        at = 0
        while at < len(order):
            to, longest = at, lengths[order[at]]
            while to < len(order) and lengths[order[to]] <= max(16, 2 * longest) and (to - at + 1) * lengths[order[to]] <= 300_000:
                to += 1
            group = order[at : max(to, at + 1)]
            at += len(group)
            scores = np.zeros((len(group), int(lengths[group[-1]]), len(LABELS)), np.float32)
            for row, i in zip(scores, group, strict=True):
                row[: lengths[i], 1:] = gains[starts[i] : starts[i] + lengths[i]]
            for i, labels in zip(group, self.viterbi(scores, lengths[group]), strict=True):
                out[i] = labels
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        n, most, size = scores.shape
        back = np.zeros((most, n, size), np.int8)
        best = scores[:, 0] + self.first
        ends = np.empty((n, size), np.float32)
        ends[lengths == 1] = best[lengths == 1]
        live = n - np.searchsorted(lengths, np.arange(most), side="right")  # lengths ascend, so the live ones come last
        for t in range(1, most):
            low = n - live[t]
            options = best[low:, None, :] + self.moves.T[None]  # to, from
            came = options.argmax(2)
            back[t, low:] = came
            best[low:] = np.take_along_axis(options, came[:, :, None], 2)[:, :, 0] + scores[low:, t]
            done = slice(low, n - live[t + 1] if t + 1 < most else n)
            ends[done] = best[done]
        state = ends.argmax(1).astype(np.int8)
        labels = np.zeros((n, most), np.int8)
        rows = np.arange(n)
        for t in range(most - 1, -1, -1):
            low = n - live[t]
            labels[low:, t] = state[low:]
            if t:
                state[low:] = back[t, rows[low:], state[low:]]
        return [labels[i, : lengths[i]] for i in range(n)]


def hand_written(part: str, copies: int = 4) -> list[tuple[list[str], list[int]]]:
    """Words and labels of the hand-written sentences of one part (see labelled.py)."""
    out = []
    for text, spans in labelled.pii_rows(part, copies):
        words = [m.span() for m in _NOT_SPACE.finditer(text)]
        kinds = [next((k for k, a, b in spans if w[0] < b and a < w[1]), "O") for w in words]
        said = [text[a:b] for a, b in words]
        labels = [LABELS.index(k) for k in kinds]
        for t, (w, k) in enumerate(zip(said, kinds, strict=True)):
            if k == "email" and any(x.strip("()[]") == "at" and kinds[u] == k for u, x in enumerate(said[t + 1 : t + 4], t + 1)) and w.strip("()[]") != "at":
                labels[t] = LABELS.index("local")
        out.append((said, labels))
    return out


def train(table: list[tuple[list[str], list[int]]], epochs: int = 6, rate: float = 0.25, decay: float = 1e-4, batch: int = 100) -> Field:
    """Adagrad on the conditional log-likelihood; gradients by the forward-backward pass in numpy."""
    size = len(LABELS)
    weights, moves, first = np.zeros((DIMENSIONS, size)), np.zeros((size, size)), np.zeros(size)
    squares = [np.full_like(x, 1e-8) for x in (weights, moves, first)]
    table = [row for row in table if row[0]]
    slots = []
    for words, _ in table:
        padded = [EDGE, EDGE, *words, EDGE, EDGE]
        seen = [features(w) for w in padded]
        slots.append([[slot(o, f) for o in OFFSETS for f in seen[t + 2 + o]] for t in range(len(words))])
    order = np.arange(len(table))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            grads = [-decay * weights, -decay * moves, -decay * first]
            for i in order[at : at + batch]:
                gold = np.array(table[i][1])
                e = np.stack([weights[s].sum(0) for s in slots[i]])
                n = len(e)
                ahead, behind = np.zeros((n, size)), np.zeros((n, size))
                ahead[0] = first + e[0]
                for t in range(1, n):
                    ahead[t] = _lse(ahead[t - 1][:, None] + moves, 0) + e[t]
                for t in range(n - 2, -1, -1):
                    behind[t] = _lse(moves + (e[t + 1] + behind[t + 1])[None], 1)
                total = _lse(ahead[-1], 0)
                mean = np.exp(ahead + behind - total)
                delta = -mean
                delta[np.arange(n), gold] += 1
                for t, s in enumerate(slots[i]):
                    np.add.at(grads[0], s, delta[t])
                grads[2] += delta[0]
                for t in range(1, n):
                    grads[1] -= np.exp(ahead[t - 1][:, None] + moves + (e[t] + behind[t])[None] - total)
                    grads[1][gold[t - 1], gold[t]] += 1
            for x, g, s in zip((weights, moves, first), grads, squares, strict=True):
                s += g * g
                x += rate * g / np.sqrt(s)
    return Field(weights.astype(np.float32), moves.astype(np.float32), first.astype(np.float32))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@functools.cache
def default_field() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    field = train(labelled_table() + hand_written("train", 8))
    return field.weights, field.moves, field.first


_EDGES = ".,;:!?\"'"


def line_spans(line: str, at: int, labels: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Runs of one label as spans, without the punctuation at their ends."""
    words = [m.span() for m in _NOT_SPACE.finditer(line)]
    kinds = [SPANS.get(LABELS[k], LABELS[k]) for k in labels]
    t = 0
    while t < len(kinds):
        kind = kinds[t]
        to = t
        while to < len(kinds) and kinds[to] == kind:
            to += 1
        if kind != "O":
            start, end = words[t][0], words[to - 1][1]
            whole = line[start:end]
            start += len(whole) - len(whole.lstrip(_EDGES))
            end -= len(whole) - len(whole.rstrip(_EDGES))
            if start < end:
                yield kind, at + start, at + end
        t = to


def added_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds in every line of every text."""
    lines: list[tuple[int, int, str]] = []
    sequences: list[list[str]] = []
    for i, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            if words := _NOT_SPACE.findall(line):
                lines.append((i, at, line))
                sequences.append(words)
            at += len(line) + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, at, line), labels in zip(lines, field.decode(sequences), strict=True):
        if labels.any():
            out[i] += line_spans(line, at, labels)
    return out


def merged(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and the added ones that touch none of them; by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    reach = list(itertools.accumulate((b for _, b in taken), max))
    keep = []
    for span in more:
        before = bisect.bisect_left(taken, (span[2], -1))  # those that begin before its end
        if not before or reach[before - 1] <= span[1]:
            keep.append(span)
    return sorted([*base, *keep], key=lambda x: (KIND_ORDER[x[0]], x[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(id, kinds, starts, ends, is_base): arrays over all spans of a text, by kind as listed, then start."""
    weights, moves, first = model or default_field()
    held = {"w": weights.astype(np.float32), "m": moves, "f": first}  # 200 KB, of fixed size
    schema = pa.schema([("key", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("is_base", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(held["w"], held["m"], held["f"])

        def done(pairs: list[tuple[object, str]]) -> Iterator[tuple]:
            for (key, text), more in zip(pairs, added_spans([t for _, t in pairs], field), strict=True):
                base = base_spans(text)
                spans = merged(base, more)
                known = set(base)
                yield key, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [s in known for s in spans]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                pairs, size = [], 0
                for pair in ids_and_texts(batch):
                    pairs.append(pair)
                    size += len(pair[1])
                    if size > 2 << 20:
                        yield from done(pairs)
                        pairs, size = [], 0
                yield from done(pairs)

        yield from bounded(rows(), schema)

    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "key bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, is_base array<boolean>").withColumnRenamed("key", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with every span replaced by its kind in angle brackets), for pipelines that mask personal data."""
    model = default_field()
    schema = pa.schema([("key", pa.int64()), ("masked", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, text in ids_and_texts(batch):
                    parts, at = [], 0
                    for kind, a, b in sorted(merged(base_spans(text), added_spans([text], field)[0]), key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            parts += [text[at:a], f"<{kind}>"]
                            at = b
                    yield key, "".join([*parts, text[at:]])

        yield from bounded(rows(), schema)

    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "key bigint, masked string").withColumnRenamed("key", id_col).withColumnRenamed("masked", text_col)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns; the n_ columns count base spans."""
    found = find(docs, id_col, text_col)
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends", "is_base"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("said"), s["is_base"].alias("base")))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    said = found.select(F.col(id_col).alias("doc_id"), spans.alias("spans"))
    return said.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, lambda s: s["said"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", lambda s: s["said"]), ",").alias("spans"),
    )
