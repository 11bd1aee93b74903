"""Secret scan (operator 2): fixed patterns, and a character convolutional network over all candidates.

Candidates are the fixed patterns' matches and every long token that mixes letters and digits. The
network reads a whole candidate and the characters around it; it is trained on the driver on labelled
findings (made by rule; their number is a parameter). Its logits are calibrated by Platt scaling on a
part of them kept apart, and the threshold is the highest one that keeps the wanted recall there.
Base spans always stay; the network adds candidates that touch no base span and reach the threshold.

Defined cases: null text is empty and has no spans; repeated rows give repeated results; an empty
table an empty result; other columns of the input play no part. All scans are linear in the text.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import bounded, ids_and_texts

BASE_KINDS = ("assign", "access", "hex")
ADDED = "learned"
KIND_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, ADDED))}

_ASSIGN = re.compile(
    r"""([pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate of the network has so many characters at least, a digit and a letter among them; words without a
#: digit are never read.
LEAST_CANDIDATE = 16
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST_CANDIDATE)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

BEFORE, AFTER = 24, 8
#: A longer candidate is read in stretches of so many characters.
STRETCH = 4_096
WIDTH, FILTERS, DEPTH = 5, 24, 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    signs = ":" in text or "=" in text  # without either there is no assignment
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if signs else []
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # shorter runs are the failing matches, and a longer one is taken whole from its start
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KIND_ORDER[s[0]]))



def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of LEAST_CANDIDATE characters or more, with a digit and a letter in them."""
    out = []
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(text, *m.span()) and _LETTER.search(text, *m.span()):
            out.append(m.span())
    return out


# --- labelled findings -----------------------------------------------------------------------------


def labelled_findings(rows: int = 2400, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, is a secret), by rule: invented keys in invented code, and look-alikes that are none."""
    rng = random.Random(seed)
    letters = string.ascii_letters + string.digits
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    syllables = "an on er th re in ou ti le de en is la ca mo ri so ver ich que ion el ar to ne config data model image page file".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def secret() -> tuple[str, str]:
        kind = rng.randrange(6)
        if kind == 0:
            return some(letters, rng.randint(20, 60)), rng.choice(["key = ", "auth: ", "credential=", "Bearer ", "Authorization: Bearer ", "pwd=", "private_key: "])
        if kind == 1:
            return "ghp_" + some(letters, 36), rng.choice(["", "use ", "export T=", "git clone with "])
        if kind == 2:
            return "sk_live_" + some(letters, 24), rng.choice(["", "stripe ", "key: "])
        if kind == 3:
            return "eyJ" + some(letters, 30) + "." + some(letters + "_-", 40) + "." + some(letters + "_-", 40), rng.choice(["", "jwt ", "cookie: "])
        if kind == 4:
            return some(letters + "+/", 40) + rng.choice(["", "=", "=="]), rng.choice(["aws_key=", "access ", "key: ", "secret access "])
        return "xoxb-" + some(string.digits, 12) + "-" + some(letters, 24), rng.choice(["", "slack "])

    def other() -> tuple[str, str]:
        kind = rng.randrange(8)
        if kind == 0:
            return "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 99)}.html", rng.choice(["see ", "in ", "open ", ""])
        if kind == 1:
            return "_".join(word() for _ in range(rng.randint(3, 5))) + f"_v{rng.randint(1, 9)}", rng.choice(["call ", "def ", ""])
        if kind == 2:
            return "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), rng.choice(["id ", "uuid: ", "request "])
        if kind == 3:
            return some("=-_", rng.randint(10, 30)) + word() + "1" + some("=-_", 10), ""
        if kind == 4:
            return f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{rng.randint(10, 59)}.{rng.randint(10, 59)}", "at "
        if kind == 5:
            return (word() * 8)[: rng.randint(16, 50)] + str(rng.randint(0, 9)), rng.choice(["the ", "and ", ""])
        if kind == 6:
            return f"www.{word()}{rng.randint(1, 99)}.{word()}.example.com", rng.choice(["at ", "//", ""])
        return some("0123456789", rng.randint(10, 20)) + "." + word() + some("0123456789", 6), rng.choice(["no. ", "number ", "part "])

    out = []
    for i in range(rows):
        token, cue = (secret if i % 2 else other)()
        head = " ".join(word() for _ in range(rng.randint(0, 6))) + rng.choice([" ", "\n", ""]) + cue
        tail = rng.choice([" ", '"', "\n", "; ", ", ", ""]) + " ".join(word() for _ in range(rng.randint(0, 3)))
        out.append((head + token + tail, len(head), len(head) + len(token), i % 2))
    rng.shuffle(out)
    return out


# --- the network --------------------------------------------------------------------------------------


@dataclass
class Net:
    """Character embedding, one convolution, the largest and the mean activation, one logit. About 2,000 weights."""

    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def inputs(self, found: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Character classes and a mask: 0 outside, 1 around the candidate, 2 in it; padded to the longest."""
        parts = [(t[max(0, a - BEFORE) : a], t[a:b], t[b : b + AFTER]) for t, a, b in found]
        most = max(sum(map(len, p)) for p in parts) + 2 * (WIDTH // 2)
        chars = np.zeros((len(parts), most), np.int64)
        mask = np.zeros((len(parts), most), np.int8)
        for row, marks, (head, own, tail) in zip(chars, mask, parts, strict=True):
            raw = np.frombuffer((head + own + tail).encode("utf-32-le", "replace"), "<u4")
            lo = WIDTH // 2
            row[lo : lo + len(raw)] = np.where((raw >= 32) & (raw < 127), raw - 30, 1)
            marks[lo : lo + len(raw)] = 1
            marks[lo + len(head) : lo + len(head) + len(own)] = 2
        return chars, mask

    def forward(self, chars: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        x = np.concatenate([w["embed"][chars], (mask == 2)[:, :, None]], 2) * (mask > 0)[:, :, None]
        n = x.shape[1] - WIDTH + 1
        cols = np.concatenate([x[:, k : k + n] for k in range(WIDTH)], 2)
        z = cols @ w["conv"] + w["bias"]
        real = (mask[:, WIDTH // 2 : WIDTH // 2 + n] > 0)[:, :, None]
        a = np.maximum(z, 0) * real
        top = a.argmax(1)
        count = np.maximum(real.sum(1), 1)
        h = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.sum(1) / count], 1)
        return h @ w["out"] + w["off"], (cols, a, top, count, h)

    def long_logit(self, text: str, a: int, b: int) -> float:
        """forward() for one candidate of any length: the same largest and mean activations, taken stretch by stretch."""
        w, half = self.weights, WIDTH // 2
        lo, hi = max(0, a - BEFORE), min(len(text), b + AFTER)
        top, total = np.zeros(FILTERS), np.zeros(FILTERS)
        for at in range(lo, hi, STRETCH):
            to = min(at + STRETCH, hi)
            place = np.arange(at - half, to + half)
            inside = (place >= lo) & (place < hi)
            raw = np.full(len(place), 0, np.uint32)
            raw[inside] = np.frombuffer(text[max(at - half, lo) : min(to + half, hi)].encode("utf-32-le", "replace"), "<u4")
            chars = np.where((raw >= 32) & (raw < 127), raw.astype(np.int64) - 30, 1)
            x = np.concatenate([w["embed"][chars], ((place >= a) & (place < b))[:, None]], 1) * inside[:, None]
            n = to - at
            act = np.maximum(np.concatenate([x[k : k + n] for k in range(WIDTH)], 1) @ w["conv"] + w["bias"], 0)
            top, total = np.maximum(top, act.max(0)), total + act.sum(0, dtype=np.float64)
        return float(np.concatenate([top, total / (hi - lo)]) @ w["out"] + w["off"][0])

    def probability(self, found: list[tuple[str, int, int]], at_once: int = 40_000) -> np.ndarray:
        """Calibrated, for candidates of like length together, so that one long one pads no others."""
        out = np.zeros(len(found))
        for i, (text, a, b) in enumerate(found):
            if b - a > STRETCH:
                out[i] = self.long_logit(text, a, b)
        order = sorted((i for i, (_, a, b) in enumerate(found) if b - a <= STRETCH), key=lambda i: found[i][2] - found[i][1])
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * (found[order[to]][2] - found[order[to]][1] + BEFORE + AFTER) <= at_once:
                to += 1
            group = order[at:to]
            out[group] = self.forward(*self.inputs([found[i] for i in group]))[0]
            at = to
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * out + self.scale[1], -30, 30)))


def train(findings: list[tuple[str, int, int, int]], also: list[tuple[str, int, int, int]] = [], held: list[tuple[str, int, int, int]] = [], recall: float = 0.99, epochs: int = 5, batch: int = 64, rate: float = 0.01) -> Net:  # noqa: B006
    """Adam on two thirds of the findings and on `also`; Platt scaling and the threshold of the wanted recall on the
    last third and `held`: the threshold is the lower of those that keep the recall on either."""
    rng = np.random.default_rng(5)
    net = Net({
        "embed": rng.normal(0, 0.3, (98, DEPTH)),
        "conv": rng.normal(0, 0.2, (WIDTH * (DEPTH + 1), FILTERS)),
        "bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.2, 2 * FILTERS),
        "off": np.zeros(1),
    })
    cut = len(findings) * 2 // 3
    learn, keep = findings[:cut] + also, findings[cut:] + held
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), batch):
            rows = [learn[i] for i in order[at : at + batch]]
            chars, mask = net.inputs([r[:3] for r in rows])
            logit, (cols, a, top, count, h) = net.forward(chars, mask)
            gold = np.array([r[3] for r in rows], float)
            delta = (1 / (1 + np.exp(-logit)) - gold) / len(rows)
            dh = delta[:, None] * net.weights["out"][None]
            da = np.repeat((dh[:, FILTERS:] / count)[:, None], a.shape[1], 1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dh[:, None, :FILTERS], 1)
            dz = da * (a > 0)
            dcols = dz @ net.weights["conv"].T
            dembed = np.zeros_like(net.weights["embed"])
            n = a.shape[1]
            for k in range(WIDTH):
                part = dcols[:, :, k * (DEPTH + 1) : k * (DEPTH + 1) + DEPTH] * (mask[:, k : k + n] > 0)[:, :, None]
                np.add.at(dembed, chars[:, k : k + n], part)
            grads = {"embed": dembed, "conv": np.einsum("btc,btf->cf", cols, dz, optimize=True), "bias": dz.sum((0, 1)), "out": h.T @ delta, "off": delta.sum(keepdims=True)}
            step += 1
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    net.scale = platt(net.forward(*net.inputs([r[:3] for r in keep]))[0], np.array([r[3] for r in keep], float))
    parts = [x for x in (findings[cut:], held) if x]
    net.threshold = min((threshold_for(net.probability([r[:3] for r in x]), np.array([r[3] for r in x]), recall) for x in parts), default=1.0)
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    return net


def platt(logits: np.ndarray, gold: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic calibration, by Newton with smoothed targets."""
    n1, n0 = gold.sum(), len(gold) - gold.sum()
    target = np.where(gold > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logits, np.ones_like(logits)], 1)
    w = np.array([0.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, x.T @ (p - target)), -2, 2)
    return float(w[0]), float(w[1])


def threshold_for(p: np.ndarray, gold: np.ndarray, recall: float) -> float:
    """The highest threshold at which the share of true findings at or over it is at least recall."""
    true = np.sort(p[gold > 0])
    return float(true[int(np.floor((1 - recall) * len(true)))]) if len(true) else 1.0


@functools.cache
def default_net() -> Net:
    hand = lambda part, copies: labelled.secret_rows(part, copies)
    return train(labelled_findings(), hand("train", 10), hand("calibrate", 20))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """(id, kinds, starts, ends, is_base, scores): arrays over all spans of a text, by start, then kind as listed.

    scores: the network's calibrated probability of the span, base spans included.
    """
    net = net or default_net()
    schema = pa.schema([("key", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("is_base", pa.list_(pa.bool_())), ("scores", pa.list_(pa.float64()))])

    def done(pairs: list[tuple[object, str]]) -> Iterator[tuple]:
        found: list[list[tuple[str, int, int]]] = []
        for _, text in pairs:
            base = base_spans(text)
            taken = sorted((a, b) for _, a, b in base)
            reach = list(itertools.accumulate((b for _, b in taken), max))
            more = []
            for a, b in candidates(text):
                before = bisect.bisect_left(taken, (b, -1))
                if not before or reach[before - 1] <= a:
                    more.append((ADDED, a, b))
            found.append(base + more)
        flat = [(pairs[i][1], a, b) for i, spans in enumerate(found) for _, a, b in spans]
        scores = iter(net.probability(flat).tolist() if flat else [])
        for (key, _), spans in zip(pairs, found, strict=True):
            scored = [(*s, next(scores)) for s in spans]
            kept = sorted((s for s in scored if s[0] != ADDED or s[3] >= net.threshold), key=lambda s: (s[1], KIND_ORDER[s[0]]))
            yield key, [s[0] for s in kept], [s[1] for s in kept], [s[2] for s in kept], [s[0] != ADDED for s in kept], [s[3] for s in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                pairs, size = [], 0
                for pair in ids_and_texts(batch):
                    pairs.append(pair)
                    size += len(pair[1])
                    if size > 4 << 20:
                        yield from done(pairs)
                        pairs, size = [], 0
                yield from done(pairs)

        yield from bounded(rows(), schema)

    out = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "key bigint, kinds array<string>, starts array<bigint>, ends array<bigint>, is_base array<boolean>, scores array<double>").withColumnRenamed("key", id_col)


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns; the n_ columns count base spans."""
    zipped = F.transform(F.arrays_zip("kinds", "starts", "ends", "is_base"), lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("said"), s["is_base"].alias("base")))
    base = F.filter("spans", lambda s: s["base"])
    said = find(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), zipped.alias("spans"))
    return said.select(
        "doc_id",
        *[F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, lambda s: s["said"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", lambda s: s["said"]), ",").alias("spans"),
    )
