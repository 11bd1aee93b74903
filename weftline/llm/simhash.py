"""SimHash near-duplicates by anchor-point covering (operator 4).

Fingerprints: 64 majority bits over the XXH64 (seed 42) of every three-word shingle of the whole,
ASCII-lower-cased text. Linked are fingerprints at most two bits apart.

The anchors are a covering code, the product of three perfect codes over the 64 bits: the binary
Golay code [23, 12] of covering radius 3 on bits 0-22 and again on bits 23-45, and the repetition
code [17, 1] of radius 8 on bits 46-62; bit 63 is left free. Every fingerprint has one home: the
anchor within the radius in each part. It visits every anchor that is at most radius + e away in each
part, where the excesses e add up to at most the threshold. If x and y differ in a, b and c bits of
the parts, y is at most radius + a, + b, + c from x's home, so with a + b + c <= 2 it visits there:
no link is lost. 2^25 anchors and about 65 visits a fingerprint, whatever the input's size. Homes and
visits meet in an equi-join on the anchor, which keeps true links only; a fingerprint has 2,080
neighbours at most, and equal texts are one fingerprint, so links can't grow with the square of a
group. Links become components by large-star and small-star rounds over written tables.

Defined cases: null text is empty; a text without words has fingerprint zero and is linked like any
other; null ids belong to their component but name it only if it has no other id; repeated rows give
repeated results; an empty table an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import hot_join, restored, row_struct, written

SHINGLE = 3
SEED = 42
THRESHOLD = 2
#: First bit and length of each part.
GOLAY_PARTS = ((0, 23), (23, 23))
REPEAT_PART = (46, 17)
GOLAY_POLYNOMIAL = 0b101011100011
ROUNDS = 60

_LANE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where there are fewer words."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = itertools.chain((0,), ends)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)  # noqa: B905


def fingerprint(text: bytes) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _LANE_BITS for k in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest) of every row; digest: MD5 of the text, null as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t or b"" for at in range(0, batch.num_rows, 256) for t in batch.column(1).slice(at, 256).cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64()), batch.column(2)], schema=schema)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest")).mapInArrow(run, "doc_id bigint, fp bigint, digest string")


# --- the covering code ------------------------------------------------------------------------------


@functools.cache
def golay(threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error patterns up to weight 3 + threshold: (offsets, patterns, excess over
    the radius); and the syndrome of each byte lane's values, to look syndromes up by XOR."""
    unit = []
    for bit in range(23):
        v = 1 << bit
        for shift in range(22, 10, -1):
            if v >> shift & 1:
                v ^= GOLAY_POLYNOMIAL << (shift - 11)
        unit.append(v)
    weights = range(3 + threshold + 1)
    patterns = [(w, sum(1 << b for b in bits), functools.reduce(lambda s, b: s ^ unit[b], bits, 0)) for w in weights for bits in itertools.combinations(range(23), w)]
    order = sorted(patterns, key=lambda x: (x[2], x[0], x[1]))
    syndromes = np.array([x[2] for x in order])
    lanes = np.zeros((3, 256), np.int64)
    for lane in range(3):
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and 8 * lane + b < 23:
                    lanes[lane, value] ^= unit[8 * lane + b]
    return np.searchsorted(syndromes, np.arange(2049)), np.array([x[1] for x in order], np.int64), np.array([max(0, x[0] - 3) for x in order]), lanes


def golay_anchors(part: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of all codewords at most radius + threshold from each value."""
    offsets, patterns, excess, lanes = golay(threshold)
    syndrome = lanes[0][part & 255] ^ lanes[1][part >> 8 & 255] ^ lanes[2][part >> 16]
    count = offsets[syndrome + 1] - offsets[syndrome]
    row = np.repeat(np.arange(len(part)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[syndrome], count)
    return row, part[row] ^ patterns[at], excess[at]


def repeat_anchors(part: np.ndarray, length: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the repetition code: the majority's word, and the other where the vote is near a tie."""
    ones = np.bitwise_count(part).astype(np.int64)
    home = (2 * ones > length).astype(np.int64)
    other = np.maximum(ones, length - ones) - length // 2  # distance of the other word, less the radius
    near = np.flatnonzero(other <= threshold)
    rows = np.arange(len(part))
    return np.concatenate([rows, near]), np.concatenate([home, 1 - home[near]]), np.concatenate([np.zeros_like(home), other[near]])


def covering(values: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of each signed fingerprint's anchors; the home is the one without excess."""
    bits = values.view(np.uint64)
    cut = lambda lo, n: ((bits >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)
    row, anchor, excess = golay_anchors(cut(*GOLAY_PARTS[0]), threshold)
    for k, (r, a, e) in enumerate((golay_anchors(cut(*GOLAY_PARTS[1]), threshold), repeat_anchors(cut(*REPEAT_PART), REPEAT_PART[1], threshold))):
        order = np.argsort(r, kind="stable")
        r, a, e = r[order], a[order], e[order]
        starts = np.searchsorted(r, np.arange(len(values) + 1))
        count = (starts[1:] - starts[:-1])[row]
        left = np.repeat(np.arange(len(row)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[:-1][row], count)
        total = excess[left] + e[right]
        near = total <= threshold
        row, excess = row[left][near], total[near]
        anchor = anchor[left][near] << (23 if k == 0 else 1) | a[right][near]
    return row, anchor, excess


def visits(distinct: DataFrame) -> DataFrame:
    """(anchor, fp, home) rows of a table of distinct fingerprints."""
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                values = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False)
                row, anchor, excess = covering(values)
                yield pa.record_batch([pa.array(anchor), pa.array(values[row]), pa.array(excess == 0)], schema=schema)

    return distinct.select("fp").mapInArrow(run, "anchor bigint, fp bigint, home boolean")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of fingerprints at most two bits apart, each once."""
    all_visits = visits(distinct)
    homes = all_visits.where("home").select("anchor", F.col("fp").alias("a"))
    guests = all_visits.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    # a pair meets at either's home; a < b there keeps the meeting at a's. The planner takes visits to be as few
    # as the fingerprints and would broadcast them, so it is told to sort and merge.
    return homes.hint("merge").join(guests, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


# --- components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of every node that has a link; root: the smallest node of its component.

    Large-star hangs a node's larger neighbours on the smallest of its neighbourhood, small-star its
    smaller ones; both keep the components, and alternating them ends in stars. Least neighbours are found
    by partial aggregation, and the edges of a node with a thousandth of them meet its least one by a
    broadcast, so a star's centre fills no task. Each round is written to the shared folder, so no lineage
    grows, and only two sums reach the driver.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"))
    before, n = None, edges.count()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("times"))
        large = hot_join(both, lowest, ["u"], "times", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = hot_join(large, lowest, ["u"], "times", 2 * n)
        edges = written(small.select("v", "m").where("v != m").union(lowest.select("u", "m")).toDF("u", "v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, digest, root, component_id) of every row: root is the smallest fingerprint that its links reach,
    component_id the smallest id of all rows that they reach."""
    return rooted(written(fingerprints(docs, id_col, text_col)), links)


def rooted(rows: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows (doc_id, fp, digest) with the root and the component_id that the links of their fingerprints give."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    n_rows, n_distinct = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    roots = written(components(linked(distinct)))
    of_root = written(distinct.hint("merge").join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root")))
    named = of_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    of_fp = written(hot_join(of_root, named, ["root"], "members", n_distinct).select("fp", "root", "component_id", "times"))
    return hot_join(rows, of_fp, ["fp"], "times", n_rows).select("doc_id", "fp", "digest", "root", "component_id")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: Callable[..., DataFrame] = grouped) -> DataFrame:
    """Of each component the row with the smallest id; of rows that share it, the one with the smallest MD5 of its text.

    Rows with a null id stay only where their component has no other id. Texts are shuffled once, for the
    semi-join; only where rows equal in id and text exist are those numbered as well, and one stays.
    """
    narrow = written(group(docs, id_col, text_col))
    named = narrow.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = written(named.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.digest").alias("_digest")).distinct())
    key, digest = F.col(f"_row.`{id_col}`").cast("long"), F.md5(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(row_struct(docs).alias("_row"))
    held = rows.join(winners, key.eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")
    if narrow.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        place = F.row_number().over(W.partitionBy("_key", "_digest").orderBy(F.xxhash64("_row")))
        held = held.select("_row", key.alias("_key"), digest.alias("_digest")).withColumn("_place", place).where("_place = 1")
    return restored(held, docs.columns)
