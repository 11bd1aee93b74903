"""Near copies by the Jaccard similarity of five-word shingles (the pipeline's near-dedup stage).

Linked are texts whose sets of five-word shingles (whole, ASCII-lower-cased text; 64-bit hashes) have a
similarity of 4/5 or more; links become components. Two searches find them.

The first is operator 4's: SimHash fingerprints, a covering code, a check, components. A set has WORDS
fingerprints, each of 64 majority bits over its own mix of the shingles' hashes. Of sets of similarity 4/5 a
tenth to a sixth of all bits differ, so one word within two bits is rare; of many words some meet. Each
word has its home among the anchors and visits those that are an excess of EXCESS or less away, so sets that differ
in fewer than (EXCESS + 1) * WORDS bits of all words visit an anchor together, and of others most do. A visitor is held
against one set that is at home there, by the bits of another word; a set's nearest ones are confirmed.

What fingerprints can't promise the second search finds, by prefixes: in any fixed order of all shingles, two sets
of similarity 4/5 share one among the first n - ceil(4n/5) + 1 of each, so no link is lost. The order is by hash,
with shingles that are frequent at the front of the sets put last, so that a common line fills no bucket.

Every candidate is confirmed on the whole sets, but few sets travel: each set has an odd sketch (which
of m slots hold an odd number of its hashes; m about its size, so an eighth of a byte a shingle). Two
sketches differ in no more slots than the sets differ in shingles, so a pair that differs in more than a
ninth of both sizes together is no link, and whole sets move for the pairs that are left alone.

The first search joins large groups of copies by a number of pairs that grows with the rows. In a bucket
(the sets that share a shingle of their prefixes) the sketches of all sets that are not yet in one
component are compared, where they lie. Of the pairs that may link only a spanning forest leaves the task, a row a set.
Its trees, joined over all buckets, are families: both sets of every pair that may link are in one. The whole sets of
a family meet, in tiles of bounded bytes; pairs that a longer sketch doesn't rule out and that aren't joined yet
are compared exactly, and the edges that join them leave. So no step makes a row a pair, however many copies of a text
lie just below the threshold.

Defined cases: as in simhash; a text of fewer than five words is one shingle; texts without words have
the empty set and are copies of each other.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import blocks as bl
from . import simhash
from .common import least_reached, sorted_groups, written

SHINGLE = 5
#: A shingle in the fronts of more sets than this goes last; with many rows, than a millionth of them.
FREQUENT = 32
#: Fingerprints of a set, and how far beyond the radius each visits anchors: 10 rows a fingerprint.
WORDS, EXCESS = 12, 1
#: Sets whose next words differ in more bits are not confirmed: of a similarity of 4/5 one in thousands.
APART = 20
#: Sets that one is confirmed against in the first search, the nearest by their next words.
NEAREST = 2
#: Bits of the maps of texts in pairs, and of shared shingles.
SLOTS, SHARED_SLOTS = 1 << 22, 1 << 26
LEAST_SKETCH = 64
#: Of sketches that are compared at once.
SKETCH_BYTES = 4 << 20
#: Sets of a bucket that meet in one group, on average.
TILE = 2_048
#: Rows of small groups that are met together.
MET_ROWS = 4_096
#: Bytes of the sets of a family in one tile, on average; two tiles meet in a group.
FAMILY_BYTES = 8 << 20
#: Slots a shingle of the sketches that a family's sets are held against each other by.
FINE_SLOTS = 4

_TIMES = bl.multipliers(SHINGLE, 17)
_MIXES = bl.multipliers(WORDS, 23)
_LANE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_NONE = np.empty(0, np.int64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct hashes of each text, in ascending order as unsigned numbers; hashed over all texts at once."""
    words = [t.lower().split() for t in texts]  # bytes: ASCII letters and ASCII white space only
    hashes = bl.word_hashes(list(itertools.chain.from_iterable(words)))
    n = max(len(hashes) - SHINGLE + 1, 0)
    sums = np.zeros(n, np.uint64)
    for k, m in enumerate(_TIMES):
        sums += hashes[k : k + n] * m
    sums = bl.scrambled(sums)
    out, at = [], 0
    for own in words:
        if len(own) >= SHINGLE:
            s = np.sort(sums[at : at + len(own) - SHINGLE + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new].view(np.int64))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), 5)], np.uint64).view(np.int64) if own else _NONE)
        at += len(own)
    return out


def signature(shingles: np.ndarray) -> int:
    """One number for equal sets, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WORDS signed numbers a set: the bits that are set in over half of its hashes, mixed anew for each word."""
    n = np.array([len(s) for s in sets])
    place = np.repeat(np.arange(len(sets)) << 8, n)
    hashes = np.concatenate(sets).view(np.uint64) if sets else _NONE.view(np.uint64)
    out = np.zeros((len(sets), WORDS), np.int64)
    for k, m in enumerate(_MIXES):
        lanes = bl.scrambled(hashes * m).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = [np.bincount(place + lanes[:, i], minlength=len(sets) << 8).reshape(-1, 256) @ _LANE_BITS for i in range(8)]
        out[:, k] = np.packbits(2 * np.concatenate(ones, axis=1) > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """Which of m slots hold an odd number of the hashes; m: the least power of two that isn't below their number."""
    m = max(LEAST_SKETCH, 1 << max(len(shingles) - 1, 0).bit_length())
    slots = shingles.view(np.uint64) & np.uint64(m - 1)  # low bits; the order goes by the high ones
    return np.packbits(np.bincount(slots.astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots in which the sketches of two matrices differ, row by row; the longer ones are folded to the others' length,
    which keeps the parities."""
    while a.shape[1] != b.shape[1]:
        if a.shape[1] < b.shape[1]:
            a, b = b, a
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _text_key(digest: Column | str) -> Column:
    """60 bits of an MD5 in hexadecimal digits."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield part, shingle_sets([t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()])
    pa.default_memory_pool().release_unused()  # workers stay beside the next stages


def signed(texts: DataFrame) -> DataFrame:
    """(doc_id, fp, digest, words) of every row; fp: the signature of its set, words: its fingerprints."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.string()), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, 1):
            words = pa.array(list(fingerprints(sets)), schema.field(3).type)
            yield pa.record_batch([part.column(0), pa.array([signature(s) for s in sets], pa.int64()), part.column(2), words], schema=schema)

    return texts.select("doc_id", "text", F.md5("text").alias("digest")).mapInArrow(run, "doc_id bigint, fp bigint, digest string, words array<bigint>")


def visits(of_set: DataFrame, excess: int) -> DataFrame:
    """(anchor, fp, next): the anchors within the excess of each word of (fp, words), with the set's next word."""
    schema = pa.schema([("anchor", pa.int32()), ("fp", pa.int64()), ("next", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                words = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(fp), WORDS)
                for k in range(WORDS):
                    row, anchor, _ = simhash.covering(np.ascontiguousarray(words[:, k]), excess)
                    yield pa.record_batch([pa.array((k << 25 | anchor).astype(np.int32)), pa.array(fp[row]), pa.array(words[row, (k + 1) % WORDS])], schema=schema)

    return of_set.select("fp", "words").mapInArrow(run, "anchor int, fp bigint, next bigint")


def covered(of_set: DataFrame) -> DataFrame:
    """(a, b): sets (fp, words) that meet at an anchor, each with the nearest of those that it meets.

    Of the sets at home at an anchor one, picked by hash, is its hub; the others visit it too, so a visit makes a row at most.
    """
    homes = visits(of_set, 0).groupBy("anchor").agg(F.min_by(F.struct("fp", "next"), F.xxhash64("anchor", "fp")).alias("hub"))
    apart = F.bit_count(F.col("next").bitwiseXOR(F.col("hub.next")))
    met = visits(of_set, EXCESS).hint("merge").join(homes, "anchor").where((F.col("fp") != F.col("hub.fp")) & (apart <= APART))
    once = met.groupBy("fp", F.col("hub.fp").alias("hub")).agg(F.min(apart).alias("apart"))
    few = once.withColumn("k", F.row_number().over(W.partitionBy("fp").orderBy("apart", F.xxhash64("fp", "hub")))).where(F.col("k") <= NEAREST)
    return few.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def _bits(df: DataFrame, column: str, slots: int) -> bytes:
    """The values of a column modulo slots as a bitmap, built by the executors; its size is slots / 8."""
    at = F.pmod(F.col(column), F.lit(slots)) + 1
    parts = df.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.k - 1) * len(part) : r.k * len(part)] = part
    return out.tobytes()


def _held(bits: bytes, values: np.ndarray, slots: int) -> np.ndarray:
    at = values % slots
    return np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7) & 1 > 0


def front_length(n: int) -> int:
    return prefix_length(n) + n // 10


def fronts(texts: DataFrame) -> DataFrame:
    """(h, n) of shingles that are at the front of more than one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 0):
            yield pa.record_batch([pa.array(np.concatenate([s[: front_length(len(s))] for s in sets]))], names=["h"])

    return texts.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


def frequent(counts: DataFrame, least: int = FREQUENT) -> np.ndarray:
    """Shingles at the front of more than `least` texts, ascending: a million at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") > max(least, total // 1_000_000)).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64))


def among(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of s the ascending `last` has, by binary search: a set of n costs n log of last's length, not that length."""
    if not len(last):
        return np.zeros(len(s), bool)
    return last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s


def _prefix(s: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places in the ascending set s of its prefix, the shingles in `last` ordered after the others."""
    late = among(s, last)
    return np.concatenate([np.flatnonzero(~late), np.flatnonzero(late)])[: prefix_length(len(s))]


def behind(texts: DataFrame, last: np.ndarray) -> DataFrame:
    """(h) of shingles that are in a prefix but behind the front, where fronts() counts none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 0):
            places = [_prefix(s, last) for s in sets]
            yield pa.record_batch([pa.array(np.concatenate([s[at[at >= front_length(len(s))]] for s, at in zip(sets, places, strict=True)]))], names=["h"])

    return texts.select("text").mapInArrow(run, "h bigint")


def prefixes(texts: DataFrame, last: np.ndarray, shared: bytes) -> DataFrame:
    """(fp, n, hs, sketch) of every set that has some: the shingles of its prefix that the bitmap has; n: its size."""
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int32()), ("hs", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 0):
            held = [h[_held(shared, h, SHARED_SLOTS)] for h in (s[_prefix(s, last)] for s in sets)]
            some = [(s, h) for s, h in zip(sets, held, strict=True) if len(h)]
            columns = [[signature(s) for s, _ in some], [len(s) for s, _ in some], [h for _, h in some], [sketch(s) for s, _ in some]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("text").mapInArrow(run, "fp bigint, n int, hs array<bigint>, sketch binary").dropDuplicates(["fp"])


def sets_of(texts: DataFrame, of_set: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, s): the whole sets that are wanted (fp), found by a bitmap of their MD5s; of_set: (fp, digest), a text of each set."""
    asked = wanted.join(of_set, "fp")
    bits = _bits(asked.select(_text_key("digest").alias("key")), "key", SLOTS)
    schema = pa.schema([("fp", pa.int64()), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(_held(bits, batch.column(1).to_numpy(zero_copy_only=False), SLOTS))
            for part in itertools.batched(at.tolist(), 64):
                sets = shingle_sets([batch.column(0)[k].as_buffer().to_pybytes() for k in part])
                yield pa.record_batch([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return texts.select("text", _text_key(F.md5("text")).alias("key")).mapInArrow(run, "fp bigint, s binary").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def _kept(pairs: DataFrame, facts: DataFrame, column: str, linked) -> DataFrame:
    """The pairs (a, b) whose two facts are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    side = lambda k, c: facts.select(F.col("fp").alias(k), F.col(column).alias(c)).hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = linked(batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary()))
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(held, pa.bool_()))

    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(run, "a bigint, b bigint"))


def _may_link(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Of columns of (size, sketch), row by row: False only if the sets differ in more than a ninth of their sizes together."""
    both = pa.chunked_array([x, y]).combine_chunks()
    n = np.arange(len(x))
    return may_link(both, n, n + len(x))


def may_link(facts: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for pairs of places in one column."""
    at = np.frombuffer(facts.buffers()[1], np.int64)[facts.offset : facts.offset + len(facts) + 1]
    data = np.frombuffer(facts.buffers()[2], np.uint8)
    width = np.diff(at)
    out = np.zeros(len(left), bool)
    kinds = width[left] << 32 | width[right]
    for kind in np.unique(kinds).tolist():  # a few powers of two
        wide = (kind >> 32, kind & 0xFFFFFFFF)
        alike = np.flatnonzero(kinds == kind)
        for rows in np.array_split(alike, -(-len(alike) * max(wide) // SKETCH_BYTES)):
            a, b = (data[at[side[rows], None] + np.arange(w)] for side, w in zip((left, right), wide, strict=True))
            sizes = sum((m[:, :4].astype(np.int64) << [24, 16, 8, 0]).sum(1) for m in (a, b))
            out[rows] = 9 * sketch_distances(a[:, 4:], b[:, 4:]) <= sizes
    return out


def meetings(rows: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the pairs of one bucket in different components whose sizes and sketches don't rule a link out.

    rows: (h, fp, n, root, m, sketch) with m the bucket's size. Sketches are compared where they lie, in numpy; each
    set that is in such a pair leaves the task once, with the least one that it reaches. A bucket of more than TILE sets is dealt to tiles by hash, and every
    two tiles meet in a group of their own, so a group is of bounded size however large a bucket is.
    """
    tiles = F.ceil(F.col("m") / TILE)
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("fp", "h"), tiles)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    sent = dealt.select("h", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("k"), "fp", "n", "root", "tile", "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def met(group: pa.Table) -> pa.RecordBatch:
        h, i, k, fp, n, root, tile = (group.column(c).to_numpy() for c in range(7))
        facts = group.column(7).cast(pa.large_binary()).combine_chunks()
        of = np.cumsum(np.concatenate([[False], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
        found, left, step = [], np.arange(len(of)), 0
        while True:
            step += 1
            left = left[left + step < len(of)]
            left = left[of[left] == of[left + step]]
            if not len(left):
                break
            right = left + step
            small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
            wanted = (root[left] != root[right]) & (5 * small >= 4 * large) & ((i[left] == k[left]) | (tile[left] != tile[right]))
            a, b = left[wanted], right[wanted]
            held = may_link(facts, a, b)
            found.append(np.stack([a[held], b[held]]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        some = np.unique(np.concatenate([a, b]))
        # groups are apart, so the least set that is reached lies in the same one
        least = least_reached(len(fp), a, b, fp)
        forest = some[least[some] != fp[some]]
        return pa.record_batch([pa.array(least[forest]), pa.array(fp[forest])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many small groups at once: they are met together
        held: list[pa.Table] = []
        rows = 0
        for group in sorted_groups(batches, 3):
            held.append(group)
            rows += group.num_rows
            if rows >= MET_ROWS:
                yield met(pa.concat_tables(held))
                held, rows = [], 0
        if held:
            yield met(pa.concat_tables(held))

    return sent.repartition("h", "i", "k").sortWithinPartitions("h", "i", "k").mapInArrow(run, "a bigint, b bigint").distinct()


def _links(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Whether the sets' similarity is 4/5 or more: common / (x + y - common) >= 4/5."""

    def linked(k: int) -> bool:
        a, b = (np.frombuffer(c[k].as_buffer(), np.int64) for c in (x, y))
        return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))

    return np.array([linked(k) for k in range(len(x))], bool)


def confirmed(texts: DataFrame, of_set: DataFrame, likely: DataFrame) -> DataFrame:
    """The pairs (a, b) of a similarity of 4/5 or more."""
    asked = likely.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    return likely if likely.isEmpty() else _kept(likely, sets_of(texts, of_set, asked), "s", _links)


def fine_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of equal length, FINE_SLOTS slots a shingle of the largest set, as rows of 64-bit words."""
    m = max(LEAST_SKETCH, FINE_SLOTS << max(max(map(len, sets)) - 1, 0).bit_length())
    while m > LEAST_SKETCH and len(sets) * m // 8 > 2 * FAMILY_BYTES:
        m //= 2  # fewer slots only rule out fewer pairs
    bits = np.zeros((len(sets), m // 8), np.uint8)
    for k, s in enumerate(sets):
        slots = (s.view(np.uint64) & np.uint64(m - 1)).astype(np.int64)
        bits[k] = np.packbits(np.bincount(slots, minlength=m).astype(np.uint8) & 1, bitorder="little")
    return bits.view(np.uint64)


def joining(fps: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], tiles: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
    """Pairs of a similarity of 4/5 or more that join all components that such pairs join, and how many pairs were compared exactly.

    roots: the components so far; tiles: where given, only pairs of different tiles are looked at.
    """
    n = np.array([len(s) for s in sets])
    of = np.unique(roots, return_inverse=True)[1]
    sketches, edges, compared = fine_sketches(sets), [], 0
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(of[rest] != of[i]) & (5 * np.minimum(n[rest], n[i]) >= 4 * np.maximum(n[rest], n[i]))]
        if tiles is not None:
            rest = rest[tiles[rest] != tiles[i]]
        if not len(rest):
            continue
        apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(1, dtype=np.int64)
        near = apart <= (n[rest] + n[i]) / 9
        for j in rest[near][np.argsort(apart[near], kind="stable")].tolist():
            if of[i] != of[j]:
                compared += 1
                if 9 * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= 4 * (n[i] + n[j]):
                    edges.append((int(fps[i]), int(fps[j])))
                    of[of == of[j]] = of[i]
    return edges, compared


def families(texts: DataFrame, of_set: DataFrame, sizes: DataFrame, roots: DataFrame, forest: DataFrame, tile_bytes: int = FAMILY_BYTES) -> DataFrame:
    """(a, b): edges that join the components (node, root) as far as pairs within the forest's trees do; sizes: (fp, n)."""
    if forest.isEmpty():
        return forest
    trees = written(simhash.components(forest).select(F.col("node").alias("fp"), F.col("root").alias("family")))
    sized = trees.hint("merge").join(sizes, "fp")
    tiles = sized.groupBy("family").agg(F.ceil(F.sum(F.col("n") * 8) / tile_bytes).alias("m"))
    counted = sized.hint("merge").join(tiles, "family").withColumn("tile", F.pmod(F.xxhash64("fp", "family"), "m"))
    dealt = counted.select("fp", "family", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other"))
    of = roots.select(F.col("node").alias("fp"), "root")
    placed = dealt.hint("merge").join(of, "fp", "left").select("fp", "family", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("k"), "tile", F.coalesce("root", "fp").alias("root"))
    rows = placed.hint("merge").join(sets_of(texts, of_set, trees.select("fp")), "fp").select("family", "i", "k", "tile", "fp", "root", "s")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            if group.num_rows > 1:
                i, k, tile, fp, root = (group.column(c).to_numpy() for c in range(1, 6))
                sets = [np.frombuffer(s.as_buffer(), np.int64) for s in group.column(6)]
                edges, _ = joining(fp, root, sets, tile if i[0] != k[0] else None)
                if edges:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], schema=schema)

    return written(rows.repartition("family", "i", "k").sortWithinPartitions("family", "i", "k").mapInArrow(run, "a bigint, b bigint"))


def links(texts: DataFrame, of_set: DataFrame) -> DataFrame:
    """(a, b) signatures of confirmed pairs; their components are those of all pairs of a similarity of 4/5 or more.

    of_set: (fp, digest, words), a text of each set and its fingerprints.
    """
    tried = written(covered(of_set))
    counts = written(fronts(texts))
    last = frequent(counts)
    seen = counts.select("h").unionByName(behind(texts, last)) if len(last) else counts.select("h")
    sets = written(prefixes(texts, last, _bits(seen, "h", SHARED_SLOTS)))
    sketches = sets.select("fp", F.concat(F.unhex(F.lpad(F.hex("n"), 8, "0")), "sketch").alias("sketch"))
    rows = sets.select(F.explode("hs").alias("h"), "fp", "n")
    shared = rows.groupBy("h").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("h")
    buckets = written(rows.hint("merge").join(shared, "h"))
    # Sets that share no shingle of their prefixes have no sketch here, and no link.
    first = confirmed(texts, of_set, _kept(tried, sketches, "sketch", _may_link))
    roots = written(simhash.components(first))
    rooted = buckets.select("h", "fp", "n").hint("merge").join(roots, F.col("fp") == F.col("node"), "left").select("h", "fp", "n", F.coalesce("root", "fp").alias("root"))
    # A bucket that is one component holds no pair to search.
    open_ = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("h", "m")
    left = written(rooted.hint("merge").join(open_, "h"))
    forest = written(meetings(left.hint("merge").join(sketches, "fp").select("h", "fp", "n", "root", "m", "sketch")))
    return first.unionByName(families(texts, of_set, sets.select("fp", "n"), roots, forest))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """simhash.grouped with these links; fp is the signature of the set."""
    texts = _texts(docs, id_col, text_col)
    rows = written(signed(texts))
    return simhash.rooted(rows, lambda distinct: links(texts, written(rows.groupBy("fp").agg(F.min_by(F.struct("digest", "words"), "digest").alias("w")).select("fp", "w.*"))))


keep_one = functools.partial(simhash.keep_one, group=grouped)
