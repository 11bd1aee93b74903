"""Near copies among embeddings by Euclidean p-stable hashing (operator 13).

Compared are vectors of equal label and length by cosine; linked are those of 0.93 or more. Of unit vectors a
cosine c is a distance of sqrt(2 - 2c), at most 0.374 here. A table's hash is `depth` Gaussian projections,
each shifted and cut into steps of WIDTH; two vectors at distance d share one step with the probability

    p(d) = 1 - 2 Phi(-WIDTH / d) - 2 d / (sqrt(2 pi) WIDTH) (1 - exp(-WIDTH^2 / 2 d^2))

and a table's bucket with p(d)^depth. Depth is so large that a vector of the largest label shares a bucket
with a quarter of an unrelated one on average (DEPTH at least), and there are so many tables that a pair just at
the threshold is found with the probability RECALL; closer pairs are found almost surely (0.97: 0.9997 at
the least depth). Every pair that shares a bucket is compared exactly in double precision, so no link is wrong.

Equal vectors of a label are one point with a count, so groups of copies have no pairs. Codes are shuffled
without vectors, and vectors go only to buckets with more than one point. A bucket of more than TILE points is
dealt to tiles by hash and every two tiles meet in a group of their own: groups are of bounded size
and no bucket is cut. A pair that shares several buckets is counted in the first table only, for which the codes
are found again from the vectors; projections are integers below 2^53, so they come out equal in every
task. Pairs don't leave the task: links are counted by point, and each point names the smallest one that it
reaches in its group; from those edges come the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a
label, link with nothing; so do vectors of different lengths; a null id belongs to its component but names it
only if it has no other id, and is not kept; rows that repeat an id and a vector link with each other as copies; an
empty table gives an empty result; only the three named columns are read. Points are told apart by 64-bit
hashes of label and vector.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hot_join, least_reached, sorted_groups, written

COSINE = 0.93
WIDTH = 2.0
DEPTH = 16
#: Of pairs just at the threshold so many are found.
RECALL = 0.95
#: Points of a bucket that meet in one group, on average.
TILE = 1_024
SEED = 13
#: Steps of one in which unit vectors, projections and shifts are rounded before they are hashed.
_FINE, _COARSE = 1 << 16, 1 << 12
#: Cosines this close to the threshold are summed again without rounding.
_DOUBT = 1e-9


def one_step(distance: float, width: float = WIDTH) -> float:
    """The probability that two vectors at this distance fall into one step of a projection."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def depth_for(points: int, width: float = WIDTH) -> int:
    """Projections a table, so that of so many vectors at right angles a quarter of one shares a bucket."""
    return max(DEPTH, math.ceil(math.log(4 * max(points, 1)) / -math.log(one_step(math.sqrt(2), width))))


def tables_for(depth: int, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> int:
    """Tables, so that a pair just at the threshold shares a bucket with the probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - one_step(math.sqrt(2 - 2 * cosine), width) ** depth))


@functools.lru_cache(maxsize=8)
def _family(dims: int, depth: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections (dims, tables * depth) and shifts as whole numbers, and the odd multipliers and salts that make codes."""
    rng = np.random.default_rng([SEED, dims, depth])
    lines = np.rint(rng.standard_normal((tables, depth, dims)) * _COARSE).reshape(-1, dims).T.copy()
    shifts = rng.integers(0, int(WIDTH * _FINE * _COARSE), tables * depth)
    rng = np.random.default_rng([SEED, depth])
    return lines, shifts, rng.integers(0, 1 << 63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, tables, dtype=np.uint64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; none of them may be zero."""
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(unit: np.ndarray, labels: np.ndarray, depth: int, tables: int) -> np.ndarray:
    """(rows, tables) signed 64-bit codes; a code holds its table, the label and the length of the vectors."""
    lines, shifts, times, salts = _family(unit.shape[1], depth, tables)
    sums = (np.rint(unit * _FINE) @ lines).astype(np.int64)  # whole numbers: exact in any order
    steps = np.floor_divide(sums + shifts, int(WIDTH * _FINE * _COARSE)).reshape(len(unit), tables, depth).view(np.uint64)
    code = (steps * times).sum(2) + salts + labels.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1])
    code = (code ^ (code >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (code ^ (code >> np.uint64(32))).view(np.int64)


def usable(vector: str, label: str) -> Column:
    """Whether a vector can link: a label, and finite components that aren't all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrices(batch: pa.RecordBatch, column: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a batch's vectors, those of one length together."""
    for at in range(0, batch.num_rows, rows):
        part = batch.column(column).slice(at, rows)
        flat, sizes = part.flatten().to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        for dims in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dims)
            yield own + at, flat[starts[own, None] + np.arange(dims)].astype(float)


def coded(points: DataFrame, depth: int, tables: int) -> DataFrame:
    """(code, fp): each point once a table."""
    schema = pa.schema([("code", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, labels = (batch.column(c).to_numpy() for c in (0, 1))
            for places, x in _matrices(batch, 2):
                own = codes(units(x), labels[places], depth, tables)
                yield pa.record_batch([pa.array(own.ravel()), pa.array(np.repeat(fp[places], tables))], schema=schema)

    return points.select("fp", "label", "v").mapInArrow(run, "code bigint, fp bigint")


def dealt(buckets: DataFrame, tile: int = TILE) -> DataFrame:
    """(code, i, k, tile, fp) from (code, fp, m): every two of a bucket's tiles meet in a group (code, i, k)."""
    tiles = F.ceil(F.col("m") / tile)
    of = F.pmod(F.xxhash64("fp", "code"), tiles)
    each = buckets.select("code", "fp", of.alias("tile"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    return each.select("code", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("k"), "tile", "fp")


def linked_pairs(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of rows whose cosine reaches the threshold."""
    unit, left, right = units(x), [], []
    for at in range(0, len(unit), 256):
        sims = unit[at : at + 256] @ unit[at:].T
        a, b = np.nonzero(sims >= cosine - _DOUBT)
        later = b > a
        a, b = a[later], b[later]
        sure = sims[a, b] >= cosine + _DOUBT
        for k in np.flatnonzero(~sure).tolist():
            u, v = x[at + a[k]] / np.abs(x[at + a[k]]).max(), x[at + b[k]] / np.abs(x[at + b[k]]).max()
            sure[k] = math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v)) >= cosine
        left.append(at + a[sure])
        right.append(at + b[sure])
    return np.concatenate(left), np.concatenate(right)


def met(groups: DataFrame, depth: int, tables: int, cosine: float = COSINE) -> DataFrame:
    """(fp, n, least) of points with links in a group of (code, i, k, tile, fp, times, label, v), in sorted order.

    n: rows that are linked in this group and share no earlier table; least: the least point reached in it.
    """
    schema = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("least", pa.int64())])

    def links_of(group: pa.Table) -> pa.RecordBatch | None:
        code, i, k, tile, fp, times, labels = (group.column(c).to_numpy() for c in range(7))
        cross = i[0] != k[0]
        count, low, some = np.zeros(len(fp), np.int64), fp.copy(), np.zeros(len(fp), bool)
        for places, x in _matrices(pa.record_batch([group.column(7).combine_chunks()], names=["v"]), 0, len(fp)):
            a, b = linked_pairs(x, cosine)
            a, b = places[a], places[b]
            wanted = labels[a] == labels[b]
            if cross:
                wanted &= tile[a] != tile[b]
            a, b = a[wanted], b[wanted]
            if not len(a):
                continue
            own = np.empty((len(fp), tables), np.int64)
            own[places] = codes(units(x), labels[places], depth, tables)
            first = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                table = (own[p] == own[q]).argmax(1)  # they share this group's, so there is one
                first[at : at + len(p)] = own[p, table] == code[0]
            a, b = a[first], b[first]
            np.add.at(count, a, times[b])
            np.add.at(count, b, times[a])
            some[a] = some[b] = True
            low = least_reached(len(fp), a, b, low)
        at = np.flatnonzero(some)
        return pa.record_batch([pa.array(c[at]) for c in (fp, count, low)], schema=schema) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            if group.num_rows > 1 and (out := links_of(group)) is not None:
                yield out

    return groups.mapInArrow(run, "fp bigint, n bigint, least bigint")


def links(points: DataFrame, total: int, largest: int, cosine: float = COSINE, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """(fp, n, least), several a point: its linked rows add up to n, and (fp, least) are edges of its component.

    points: (fp, times, label, v), each fp once; `total` of them, `largest` in one label.
    """
    depth = depth_for(largest)
    tables = tables_for(depth, cosine, recall)
    narrow = written(coded(points, depth, tables))
    buckets = narrow.groupBy("code").agg(F.count("*").alias("m")).where("m > 1").withColumn("times", F.col("m"))
    shared = dealt(hot_join(narrow, written(buckets), ["code"], "times", total * tables).select("code", "fp", "m"), tile)
    with_vectors = shared.hint("merge").join(points, "fp").select("code", "i", "k", "tile", "fp", "times", "label", "v")
    return met(with_vectors.repartition("code", "i", "k").sortWithinPartitions("code", "i", "k"), depth, tables, cosine)


def grouped(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("long").alias("label"))
    held = rows.where(usable("v", "label")).withColumn("fp", F.xxhash64("label", "v"))
    narrow = written(held.select("doc_id", "fp", F.lit(None).cast("string").alias("digest")))
    points = written(held.select("fp", "label", "v").groupBy("fp").agg(F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v")))
    sizes = points.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)), F.lit(0)).first()
    found = written(links(points, sizes[0], sizes[1], cosine, tile, recall))
    rooted = written(simhash.rooted(narrow, lambda _: found.select(F.col("fp").alias("a"), F.col("least").alias("b")).where("a != b")))
    linked = found.groupBy("fp").agg(F.sum("n").alias("n"))
    counts = written(points.select("fp", "times").hint("merge").join(linked, "fp", "left").select("fp", "times", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    n_rows = narrow.count()
    inside = hot_join(rooted, counts, ["fp"], "times", n_rows).select(F.col("doc_id").alias("vec_id"), "n_links", "component_id")
    outside = rows.where(~usable("v", "label")).select(F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs; the operator finds links at the threshold with the probability RECALL and closer ones almost surely.
ORACLE = """
WITH RECURSIVE rows AS (SELECT vec_id, row_number() OVER () AS k, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
fine AS (SELECT * FROM rows WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.k, b.k AS other FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT k, vec_id FROM rows UNION SELECT links.k, reach.vec_id FROM links JOIN reach ON links.other = reach.k),
named AS (SELECT k, min(vec_id) AS component_id FROM reach GROUP BY k)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.k = rows.k) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM rows JOIN named USING (k)"""
