"""Nearest neighbours, moments and the Fréchet distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import dot
from ..session import ensure_importable

#: Items and queries that meet in one group, on average; scores that are held at once.
ITEM_ROWS, QUERY_ROWS, SCORES = 16_384, 4_096, 1 << 22
#: What a sum of products may differ from the same sum in another order, at unit length.
SLACK = 1e-9


def knn(items: DataFrame, queries: DataFrame, k: int, item_id: str, query_id: str, vector: str, digits: int = 6) -> DataFrame:
    """(query_id, item_id, sim, rank): the k items of highest cosine for each query, ties by item id; the query isn't excluded.

    Every query meets every item, which is quadratic where queries are a share of the items: items and queries are dealt to
    blocks by hash, every two blocks meet in a group of bounded size, and leave k rows a query, which are ranked.
    In a group a product of matrices finds what may be among the best k, and those alone are computed in array order, as
    functions.vectors.cosine does. Cosines are compared as rounded; NaN comes first and null, of vectors that are null,
    have null components, another length than the query's or no length, last.
    """
    ensure_importable(items.sparkSession)
    kinds = {"query_id": queries.schema[query_id].dataType.simpleString(), "item_id": items.schema[item_id].dataType.simpleString()}
    n_items, n_queries = items.count(), queries.count()
    blocks, parts = max(1, -(-n_items // ITEM_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    side = lambda df, key, n: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key, vector), F.lit(n)).alias("own"))
    dealt = lambda rows, other, n: rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = dealt(side(items, item_id, blocks), "q", parts).select(F.col("own").cast("int").alias("i"), "q", "id", "v")
    right = dealt(side(queries, query_id, parts), "i", blocks).select("i", F.col("own").cast("int").alias("q"), "id", "v")

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        held = held.take(pc.sort_indices(held, sort_keys=[("id", "ascending")], null_placement="at_start"))
        q, i, sim = nearest(held.column("v"), asked.column("v"), k, digits)
        columns = [asked.column("id").take(pa.array(q)), held.column("id").take(pa.array(i)), pa.array(sim, pa.float64(), mask=np.isneginf(sim))]
        return pa.table(columns, names=["query_id", "item_id", "sim"])

    scored = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInArrow(meet, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, sim double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "item_id"))
    return scored.withColumn("sim", F.round("sim", digits)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _matrix(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, rows) of the vectors without nulls."""
    flat = vectors.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    sizes = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(flat)
    starts = np.cumsum(sizes) - sizes
    none = np.flatnonzero(pc.is_null(values).to_numpy(zero_copy_only=False))
    whole = sizes > 0
    whole[np.searchsorted(starts + sizes, none, side="right")] = False
    x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
    out = {}
    for d in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == d))
        out[d] = at, x[starts[at, None] + np.arange(d)]
    return out


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row the sum of products, in array order."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        total = total + x[:, c] * y[:, c]
    return total


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up, away from zero, of the shortest decimal form, as Spark's round; NaN as infinity."""
    scaled = np.abs(x) * 10.0**digits
    out = np.sign(x) * np.floor(scaled + 0.5)
    for j in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3).tolist():
        out[j] = float(Decimal(repr(float(x[j]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), np.inf, out)


def nearest(items: pa.ChunkedArray, queries: pa.ChunkedArray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the item, cosine): for each query the first k by rounded cosine, then by the item's place;
    -inf stands for null."""
    of_items, found = _matrix(items), []
    none = np.ones(len(queries), np.int64) * min(k, len(items))  # of each query how many null ones may still count
    valid: dict[int, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for d, (places, y) in _matrix(queries).items():
            if d not in of_items:
                continue
            own, x = of_items[d]
            x_norm, y_norm = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(y, y))
            # of equal vectors only the first k can be among the best k
            same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)[1].ravel()
            order = np.argsort(same, kind="stable")
            nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
            some = np.sort(order[(nth < k) & ~(x_norm[order] == 0)])
            own, x, x_norm = own[some], x[some], x_norm[some]
            step = max(1, SCORES // max(len(x), 1))
            for at in range(0, len(y), step):
                part, norm = y[at : at + step], y_norm[at : at + step]
                near = (part / norm[:, None]) @ (x / x_norm[:, None]).T
                least = np.partition(near, -k, axis=1)[:, -k] - 10.0**-digits - SLACK if near.shape[1] > k else np.full(len(part), -np.inf)
                q, i = np.nonzero(~(near < least[:, None]))
                length = x_norm[i] * norm[q]
                q, i, length = q[length != 0], i[length != 0], length[length != 0]
                sim = _in_order(x[i], part[q]) / length
                best = np.lexsort((i, -_rounded(sim, digits), q))
                first = np.arange(len(best)) - np.searchsorted(q[best], q[best])
                best = best[first < k]
                found.append((places[at + q[best]], own[i[best]], sim[best]))
                none[places[at : at + step]] -= np.bincount(q[best], minlength=len(part))
                for j in np.flatnonzero(none[places[at : at + step]] > 0).tolist():
                    valid[int(places[at + j])] = own[i[q == j]]
    for j in np.flatnonzero(none > 0).tolist():
        gone = np.ones(len(items), bool)
        gone[valid.get(j, np.empty(0, np.int64))] = False
        more = np.flatnonzero(gone)[: k]
        found.append((np.full(len(more), j), more, np.full(len(more), -np.inf)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """(dim, mean)."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


@dataclass
class CoMoments:
    """Rows, their mean, and the sums of products of what they differ from it by; merges without cancellation."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        shift = x[0]  # large means cancel here, before anything is squared
        mean = (x - shift).mean(0)
        apart = x - shift - mean
        return cls(len(x), shift + mean, apart.T @ apart)

    def __add__(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return CoMoments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        """The sample covariance; of a single row zeros."""
        return self.products / max(self.n - 1, 1)


#: Tasks to which the first level's rows of partial moments are dealt.
MERGERS = 32


def co_moments(df: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """(key, n, mean, products) of each value of key (few; without key one row of key null), in one scan.

    A task merges its batches into one row a key, these are merged in MERGERS tasks, and theirs in one: a tree of
    rows whose size goes by the dimensions, not by the table. Null vectors are left out, as are those with null
    components; vectors of a key must have one length.
    """
    fields = [("key", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))]
    schema, ddl = pa.schema(fields), "key string, at bigint, n bigint, mean array<double>, products array<double>"

    def rows(held: dict[str | None, CoMoments]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        at = task.partitionId() % MERGERS if task else 0
        for k, m in held.items():
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(([k], [at], [m.n], [m.mean], [m.products.ravel()]), schema, strict=True)], schema=schema)

    def add(held: dict[str | None, CoMoments], k: str | None, m: CoMoments) -> None:
        held[k] = held[k] + m if k in held else m

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, CoMoments] = {}
        for batch in batches:
            for k in batch.column(0).unique().to_pylist():
                own = batch.filter(pc.is_null(batch.column(0)) if k is None else pc.equal(batch.column(0), k))
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
                add(held, k, CoMoments.of(x))
        yield from rows(held)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, CoMoments] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                mean, products = (batch.column(c)[k].values.to_numpy() for c in (3, 4))
                add(held, batch.column(0)[k].as_py(), CoMoments(batch.column(2)[k].as_py(), mean, products.reshape(len(mean), -1)))
        yield from rows(held)

    label = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    parts = df.where(whole).select(label.alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(gather, ddl)
    once = parts.repartition(MERGERS, "at").mapInArrow(merge, ddl)
    return once.repartition(1).mapInArrow(merge, ddl).drop("at")  # MERGERS rows a key


def moments(df: DataFrame, vector: str, key: str | None = None) -> dict[str | None, CoMoments]:
    """The same on the driver: d + d x d numbers a key."""
    return {r["key"]: CoMoments(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(r["mean"]), -1)) for r in co_moments(df, vector, key).collect()}


def frechet(mean1: np.ndarray, cov1: np.ndarray, mean2: np.ndarray, cov2: np.ndarray, eps: float = 1e-6) -> float:
    """||m1 - m2||^2 + tr C1 + tr C2 - 2 tr sqrt(C1 C2), by two symmetric eigenvalue problems; eps I where a product is singular."""

    def root_trace(a: np.ndarray, b: np.ndarray) -> float:
        w, v = np.linalg.eigh(a)
        half = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
        return float(np.sqrt(np.clip(np.linalg.eigvalsh(half @ b @ half), 0, None)).sum())

    trace = root_trace(cov1, cov2)
    if not np.isfinite(trace):
        bump = eps * np.eye(len(cov1))
        trace = root_trace(cov1 + bump, cov2 + bump)
    return float(((mean1 - mean2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2 * trace)


def rerank(candidates: DataFrame, captions: DataFrame, key: str, vector: str, candidate: str) -> DataFrame:
    """(key, candidate, sim): the candidate most like its caption."""
    pairs = candidates.join(captions.select(key, F.col(vector).alias("_c")), key)
    sim = F.round(dot(F.col(vector), F.col("_c")), 6)
    best = pairs.select(key, candidate, sim.alias("sim")).groupBy(key).agg(F.max_by(F.struct(candidate, "sim"), F.struct(F.col("sim"), -F.col(candidate))).alias("b"))
    return best.select(key, f"b.{candidate}", "b.sim")
