"""Sharding by minimax contiguous partition (operator 5), in DataFrame functions only.

Equal texts form one atomic group (null counts as the empty text). Groups stand in the order of the
MD5 of their text, which spreads them evenly whatever the ids are. The smallest capacity with which a
greedy pass needs no more than the wanted shards is found by binary search: first on 4,096 stretches
of the order, whose sizes fit the driver, then between two bounds at most one stretch apart, where a
round checks 512 capacities greedily at once, each step one look into the distributed prefix sums.
The cuts are MD5 values, so a row's shard follows from its own text without a join.

Defined cases: null ids and texts are rows like others; repeated rows get a slot each; an empty table
gives an empty result; only the id and the text column are read. One group larger than an even share
gets a shard of its own, larger than the others; nothing is split or dropped.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

STRETCH_DIGITS = 3
AT_ONCE = 512
SLOT_DIGITS = 3


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))


def prefix_sums(rows: DataFrame) -> DataFrame:
    """(stretch, key, size, upto): sizes of the atomic groups, added up in key order within each stretch."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("size")).withColumn("stretch", F.conv(F.substring("key", 1, STRETCH_DIGITS), 16, 10).cast("int"))
    return groups.withColumn("upto", F.sum("size").over(W.partitionBy("stretch").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))


class Order:
    """Prefix sums: stretch totals on the driver, groups in a distributed table."""

    def __init__(self, sums: DataFrame) -> None:
        self.sums = sums
        totals = dict(sums.groupBy("stretch").agg(F.max("upto")).collect())  # 4,096 rows at most
        self.starts = [0]
        for stretch in range(16**STRETCH_DIGITS):
            self.starts.append(self.starts[-1] + totals.get(stretch, 0))
        self.total = self.starts[-1]
        self.largest_stretch = max(totals.values(), default=0)
        self.largest_group = sums.agg(F.max("size")).first()[0] or 0

    def reach(self, targets: list[int]) -> list[int]:
        """For each target the largest prefix sum that isn't over it."""
        spot = [min(bisect_right(self.starts, t) - 1, len(self.starts) - 2) for t in targets]
        spark = self.sums.sparkSession
        asked = [(k, s, t - self.starts[s]) for k, (s, t) in enumerate(zip(spot, targets, strict=True)) if t < self.total]
        out = [self.total if t >= self.total else self.starts[s] for s, t in zip(spot, targets, strict=True)]
        if asked:
            ask = F.broadcast(spark.createDataFrame(asked, "k int, stretch int, rest bigint"))  # AT_ONCE rows at most
            near = self.sums.where(F.col("stretch").isin(sorted({s for _, s, _ in asked}))).join(ask, "stretch").where("upto <= rest")
            for k, upto in near.groupBy("k").agg(F.max("upto")).collect():
                out[k] += upto
        return out

    def greedy(self, capacities: list[int], shards: int) -> list[list[int]]:
        """Where each capacity's greedy pass ends its shards."""
        ends: list[list[int]] = [[] for _ in capacities]
        at = [0] * len(capacities)
        for _ in range(shards):
            at = self.reach([a + c for a, c in zip(at, capacities, strict=True)])
            for e, a in zip(ends, at, strict=True):
                e.append(a)
            if all(a == self.total for a in at):
                break
        return ends

    def coarse(self, shards: int) -> int:
        """The smallest capacity for whole stretches, by binary search on the driver."""

        def fits(capacity: int) -> bool:
            at = 0
            for _ in range(shards):
                at = self.starts[bisect_right(self.starts, at + capacity) - 1]
            return at == self.total

        low, high = max(-(-self.total // shards), 1), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fits(middle) else (middle + 1, high)
        return high

    def smallest_capacity(self, shards: int) -> tuple[int, list[int]]:
        high = self.coarse(shards)  # feasible for groups too, and at most one stretch above the least
        low = max(-(-self.total // shards), self.largest_group, high - self.largest_stretch)
        ends: list[int] | None = None
        while low < high:
            step = -(-(high - low) // AT_ONCE)
            tried = list(range(low, high, step))
            passes = self.greedy(tried, shards)
            best = next((i for i, e in enumerate(passes) if e[-1] == self.total), None)
            if best is None:
                low = tried[-1] + 1
            else:
                high, low, ends = tried[best], tried[best - 1] + 1 if best else tried[best], passes[best]
        return high, ends or self.greedy([high], shards)[0]

    def cut_keys(self, ends: list[int]) -> list[str]:
        """The last key of each shard that something follows."""
        wanted = sorted({e for e in ends if 0 < e < self.total})
        if not wanted:
            return []
        spot = {e: bisect_right(self.starts, e - 1) - 1 for e in wanted}
        test = F.lit(False)
        for e, s in spot.items():
            test |= (F.col("stretch") == s) & (F.col("upto") == e - self.starts[s])
        return sorted(r[0] for r in self.sums.where(test).select("key").collect())


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; law `bytes`, so grown_shard is null.

    Slots run from 0 without gaps within a shard: rows are numbered in buckets by a hash of the id, so that a
    group of equal texts fills no bucket, and the buckets' counts (shards x 4,096 rows at most) are added up.
    """
    rows = written(sized(docs, id_col, text_col))
    order = Order(written(prefix_sums(rows)))
    _, ends = order.smallest_capacity(shards)
    number = F.lit(0)
    for key in order.cut_keys(ends):
        number += (F.col("key") > key).cast("int")
    placed = rows.withColumns({"shard": number, "bucket": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, SLOT_DIGITS)})
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    return placed.withColumn("within", within).join(F.broadcast(before), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END))"
_PASSES = ",\n".join(f"s{k} AS (SELECT s.c, {', '.join([*[f's.e{j}' for j in range(1, k)], f'g.upto AS e{k}'])} FROM s{k - 1} s ASOF JOIN sums g ON g.upto <= {f's.e{k - 1} + s.c' if k > 1 else 's.c'})" for k in range(1, 9))
#: The same by trying every capacity: an even share, and as much more as the largest group, is always enough.
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS key FROM documents),
sums AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY key) AS BIGINT) AS upto FROM (SELECT key, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY key)),
facts AS (SELECT max(upto) AS total, max(size) AS largest FROM sums),
s0 AS (SELECT unnest(range(greatest((total + 7) // 8, largest), (total + 7) // 8 + largest + 1)) AS c FROM facts),
{_PASSES},
best AS (SELECT e FROM (SELECT unnest(list_distinct([e1, e2, e3, e4, e5, e6, e7, e8])) AS e FROM (SELECT * FROM s8, facts WHERE e8 = total ORDER BY c LIMIT 1))),
placed AS (SELECT key, CAST((SELECT count(*) FROM best WHERE e < upto) AS INT) AS shard FROM sums),
bytes AS (SELECT key, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM (SELECT DISTINCT key, text FROM docs)),
crc AS (SELECT key, xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) AS text_crc32 FROM bytes, (SELECT {_TABLE} AS t))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, {SLOT_DIGITS}), doc_id, key) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM docs JOIN placed USING (key) JOIN crc USING (key)"""
