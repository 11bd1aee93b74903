"""Row numbers over a whole table without pulling it into one task.

The table is cut into ranges of its order at values of a bounded sample taken by hash, rows are numbered
within each range in parallel, and each range starts after the rows of the ranges before it: a few hundred
counts, which the driver holds. The cuts only decide how even the ranges are, never the numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges at most, and rows sampled for a range.
RANGES, SAMPLED = 256, 16


def _place(x: Column, cuts: Sequence, first: int = 0) -> Column:
    """How many cuts are at or below x, by halving: as many comparisons as the binary logarithm of their number."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(x < F.lit(cuts[mid]), _place(x, cuts[:mid], first)).otherwise(_place(x, cuts[mid + 1 :], first + mid + 1))


def global_numbers(df: DataFrame, order: Sequence[str], name: str = "rn", ranges: int = RANGES) -> DataFrame:
    """df with its rows numbered from 0 in the given order, which should be total; nulls come first.

    Two jobs run while the plan is built: one takes at most some ranges x SAMPLED values of the first column
    by hash, one counts the rows of each range. Rows that tie in the first column stay in one range.
    An empty table stays empty.
    """
    first = F.col(f"`{order[0]}`")
    total, distinct = df.agg(F.count("*"), F.approx_count_distinct(first)).first()
    wanted = ranges * SAMPLED
    thin = F.pmod(F.xxhash64(first), F.lit(max(1, distinct // wanted))) == 0
    sample = sorted(r[0] for r in df.where(first.isNotNull() & thin).select(first).distinct().limit(4 * wanted).collect())
    step = max(1, -(-len(sample) // ranges))
    cuts = sample[step::step]
    ranged = df.withColumn("_range", F.when(first.isNull(), 0).otherwise(_place(first, cuts, 1)))
    starts, before = [], 0
    for r in sorted(ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(r[0]), F.lit(before)]
        before += r["n"]
    if not total:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    within = F.row_number().over(W.partitionBy("_range").orderBy(*[F.col(f"`{o}`") for o in order])) - 1
    start = F.element_at(F.create_map(*starts), F.col("_range"))
    return ranged.withColumn(name, (within + start).cast("long")).drop("_range")
