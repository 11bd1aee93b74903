"""Deterministic draws: the same on every run, partitioning and engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash01(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the MD5 of the parts, joined by '|'; null parts count as empty."""
    cast = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cast)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash01_sql(*parts: str) -> str:
    """The same in DuckDB's words; parts are SQL expressions."""
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5({joined}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def hash01_of(*parts: object) -> float:
    """The same of Python values, for operators that work on batches."""
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:8], 16) / 4294967296.0
