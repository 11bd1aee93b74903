"""Query catalogue: DataFrame builders and their SQL, side by side, one module a family."""

from __future__ import annotations

from . import batching, dialogs, evaluation, ingest, mixing, outputs, readers, relations, token_windows, vectors

ENTRY = "conv_rounds"
_FAMILIES = (batching, dialogs, evaluation, ingest, mixing, outputs, readers, relations, token_windows, vectors)

QUERIES = {name: build for family in _FAMILIES for name, build in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
