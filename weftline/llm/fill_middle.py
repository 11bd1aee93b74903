"""Fill-in-the-middle rearrangement (operator 12).

A text is cut into units (lines here) by a pattern, matched left to right. A first pass over a lazy match
iterator counts the units; two ranks follow from the count and a hash of the id; a second lazy iterator
is advanced to both ranks, and their match ends are the cuts. No unit and no list of units is ever held:
beside the text and its rearrangement a task keeps a counter and two offsets.

Forms: psm `<P>`prefix`<S>`suffix`<M>`middle; spm `<S>`suffix`<P>`prefix`<M>`middle; plain, the text as it
was. A rearranged text holds each marker once, since a text that has any stays plain and no marker can begin
in a text and end in a marker ("<" is only the first character of each); so splitting at the markers
restores it.

Defined cases: null text is empty, and an empty text is plain with no units; a null id is hashed as no digits;
repeated rows give repeated results; an empty table an empty result; only the id and the text column are
read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, ids_and_texts

LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Of a hundred texts so many are rearranged, and of a hundred of those so many in the form spm.
RATE, SPM_RATE = 100, 50
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def count_units(unit: re.Pattern[str], text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def offsets(unit: re.Pattern[str], text: str, first: int, second: int) -> tuple[int, int]:
    """Ends of the first `first` and of the first `second` >= `first` units; 0 for none."""
    matches = unit.finditer(text)
    a = _end_after(matches, first, 0)
    return a, _end_after(matches, second - first, a)


def _end_after(matches: Iterator[re.Match[str]], steps: int, at: int) -> int:
    last = next(itertools.islice(matches, steps - 1, None), None) if steps else None
    return last.end() if last else at


def rearranged(doc_id: int | None, text: str, unit: re.Pattern[str], seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(unit, text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = offsets(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = MARKERS
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; the lengths are null where the form is plain.

    unit: a pattern that matches no empty string and leaves no character out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        rows = ((k, *rearranged(k, text, pattern, seed, rate, spm_rate)) for batch in batches for k, text in ids_and_texts(batch))
        yield from bounded(rows, _SCHEMA)

    ddl = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ddl)


def restored_text(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text that transform() was given, from the form and the output alone."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    parts = F.split(output, "|".join(MARKERS), -1)  # nothing, then the parts in the form's order
    prefix, suffix = (F.when(form == "psm", parts[k]).otherwise(parts[3 - k]) for k in (1, 2))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    out = transform(docs, id_col, text_col)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
units AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(d, 8 * k + 1, 8) AS BIGINT)) AS h FROM docs),
ranks AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM ranks)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts"""
