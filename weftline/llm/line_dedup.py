"""Line dedup by winnowing (operator 6), in DataFrame functions only.

A document is the sequence of its lines that have a word, split at \\n. Windows are all stretches of `run`
such lines, all shorter ones of more than `words` words, and a document of fewer than `run` lines as a
whole: equal stretches of whole lines go if they have `run` lines or more than `words` words, and copies
of short documents go; a short line alone stays.

1. Winnowing. Fingerprinted are the least windows: stretches of fewer than `run` lines with more than `words` words of
   which no part has as many (a long line alone, two lines of which neither is long), whole documents of
   fewer lines, and, of windows of `run` lines that hold none of these, the line with the smallest hash (the leftmost
   of equal ones). Equal windows hold an equal fingerprint at the same place, so none is lost; a row leaves the
   document for each selected place, and there are fewer of them than lines.
2. Positions. Fingerprints that were selected at one place only can't be part of a repeat and are dropped;
   the others' places go back to their documents' line hashes.
3. Extension. There each place is extended both ways, to all windows that hold it, each once a document. Windows that
   are equal to one at an earlier place mark their lines; marks that touch make up the runs.

Earlier means: smaller doc_id (null first), then smaller MD5 of the text, then earlier line. So the first
copy of a run stays, and every later one is deleted, within a document too. Counts of fingerprints and of
windows are added up before they are shuffled, and rows of hot ones meet them by a broadcast of bounded
size (common.hot_join), so a line that a third of all documents have fills no task.

Defined cases: null text has no lines and stays null; lines without a word stay; rows equal in id and
text are one document twice and get the same result; an empty table gives an empty result; input
columns of any name are carried in a struct. Lines and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_join, row_struct, written

RUN = 3
WORDS = 50


def line_hashes(rows: DataFrame) -> DataFrame:
    """(doc, c, n): hashes and numbers of words of each document's lines with a word; documents that have some, once each."""
    hashed = F.filter(F.transform(F.split("text", "\n"), lambda line: F.struct(F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("n"))), lambda x: x["n"] > 0)
    held = rows.select("doc", hashed.alias("x")).where(F.size("x") > 0)
    return held.select("doc", F.transform("x", lambda x: x["h"]).alias("c"), F.transform("x", lambda x: x["n"]).alias("n"))


def _selected(i: Column, run: int) -> Column:
    """(h, p) of the line that the window from i on selects."""
    return F.array_min(F.transform(F.slice("c", i + 1, run), lambda h, o: F.struct(h.alias("h"), (o + i).alias("p"))))


def _window_hash(i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get("c", i + j) for j in range(k)])


def _words_in(i: Column, k: int) -> Column:
    return sum((F.get("n", i + j) for j in range(1, k)), F.get("n", i)) if k else F.lit(0)


def _bare(i: Column, run: int, words: int) -> Column:
    """Whether no shorter window of more than `words` words lies in the window of `run` lines from i on."""
    return (_words_in(i, run - 1) <= words) & (_words_in(i + 1, run - 1) <= words)


def fingerprints(lines: DataFrame, run: int, words: int = WORDS) -> DataFrame:
    """(doc, p, k, h): a row for each place of a least window of k lines; where k is run, of a line that such a window selects."""
    size = F.size("c")
    kind = "array<struct<p:int,k:int,h:bigint>>"
    selected = F.transform(F.filter(F.sequence(F.lit(0), size - run), lambda i: _bare(i, run, words)), lambda i: _selected(i, run))
    # minima of sliding windows only move on, so a place is new where it differs from the window before's
    new = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["p"] != x["p"], F.lit(True)))
    winnowed = F.transform(new, lambda x: F.struct(x["p"].alias("p"), F.lit(run).alias("k"), x["h"].alias("h")))

    def short(k: int) -> Column:
        least = lambda i: (_words_in(i, k) > words) & (_words_in(i, k - 1) <= words) & (_words_in(i + 1, k - 1) <= words)
        starts = F.filter(F.sequence(F.lit(0), size - k), least)
        whole = F.when((size == k) & (_words_in(F.lit(0), k) <= words), F.array(F.lit(0)))  # a document of few words
        return F.transform(F.when(size >= k, F.coalesce(whole, starts)), lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), _window_hash(i, k).alias("h")))

    found = lines.select("doc", "c", "n", F.when(size >= run, selected).alias("s"))
    all_places = [F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (winnowed, *[short(k) for k in range(1, run)])]
    return found.select("doc", F.explode(F.concat(*all_places)).alias("x")).select("doc", "x.p", "x.k", "x.h")


def extended(lines: DataFrame, places: DataFrame, run: int, words: int = WORDS) -> DataFrame:
    """(doc, i, k, w): the windows that hold the places, each once a document, and their hashes."""
    known = lines.join(places.groupBy("doc").agg(F.collect_list(F.struct("p", "k")).alias("at")).withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")))
    size, kind = F.size("c"), "array<struct<i:int,k:int>>"

    def holding(at: Column, k: int) -> Column:
        """Windows of k lines round a least window: all of them are long enough."""
        starts = F.sequence(F.greatest(at["p"] + at["k"] - k, F.lit(0)), at["p"])
        return F.when((at["k"] <= k) & (at["k"] < run), F.transform(F.filter(starts, lambda i: i + k <= size), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k")).cast("struct<i:int,k:int>")))

    def selecting(at: Column) -> Column:
        around = F.sequence(F.greatest(at["p"] - run + 1, F.lit(0)), F.least(at["p"], size - run))
        mine = F.filter(around, lambda i: _bare(i, run, words) & (_selected(i, run)["p"] == at["p"]))
        return F.when(at["k"] == run, F.transform(mine, lambda i: F.struct(i.alias("i"), F.lit(run).alias("k")).cast("struct<i:int,k:int>")))

    none = F.array().cast(kind)
    of = lambda at: F.concat(F.coalesce(selecting(at), none), *[F.coalesce(holding(at, k), none) for k in range(1, run + 1)])
    windows = known.select("doc", "c", F.explode(F.array_distinct(F.flatten(F.transform("at", of)))).alias("x")).select("doc", "c", "x.i", "x.k")
    whole = F.coalesce(*[F.when(F.col("k") == k, _window_hash(F.col("i"), k)) for k in range(1, run + 1)])
    return windows.select("doc", "i", "k", whole.alias("w"))


def doomed(rows: DataFrame, run: int) -> DataFrame:
    """(doc, gone): of each document that repeats something, the places among its lines with a word."""
    lines = written(line_hashes(rows))
    found = written(fingerprints(lines, run))
    counts = found.groupBy("k", "h").agg(F.count("*").alias("times")).where("times > 1")
    recurring = hot_join(found, counts, ["k", "h"], "times", found.count()).select("doc", "p", "k")
    windows = written(extended(lines, recurring, run))
    place = F.struct("doc", "i")
    first = windows.groupBy("k", "w").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("times")).where("first != last").select("k", "w", "first", "times")
    later = hot_join(windows, first, ["k", "w"], "times", windows.count()).where(place != F.col("first")).select("doc", "i", "k")
    return later.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("i", F.col("i") + F.col("k") - 1)))).alias("gone"))


def dedup(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row: the input row, n_lines, n_removed, kept: the text without the deleted lines), a row for each of docs."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.md5(text).alias("text"))
    rows = docs.select(row_struct(docs).alias("_row"), key.alias("doc"), text.alias("text"))
    gone = doomed(rows.select("doc", "text"), run).withColumnRenamed("doc", "other")
    joined = rows.join(gone, F.col("doc").eqNullSafe(F.col("other")), "left").withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    worded = F.filter(F.transform("lines", lambda line, j: F.struct(line.rlike(WORD).alias("has"), j.alias("j"))), lambda x: x["has"])
    spots = joined.withColumn("spots", F.transform(worded, lambda x: x["j"]))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda g: F.get("spots", g)))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda j: F.get("lines", j)), "\n"))
    return spots.select("_row", F.size("spots").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))


def clean(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with the text that is left; n_chars, where there is one, follows it. No row goes."""
    out = dedup(docs, run)
    fields = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[(fields[c] if c in fields else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the SHA-256 of the text that is left."""
    out = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


_KEYS = " UNION ALL ".join(
    f"SELECT doc_id, i, {k} AS k, {' || chr(10) || '.join(['line', *[f'lead(line, {j}) OVER o' for j in range(1, k)]])} AS key, {' + '.join(['n', *[f'lead(n, {j}) OVER o' for j in range(1, k)]])} AS n, size FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)"
    for k in range(1, RUN + 1)
)
#: The same without fingerprints: every window against all others by its text.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS j
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
worded AS (SELECT doc_id, line, j, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, count(*) OVER (PARTITION BY doc_id) AS size
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (SELECT * FROM ({_KEYS}) WHERE i + k - 1 <= size AND (k = {RUN} OR n > {WORDS} OR (k = size AND size < {RUN}))),
later AS (SELECT doc_id, i, k FROM windows QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + s AS i FROM later, range({RUN}) AS r(s) WHERE s < k),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.j) AS kept FROM lines l
  LEFT JOIN worded w USING (doc_id, j) LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""
