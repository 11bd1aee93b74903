"""Quality rules with adaptive thresholds (operator 9), in DataFrame functions only.

Each document gets counts and four rates in whole thousandths. The rates of the documents that pass
the base rule go into mergeable quantile sketches, one a language, source and rate: counts of bins
with three significant digits (so a quantile is at most one part in a hundred off), which add up in
any order and give the same quantiles on every run. A document is rejected where a rate lies beyond
the quartiles of its own language and source by more than `reach` quartile distances.

Defined cases: null text is empty (no words, fails the base rule); null language or source is a group
of its own; repeated rows count each; an empty table gives an empty result; input columns of any name
are carried in a struct and can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import GAPS, restored, row_struct, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: rate -> (least quartile distance in thousandths, whether low values are rejected too). With a reach of 6 the fences of the
#: two shares can lie at 480, so below the half at which the base rule rejects; at 360 they would take good texts with one
#: line repeated (7 of the labelled ones among 0.10 GB).
RATES = {"chars_per_word": (500, True), "symbols_per_word": (50, False), "dup_line_share": (80, False), "repeat_word_share": (80, False)}


@dataclass(frozen=True)
class Rules:
    """Parameters: the base rule, and how far beyond the quartiles a rate may lie."""

    least_words: int = 50
    repeat_percent: int = 50
    reach: int = 6


def counted(docs: DataFrame, text: Column, carry: list[Column]) -> DataFrame:
    """carry, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    first = docs.select(*carry, text.alias("_text"), F.array_remove(F.split(text, GAPS), "").alias("_words"), F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    held = [c for c in first.columns if not c.startswith("_") or c == "_row"]
    n = F.size("_words")
    # (hash of a three-word window, its place); built, ordered and compared within the row
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p"))))
    second = first.select(
        *held,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,p:int>>"))).alias("_w"),
    )
    again = F.filter("_w", lambda x, i: (x["h"] == F.get("_w", i - 1)["h"]) | (x["h"] == F.get("_w", i + 1)["h"]))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
    return second.select(*held, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered["n"].alias("n_repeat_words"))


def rates(counts: DataFrame) -> DataFrame:
    """The rates in whole thousandths; of nothing, zero."""
    of = lambda part, whole: F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")
    return counts.withColumns({
        "chars_per_word": of("word_chars", "n_words"),
        "symbols_per_word": of("n_symbols", "n_words"),
        "dup_line_share": of("n_dup_lines", "n_lines"),
        "repeat_word_share": of("n_repeat_words", "n_words"),
    })


def failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))


def binned(value: Column) -> Column:
    """value with three significant digits."""
    unit = F.rpad(F.lit("1"), F.greatest(F.length(value.cast("string")) - 2, F.lit(1)), F.lit("0")).cast("long")
    return value - value % unit


def sketches(rated: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, rate, bin, n) over the rows that pass the base rule: sums, so parts can be merged at will.

    rated should be a written table: a filter pushed below the counting expressions would evaluate them per word.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), binned(F.col(r)).alias("bin")) for r in RATES]))
    return rated.where(~failed(rules)).select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.rate", "x.bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, and low and high of each rate) from the quartiles of the sketches; a group has few bins."""
    group = W.partitionBy("lang", "source", "rate")
    upto = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    at = lambda share: F.min(F.when(100 * F.col("upto") >= share * F.col("all"), F.col("bin")))
    quartiles = upto.groupBy("lang", "source", "rate").agg(at(25).alias("q1"), at(75).alias("q3"))
    least = F.create_map(*[F.lit(x) for r, (d, _) in RATES.items() for x in (r, d)])
    spread = rules.reach * F.greatest(F.col("q3") - F.col("q1"), F.get(F.array(least[F.col("rate")]), F.lit(0)))
    fences = quartiles.select("lang", "source", "rate", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    pick = [F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{r}_{side}") for r in RATES for side in ("low", "high")]
    return fences.groupBy("lang", "source").agg(*pick)


def judged(docs: DataFrame, carry: list[Column], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """carry, the counts, base_failed and kept of every row of docs.

    Counts are written once to the shared folder; the thresholds too, so that the join below knows
    their size and broadcasts them only if they are small (else it sorts and AQE splits hot groups).
    """
    group = [F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source")]
    rated = written(rates(counted(docs, F.col(f"`{text_col}`"), [*carry, F.struct(*group).alias("group")])))
    flat = rated.withColumns({"lang": F.col("group.lang"), "source": F.col("group.source")})
    fences = written(thresholds(sketches(flat, rules), rules)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = flat["lang"].eqNullSafe(fences["_lang"]) & flat["source"].eqNullSafe(fences["_source"])
    inside = F.lit(True)
    for rate, (_, low_too) in RATES.items():
        inside &= F.col(rate) <= F.col(f"{rate}_high")
        if low_too:
            inside &= F.col(rate) >= F.col(f"{rate}_low")
    verdict = flat.join(fences, same, "left").withColumn("base_failed", failed(rules))
    # where a group has no sketch, all its rows failed the base rule
    return verdict.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("lang", "source", "group", "_lang", "_source", *[f"{r}_{s}" for r in RATES for s in ("low", "high")])


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    return restored(judged(docs, [row_struct(docs).alias("_row")], rules=rules).where("kept"), docs.columns)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    out = judged(docs, [F.col(id_col).alias("doc_id")], text_col)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATE_SQL = " UNION ALL ".join(
    f"SELECT lang, source, '{r}' AS rate, {r} - {r} % CAST(rpad('1', CAST(greatest(length(CAST({r} AS VARCHAR)) - 2, 1) AS INTEGER), '0') AS BIGINT) AS bin FROM rated WHERE NOT base_failed" for r in RATES
)
_FENCE_SQL = " AND ".join(
    f"coalesce(k.{r} <= max(CASE WHEN f.rate = '{r}' THEN f.high END), true)" + (f" AND coalesce(k.{r} >= max(CASE WHEN f.rate = '{r}' THEN f.low END), true)" if low else "") for r, (_, low) in RATES.items()
)
_LEAST_SQL = " ".join(f"WHEN '{r}' THEN {d}" for r, (d, _) in RATES.items())

#: DuckDB's words for counts and verdicts; `rated` and `verdicts` are used by the pipeline's SQL too.
CTES = f"""
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p
          FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
windows AS (SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
found AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM found, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
per_doc AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
counts AS (
  SELECT d.doc_id, d.lang, d.source, CAST(coalesce(p.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(p.word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(coalesce(d.text, '')) - length(translate(coalesce(d.text, ''), '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l.l) AS BIGINT) AS n_lines, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM documents d JOIN lines l USING (doc_id) LEFT JOIN per_doc p USING (doc_id) LEFT JOIN covered c USING (doc_id)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS chars_per_word,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_word_share
  FROM counts),
bins AS (SELECT lang, source, rate, bin, count(*) AS n FROM ({_RATE_SQL}) GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM bins),
quartiles AS (SELECT lang, source, rate, min(CASE WHEN 100 * upto >= 25 * total THEN bin END) AS q1, min(CASE WHEN 100 * upto >= 75 * total THEN bin END) AS q3 FROM upto GROUP BY ALL),
fences AS (SELECT lang, source, rate, q1 - 6 * greatest(q3 - q1, CASE rate {_LEAST_SQL} END) AS low, q3 + 6 * greatest(q3 - q1, CASE rate {_LEAST_SQL} END) AS high FROM quartiles),
verdicts AS (
  SELECT k.doc_id, any_value(k.n_words) AS n_words, any_value(k.word_chars) AS word_chars, any_value(k.n_symbols) AS n_symbols, any_value(k.n_dup_lines) AS n_dup_lines,
         any_value(k.n_repeat_words) AS n_repeat_words, any_value(k.base_failed) AS base_failed, NOT any_value(k.base_failed) AND {_FENCE_SQL.replace("k.", "any_value(k.").replace(" <=", ") <=").replace(" >=", ") >=")} AS kept
  FROM rated k LEFT JOIN fences f ON k.lang IS NOT DISTINCT FROM f.lang AND k.source IS NOT DISTINCT FROM f.source GROUP BY k.doc_id)"""

ORACLE = f"WITH {CTES} SELECT * FROM verdicts"
