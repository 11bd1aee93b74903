"""Conversations as dialogs: rounds, prompts, contexts, stories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_answer, crop_allowed, dialog_context, first_sentence, interleave, recapitalise, swap_sides, template
from ..operators import relational as rel
from ..operators import sequences as seq
from ..tables import table

_ORDER = ("turn", "role", "text")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.chunks(table(spark, sf_dir, "conversations"), "conv_id", 2, *_ORDER)


def conv_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation cut into consecutive pairs; an odd last turn is left out."""
    side = lambda k: F.max(F.when(F.col("place") == k, F.col("text")))
    return _paired(spark, sf_dir).groupBy("conv_id", F.col("chunk").alias("round")).agg(side(0).alias("query"), side(1).alias("label"))


def conv_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each round's question in a prompt template (F8)."""
    filled = template("{system} {user} {assistant}", system=F.lit("Answer briefly."), user=F.concat(F.lit("USER: "), F.col("query")), assistant=F.lit("ASSISTANT:"))
    return conv_rounds(spark, sf_dir).select("conv_id", "round", filled.alias("prompt"))


def dialog_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context before each question, as published without the round just before."""
    rounds = conv_rounds(spark, sf_dir)
    lists = rounds.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("round", "query", "label"))).alias("r"))
    long = lists.select("conv_id", "r", F.explode(F.sequence(F.lit(1), F.size("r"))).alias("n"))
    told = dialog_context(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), F.transform("r", lambda x: x["query"]), F.transform("r", lambda x: x["label"]), F.col("n"))
    return long.select("conv_id", F.col("n").cast("long").alias("round"), told.alias("context"))


def story_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of turns: prefixes of 1 to n - 1 turns, joined."""
    stories = rel.multimap(table(spark, sf_dir, "conversations"), "conv_id", "text", ["turn", "role"])
    return seq.prefixes(stories, "conv_id", F.col("values")).select("conv_id", "length", F.array_join("prefix", " ").alias("prefix"))


def decoded_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogs of indexes into a shared dictionary of roles, decoded in order."""
    conv = table(spark, sf_dir, "conversations")
    roles = spark.createDataFrame([(0, "system"), (1, "user"), (2, "assistant")], "ix int, role string")
    coded = conv.join(F.broadcast(roles), "role")  # three rows
    lists = rel.multimap(coded, "conv_id", "ix", ["turn", "text"]).withColumnRenamed("values", "ixs")
    return rel.decode_list(lists, "conv_id", "ixs", roles, "ix", "role").select("conv_id", F.array_join("texts", ",").alias("roles"))


def dialog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules on turns: first sentence, sides swapped, whether a crop is allowed, names restored, white space."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", first_sentence(t).alias("first"), swap_sides(F.lower(t)).alias("swapped"), crop_allowed(F.lower(t)).alias("crop_ok"),
        recapitalise(t, ["The", "La"]).alias("named"), clean_answer(t).alias("clean"),
    )


def interleaved_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an image marker before every user's and after every assistant's turn."""
    conv = table(spark, sf_dir, "conversations")
    lists = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    text = interleave(F.transform("r", lambda x: x["text"]), F.transform("r", lambda x: x["role"] != "system"), F.transform("r", lambda x: x["role"] == "user"), 2)
    return lists.select("conv_id", text.alias("text"))


def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question behind the two rounds of the next lower conversation ids' first rounds."""
    firsts = conv_rounds(spark, sf_dir).where("round = 0")
    shots = [firsts.select((F.col("conv_id") + k).alias("conv_id"), F.concat(F.lit("Q: "), F.col("query"), F.lit(" A: "), F.col("label"), F.lit("\n")).alias(f"s{k}")) for k in (1, 2)]
    held = firsts.join(shots[0], "conv_id", "left").join(shots[1], "conv_id", "left")
    return held.select("conv_id", F.concat(F.coalesce("s2", F.lit("")), F.coalesce("s1", F.lit("")), F.lit("Q: "), F.col("query"), F.lit(" A:")).alias("prompt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "conv_rounds": conv_rounds,
    "conv_prompt": conv_prompt,
    "dialog_context": dialog_contexts,
    "story_prefixes": story_prefixes,
    "decoded_dialogs": decoded_dialogs,
    "dialog_texts": dialog_texts,
    "interleaved_dialogs": interleaved_dialogs,
    "few_shot_prompts": few_shot_prompts,
}

_ROUNDS = """c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS rn FROM conversations),
rounds AS (SELECT conv_id, CAST(floor(rn / 2) AS BIGINT) AS round, max(CASE WHEN rn % 2 = 0 THEN text END) AS query, max(CASE WHEN rn % 2 = 1 THEN text END) AS label
           FROM c GROUP BY conv_id, CAST(floor(rn / 2) AS BIGINT) HAVING count(*) = 2)"""
_BLOCK = "<|beginofimage|><|image|><|image|>"

ORACLE_SQL: dict[str, str] = {
    "conv_rounds": f"WITH {_ROUNDS} SELECT * FROM rounds",
    "conv_prompt": f"WITH {_ROUNDS} SELECT conv_id, round, 'Answer briefly. USER: ' || query || ' ASSISTANT:' AS prompt FROM rounds",
    "dialog_context": f"""
        WITH {_ROUNDS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round) AS k FROM rounds)
        SELECT a.conv_id, a.k AS round, 'caption: conversation ' || a.conv_id || ' . '
               || coalesce(string_agg('question: ' || b.query || '? answer: ' || b.label || '. ', '' ORDER BY b.k), '') || 'question: ' || any_value(a.query) || '? answer: ' AS context
        FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.k <= a.k - 2 GROUP BY a.conv_id, a.k""",
    "story_prefixes": """
        WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT a.conv_id, a.k AS length, string_agg(b.text, ' ' ORDER BY b.k) AS prefix FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.k <= a.k WHERE a.k < a.n GROUP BY a.conv_id, a.k""",
    "decoded_dialogs": "SELECT conv_id, string_agg(role, ',' ORDER BY turn, text) AS roles FROM conversations GROUP BY conv_id",
    "dialog_texts": r"""
        SELECT conv_id, turn, split_part(text, '.', 1) AS first,
               replace(replace(replace(lower(text), 'left', chr(1)), 'right', 'left'), chr(1), 'right') AS swapped,
               NOT regexp_matches(lower(text), 'top|bottom|left|right|center|middle|side') AS crop_ok,
               regexp_replace(translate(replace(replace(lower(text), 'the', 'The'), 'la', 'La'), chr(10) || chr(9), ''), '^\s+|\s+$', '', 'g') AS named,
               regexp_replace(translate(text, chr(10) || chr(9), '  '), '^\s+|\s+$', '', 'g') AS clean
        FROM conversations""",
    "interleaved_dialogs": f"""
        WITH j AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '{_BLOCK}' || text WHEN 'assistant' THEN text || '{_BLOCK}' ELSE text END, ' ' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
        SELECT conv_id, replace(replace(replace(replace(t, ' <|beginofimage|>', '<|beginofimage|>'), '<|beginofimage|> ', '<|beginofimage|>'), ' <|image|>', '<|image|>'), '<|image|> ', '<|image|>') || '</s>' AS text FROM j""",
    "few_shot_prompts": f"""
        WITH {_ROUNDS}, f AS (SELECT * FROM rounds WHERE round = 0)
        SELECT a.conv_id, coalesce('Q: ' || c.query || ' A: ' || c.label || chr(10), '') || coalesce('Q: ' || b.query || ' A: ' || b.label || chr(10), '') || 'Q: ' || a.query || ' A:' AS prompt
        FROM f a LEFT JOIN f b ON b.conv_id = a.conv_id - 1 LEFT JOIN f c ON c.conv_id = a.conv_id - 2""",
}
