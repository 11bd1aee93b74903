"""Text rules as column expressions: answer normalisation, templates, markers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import ARTICLES, CONTRACTIONS, END, IMAGE_START, IMAGE_TOKEN, NUMBER_WORDS, PUNCTUATION, SIDE_WORDS

#: What Python's strip and split take as white space, for texts from JSON.
_WS = r"[\s\x1c-\x1f\x85   -     　]"


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x) with x evaluated once, however often `then` names it; else chains of rules grow exponentially."""
    return F.get(F.transform(F.array(x), lambda v: then(v)), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends (trim takes spaces only)."""
    return F.regexp_replace(x, f"^{_WS}+|{_WS}+$", "")


def _after(start: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.contains(v, F.lit(start)), F.split_part(v, F.lit(start), F.lit(2))).otherwise(v)


def extract_answer(x: Column) -> Column:
    """The short answer in a reply: quotes go, the first line up to a full stop, comma or exclamation mark is
    lower-cased, then cut by substrings in a fixed order (so 'a ' inside a word counts too)."""
    out = strip(F.replace(x, F.lit('"'), F.lit("")))
    for end in ("\n", ".", ",", "!"):
        out = F.substring_index(out, end, 1)
    out = F.lower(out)
    for start in ("is ", "are ", "a ", "an ", "the "):
        out = let(out, _after(start))
    for end in (" of", " or ", " and "):
        out = F.substring_index(out, end, 1)
    return strip(out)


def clean_answer(x: Column) -> Column:
    """Line ends and tabs as spaces, then stripped."""
    return strip(F.translate(x, "\n\t", "  "))


def strip_periods(x: Column) -> Column:
    """Without the dots that no digit follows."""
    return F.regexp_replace(x, r"\.(?![0-9])", "")


def process_punctuation(x: Column) -> Column:
    """Each mark is deleted where the input has it next to a space or has a comma between digits, else a space takes its place."""
    between_digits = x.rlike("[0-9],[0-9]")
    out = x
    for p in PUNCTUATION:
        beside = F.contains(x, F.lit(p + " ")) | F.contains(x, F.lit(" " + p))
        out = F.replace(out, F.lit(p), F.when(beside | between_digits, "").otherwise(" "))
    return strip_periods(out)


def process_digits_articles(x: Column, contractions: Mapping[str, str] = CONTRACTIONS) -> Column:
    """Lower case, number words as digits, no articles, contractions spelled out, single spaces."""
    numbers, spelled = (F.create_map(*[F.lit(s) for kv in m.items() for s in kv]) for m in (NUMBER_WORDS, contractions))
    words = F.filter(F.split(strip(F.lower(x)), f"{_WS}+"), lambda w: w != "")
    digits = F.transform(words, lambda w: F.coalesce(numbers[w], w))
    kept = F.filter(digits, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(spelled[w], w)), " ")


def normalise_answer(x: Column, contractions: Mapping[str, str] = CONTRACTIONS) -> Column:
    return process_digits_articles(process_punctuation(x), contractions)


def smart_join(parts: Column) -> Column:
    """An array of captions as one lower-case caption."""
    return F.lower(F.array_join(parts, " "))


def first_sentence(x: Column) -> Column:
    return F.substring_index(x, ".", 1)


def recapitalise(x: Column, names: Sequence[str]) -> Column:
    """Lower case but for the names, without line ends and tabs, stripped."""
    out = F.lower(x)
    for name in names:
        out = F.replace(out, F.lit(name.lower()), F.lit(name))
    return strip(F.translate(out, "\n\t", ""))


def swap_sides(x: Column) -> Column:
    """'left' for 'right' and the other way round."""
    held = F.replace(x, F.lit("left"), F.lit("\x01"))
    return F.replace(F.replace(held, F.lit("right"), F.lit("left")), F.lit("\x01"), F.lit("right"))


def crop_allowed(x: Column) -> Column:
    """Whether no side is spoken of, which a random crop would make wrong."""
    return ~x.rlike("|".join(SIDE_WORDS))


def template(pattern: str, **values: Column) -> Column:
    """pattern with its {names} filled; {image} is put in front where the pattern lacks it; stripped."""
    out: Column = F.lit(pattern if "{image}" in pattern or "image" not in values else "{image}" + pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return strip(out)


def interleave(sentences: Column, has_image: Column, image_first: Column, n_tokens: int) -> Column:
    """Sentences joined by spaces, a marker block before or after those with an image, no spaces around blocks, an end mark."""
    block = IMAGE_START + IMAGE_TOKEN * n_tokens
    parts = F.transform(
        F.arrays_zip(sentences.alias("s"), has_image.alias("h"), image_first.alias("f")),
        lambda x: F.when(x["h"] & x["f"], F.concat(F.lit(block), x["s"])).when(x["h"], F.concat(x["s"], F.lit(block))).otherwise(x["s"]),
    )
    out = F.array_join(parts, " ")
    for a, b in ((f" {IMAGE_START}", IMAGE_START), (f"{IMAGE_START} ", IMAGE_START), (f" {IMAGE_TOKEN}", IMAGE_TOKEN), (f"{IMAGE_TOKEN} ", IMAGE_TOKEN)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(out, F.lit(END))


def dialog_context(caption: Column, questions: Column, answers: Column, round_no: Column, include_last_round: bool = False) -> Column:
    """Caption and earlier rounds before question round_no (from 1); as published, the round just before is left out."""
    upto = round_no - (1 if include_last_round else 2)
    told = F.transform(F.slice(F.arrays_zip(questions.alias("q"), answers.alias("a")), F.lit(1), F.greatest(upto, F.lit(0))), lambda x: F.concat(F.lit("question: "), x["q"], F.lit("? answer: "), x["a"], F.lit(". ")))
    return F.concat(F.lit("caption: "), caption, F.lit(" . "), F.array_join(told, ""), F.lit("question: "), F.get(questions, round_no - 1), F.lit("? answer: "))
