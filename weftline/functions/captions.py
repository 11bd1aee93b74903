"""Caption words as the published metrics take them: a tokenizer in states, and the stems of English words.

The tokenizer follows the conventions of the Penn Treebank: lower case, contractions cut before the apostrophe or the n of n't,
possessives cut off, numbers with their points and commas whole, abbreviations of single letters whole, hyphens inside words;
brackets, quotes and marks of punctuation are tokens that the metrics leave out. Stems are Porter's (1980).
"""

from __future__ import annotations

import functools
import re

#: Tokens that are left out of captions (fixed values).
LEFT_OUT = frozenset("'' ' `` ` -lrb- -rrb- -lcb- -rcb- . ? ! , : - -- ... ;".split())
#: How brackets are written as tokens (fixed values).
BRACKETS = {"(": "-lrb-", ")": "-rrb-", "{": "-lcb-", "}": "-rcb-", "[": "-lsb-", "]": "-rsb-"}
#: Words that are two (fixed values).
MERGED = {"cannot": ("can", "not"), "gonna": ("gon", "na"), "gotta": ("got", "ta"), "wanna": ("wan", "na"), "gimme": ("gim", "me"), "lemme": ("lem", "me")}
#: Endings that are words of their own behind an apostrophe (fixed values).
ENDINGS = ("'s", "'re", "'ve", "'ll", "'d", "'m")


def tokens(caption: str | None) -> list[str]:
    """All tokens of a caption; states: between words, in a word, in a number, in a run of points or dashes."""
    text = (caption or "").lower().replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')
    out: list[str] = []
    state, start, i, opened = "between", 0, 0, False
    while i <= len(text):
        c = text[i] if i < len(text) else " "
        after = text[i + 1] if i + 1 < len(text) else " "
        if state == "word":
            inside = c.isalnum() or (c in "'-" and after.isalnum()) or (c == "." and i - start == 1 and after.isalpha()) or (c == "." and text[i - 2 : i - 1] == ".")
            if inside:
                i += 1
                continue
            out += word_parts(text[start:i])
            state = "between"
        elif state == "number":
            if c.isdigit() or (c in ".,:/-" and after.isdigit()):
                i += 1
                continue
            if c.isalpha():
                state = "word"
                continue
            out.append(text[start:i])
            state = "between"
        elif state == "run":
            if c == text[start]:
                i += 1
                continue
            run = text[start:i]
            out.append(("..." if run[0] == "." else "--") if len(run) > 1 else run)
            state = "between"
        elif c.isspace():
            i += 1
        elif c.isdigit() or (c == "." and after.isdigit()):
            state, start, i = "number", i, i + 1
        elif c.isalnum() or (c == "'" and text[i : i + 3].rstrip() in ENDINGS):
            state, start, i = "word", i, i + 1
        elif c in ".-":
            state, start, i = "run", i, i + 1
        else:
            if c == '"':
                out.append("''" if opened else "``")
                opened = not opened
            else:
                out.append(BRACKETS.get(c, c))
            i += 1
    return out


def word_parts(word: str) -> list[str]:
    """A word without its contraction, and that."""
    if word in MERGED:
        return list(MERGED[word])
    if word.endswith("n't") and len(word) > 3:
        return [word[:-3], "n't"]
    for ending in ENDINGS:
        if word.endswith(ending) and len(word) > len(ending):
            return [word[: -len(ending)], ending]
    return [word]


def caption_words(caption: str | None) -> list[str]:
    """The tokens that count."""
    return [t for t in tokens(caption) if t not in LEFT_OUT]


#: Porter's steps 2 to 4: endings and what takes their place (fixed values).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWELS_THEN = re.compile("v+c+")


def _kinds(stem: str) -> str:
    """v or c for each letter; y is a vowel behind a consonant."""
    out = ""
    for k, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VOWELS_THEN.findall(_kinds(stem)))


def _short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _kinds(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case English word."""
    w = word
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if cut is not None and "v" in _kinds(cut):
            w = cut
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for steps in (STEP_2, STEP_3):
        ending = max((e for e in steps if w.endswith(e)), key=len, default=None)
        if ending and _measure(w[: -len(ending)]):
            w = w[: -len(ending)] + steps[ending]
    ending = max((e for e in STEP_4 if w.endswith(e)), key=len, default=None)
    if ending and _measure(w[: -len(ending)]) > 1 and (ending != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(ending)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w
