"""Text analysis for the keyword index.

``standard_terms``: words in lower case. ``english_terms``: the same words without
possessive endings and stop words, reduced to stems with Porter's 1980 rules
("An algorithm for suffix stripping"). Both work on array columns, so analysis never
shuffles; every stemming step is one ``transform`` over the array. ``english_term`` is
the same for one word, for tasks that stem each distinct word once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is letters, marks, digits and underscores, with inner apostrophes.
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’][\p{L}\p{M}\p{N}_]+)*"

# The usual short English stop list.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)

# Consonant and vowel runs of the stemming rules, then stem shapes.
_C = r"[^aeiou][^aeiouy]*"
_V = r"[aeiouy][aeiou]*"
MEASURE_OVER_0 = f"^(?:{_C})?{_V}{_C}"
MEASURE_IS_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
MEASURE_OVER_1 = f"^(?:{_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^(?:{_C})?[aeiouy]"
ENDS_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes of steps 2 to 4 of the stemming rules with their replacement.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def standard_terms(text: Column) -> Column:
    """Words of ``text`` in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def _suffix(w: Column, suffixes: str) -> tuple[Column, Column]:
    """(stem, longest matching suffix); the suffix is empty when none matches."""
    pattern = f"^(.*?)({suffixes})$"
    return F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)


def _plural(w: Column) -> Column:
    return (
        F.when(w.rlike("(?:ss|i)es$"), F.substr(w, F.lit(1), F.length(w) - 2))
        .when(w.rlike("[^s]s$"), F.substr(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def _past_and_ing(w: Column) -> Column:
    stem = F.regexp_replace(w, "(?:ed|ing)$", "")

    def tidy(s: Column) -> Column:
        return (
            F.when(s.rlike("(?:at|bl|iz)$"), F.concat(s, F.lit("e")))
            .when(
                F.substr(s, F.length(s), F.lit(1)).eqNullSafe(F.substr(s, F.length(s) - 1, F.lit(1)))
                & s.rlike("[^aeiouylsz]$"),
                F.substr(s, F.lit(1), F.length(s) - 1),
            )
            .when(s.rlike(ENDS_CVC), F.concat(s, F.lit("e")))
            .otherwise(s)
        )

    return (
        F.when(
            w.endswith("eed"),
            F.when(
                F.substr(w, F.lit(1), F.length(w) - 3).rlike(MEASURE_OVER_0),
                F.substr(w, F.lit(1), F.length(w) - 1),
            ).otherwise(w),
        )
        .when(w.rlike("(?:ed|ing)$") & stem.rlike(HAS_VOWEL), tidy(stem))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    stem = F.substr(w, F.lit(1), F.length(w) - 1)
    return F.when(w.endswith("y") & stem.rlike(HAS_VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _replace(table: dict[str, str]):
    def step(w: Column) -> Column:
        stem, suffix = _suffix(w, "|".join(table))
        target = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.when(
            (suffix != "") & stem.rlike(MEASURE_OVER_0), F.concat(stem, F.try_element_at(target, suffix))
        ).otherwise(w)

    return step


def _drop(w: Column) -> Column:
    stem, suffix = _suffix(w, "|".join(STEP_4))
    ion = F.regexp_extract(w, "^(.*[st])ion$", 1)
    return (
        F.when(suffix != "", F.when(stem.rlike(MEASURE_OVER_1), stem).otherwise(w))
        .when((ion != "") & ion.rlike(MEASURE_OVER_1), ion)
        .otherwise(w)
    )


def _final_e(w: Column) -> Column:
    stem = F.substr(w, F.lit(1), F.length(w) - 1)
    return F.when(
        w.endswith("e") & (stem.rlike(MEASURE_OVER_1) | (stem.rlike(MEASURE_IS_1) & ~stem.rlike(ENDS_CVC))), stem
    ).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(
        w.endswith("ll") & w.rlike(MEASURE_OVER_1), F.substr(w, F.lit(1), F.length(w) - 1)
    ).otherwise(w)


def _on(step, endings: tuple[str, ...]):
    """Apply a step to longer words with one of the endings; a cheap test before its patterns."""
    size = len(endings[0])
    return lambda w: F.when((F.length(w) > 2) & F.right(w, F.lit(size)).isin(*endings), step(w)).otherwise(w)


def _last_two(suffixes) -> tuple[str, ...]:
    return tuple(sorted({s[-2:] for s in suffixes}))


def stem_terms(terms: Column) -> Column:
    """Stems of an array of lower-case words; words of one or two letters stay."""
    steps = (
        _on(_plural, ("s",)),
        _on(_past_and_ing, ("ed", "ng")),
        _on(_final_y, ("y",)),
        _on(_replace(STEP_2), _last_two(STEP_2)),
        _on(_replace(STEP_3), _last_two(STEP_3)),
        _on(_drop, _last_two((*STEP_4, "ion"))),
        _on(_final_e, ("e",)),
        _on(_final_ll, ("ll",)),
    )
    for step in steps:
        terms = F.transform(terms, step)
    return terms


def english_terms(text: Column) -> Column:
    """Stems of ``text`` in order, possessives and stop words removed."""
    words = F.transform(standard_terms(text), lambda w: F.regexp_replace(w, "['’]s$", ""))
    return stem_terms(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


# --- one word, inside a task ----------------------------------------------------------


def _matches(text: str, pattern: str) -> bool:
    return re.search(pattern, text) is not None


def _swapped(w: str, table: dict[str, str]) -> str:
    found = re.search(f"^(.*?)({'|'.join(table)})$", w)
    return found[1] + table[found[2]] if found and _matches(found[1], MEASURE_OVER_0) else w


def _unfinished(w: str) -> str:
    """Without ``ed`` or ``ing``, where a vowel stands before them."""
    if w.endswith("eed"):
        return w[:-1] if _matches(w[:-3], MEASURE_OVER_0) else w
    stem = re.sub("(?:ed|ing)$", "", w)
    if stem == w or not _matches(stem, HAS_VOWEL):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _matches(stem, "[^aeiouylsz]$"):
        return stem[:-1]
    return stem + "e" if _matches(stem, ENDS_CVC) else stem


@lru_cache(maxsize=1 << 18)
def english_term(word: str) -> str | None:
    """What ``english_terms`` makes of one word of ``standard_terms``; None for a stop word."""
    w = re.sub("['’]s$", "", word)
    if w in STOP_WORDS:
        return None
    if len(w) > 2 and w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if len(w) > 2 and w.endswith(("ed", "ing")):
        w = _unfinished(w)
    if len(w) > 2 and w.endswith("y") and _matches(w[:-1], HAS_VOWEL):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if len(w) > 2:
            w = _swapped(w, table)
    if len(w) > 2:
        found = re.search(f"^(.*?)({'|'.join(STEP_4)})$", w)
        if found:
            w = found[1] if _matches(found[1], MEASURE_OVER_1) else w
        elif w.endswith(("sion", "tion")) and _matches(w[:-3], MEASURE_OVER_1):
            w = w[:-3]
    if len(w) > 2 and w.endswith("e"):
        less = w[:-1]
        if _matches(less, MEASURE_OVER_1) or (_matches(less, MEASURE_IS_1) and not _matches(less, ENDS_CVC)):
            w = less
    return w[:-1] if len(w) > 2 and w.endswith("ll") and _matches(w, MEASURE_OVER_1) else w
