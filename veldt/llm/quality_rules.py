"""Quality rules: a threshold table compiled into one projection of built-in functions.

No user function, pandas, Arrow or RDD code is involved; documents never leave
their partition, so the plan is scan -> project (or filter) and has no exchange.

Defined results for odd input: a null or blank text has zero words and fails the
base rules; ratios over an empty denominator are 0; repeated rows are judged one
by one; an empty table gives an empty result; extra columns pass through ``apply``
untouched and ``metrics`` reads the text alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import SPACE_RUN, SPACES


class Rule(NamedTuple):
    """``low <= metric <= high`` must hold; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Function words of the languages that the corpora mix, any of which marks running text.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "for",
    "le", "la", "les", "de", "des", "et", "un", "que", "qui", "en", "du",
    "der", "die", "das", "und", "ist", "nicht", "ein", "ich", "mit", "zu", "sich",
    "el", "los", "las", "y", "es", "por", "con", "una", "se", "no",
)

#: Verdict thresholds beyond the base rules.
DEFAULT_RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.5),
    Rule("dup_line_ratio", None, 0.5),
    Rule("stop_word_ratio", 0.005, None),
)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it and wherever the optimiser moves it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(grams: Column) -> Column:
    """Words covered by windows whose hash has an equal neighbour in the sorted window list."""
    return F.aggregate(
        F.array_sort(
            F.transform(
                F.filter(
                    grams,
                    lambda x, j: (F.get(grams, j - 1)["h"] == x["h"]) | (F.get(grams, j + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )


def _counts(body: Column, words: Column, stop_words: tuple[str, ...]) -> Column:
    grams = F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(grams, _repeat_words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
    )


def _ratios(c: Column) -> Column:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return F.struct(
        *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")],
        c["lines"]["n"].alias("n_lines"),
        c["lines"]["dup"].alias("n_dup_lines"),
        ratio(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
        ratio(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
        ratio(c["lines"]["dup"], c["lines"]["n"]).alias("dup_line_ratio"),
        ratio(c["n_stop_words"], c["n_words"]).alias("stop_word_ratio"),
    )


def metrics(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Struct of counts and ratios of a text."""

    def measured(body: Column) -> Column:
        trimmed = F.btrim(body, F.lit(SPACES))
        cut = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
        return let(cut, lambda w: let(_counts(body, w, stop_words), _ratios))

    return let(F.coalesce(text, F.lit("")), measured)


def base_failed(m: Column) -> Column:
    """Fewer than 50 words, or over half of the words inside 3-word windows that recur."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """The table of thresholds as one boolean expression."""
    ok = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            ok = ok & (m[rule.metric] >= F.lit(rule.low))
        if rule.high is not None:
            ok = ok & (m[rule.metric] <= F.lit(rule.high))
    return ok


def apply(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Documents that pass the base rules and every threshold, columns unchanged: one filter over the scan."""
    return df.where(let(metrics(F.col(text)), lambda m: ~base_failed(m) & verdict(m, rules)))
