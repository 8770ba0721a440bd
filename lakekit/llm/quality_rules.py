"""Quality rules by line: lines that fail are removed, documents that lose too much text are rejected.

A line fails when it is navigation (marks between its words, or a few words with a link mark), when
it is boilerplate (a fixed phrase), or when its punctuation is not that of prose (no sentence ends in it
or at its end, or more marks than words allow). All measures are built-in expressions over one row; nothing moves.

Null text has no words: all counts are 0, it fails and is not kept. Rows are kept as they are. An
empty table gives an empty result. Columns of the input with the name of an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_names

# Fixed values of the base rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
# The line rules.
BARS = "[|•»›]"
MARKS = r"[!?.,;:|#$%&*<>@~^=+_/\\\"()\[\]{}]"
CARRIES_ON = r"\p{L}[.!?…]\x20"
ENDINGS = r"[.!?:;…\"'»”’)\]][\x20\x09-\x0D]*\z"
# Lower-case phrases, without signs that patterns give a meaning.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "click here",
    "sign up for",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "verwendet cookies",
    "javascript aktivieren",
    "klicken sie hier",
    "tous droits réservés",
    "conditions d'utilisation",
    "politique de confidentialité",
    "utilise des cookies",
    "activer javascript",
    "cliquez ici",
    "todos los derechos reservados",
    "términos de uso",
    "política de privacidad",
    "utiliza cookies",
    "activar javascript",
    "haga clic aquí",
)
MOST_MARKS = 0.6
MOST_LOST = 0.5


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside runs of `window` words that occur twice or more in `words`.

    Every word is hashed once, a run by the hashes of its words. Hashes of all runs are sorted with
    their places; equal neighbours are repeats, and the places in order say how many words each adds.
    Texts without any repeat are told by their distinct hashes.
    """

    def places(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            same = lambda p, j: F.get(pairs, j)["h"].eqNullSafe(p["h"])
            return F.filter(
                F.transform(pairs, lambda p, j: F.when(same(p, j - 1) | same(p, j + 1), p["i"])), lambda i: i.isNotNull()
            )

        return F.sort_array(_let(ordered, twice))

    def covered(at: Column) -> Column:
        added = F.transform(at, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - p, F.lit(window))))
        return F.aggregate(added, F.lit(0).cast("bigint"), lambda total, n: total + n)

    def count(hashes: Column) -> Column:
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(_let(places(hashes), covered))

    def runs(each: Column) -> Column:
        first = F.slice(each, F.lit(1), F.greatest(F.size(each) - (window - 1), F.lit(0)))
        return F.transform(first, lambda h, i: F.xxhash64(h, *[F.get(each, i + k) for k in range(1, window)]))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), runs), count)


def line_fails(line: Column, boilerplate: Sequence[str] = BOILERPLATE) -> Column:
    """Whether a line with a word is navigation, boilerplate or not punctuated like prose.

    `boilerplate` holds phrases in lower case. The rules stand in the order of their costs.
    """
    words = _times(line, WORD)
    bars = _times(line, BARS)
    # a line that just goes on after a sentence is still prose
    stops = line.rlike(ENDINGS) | line.rlike(CARRIES_ON)
    marks = _times(line, MARKS) > words * MOST_MARKS + 3
    navigation = (bars >= 1) & ((bars >= 2) & (bars * 4 >= words) | (words <= 6))
    fails = ~stops | marks | navigation
    if boilerplate:
        phrases = "|".join(re.escape(p) for p in boilerplate)
        fails = fails | (words <= 40) & F.lower(line).rlike(phrases)
    return fails


def measures(text: Column, counted: str) -> dict[str, Column]:
    """The base measures of a text that is not null; those by word are fields `n`, `c` and `r` of `counted`."""
    words = F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    # all counts of one array, so that the text is cut into words once
    counts = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("c"),
            repeated_words(w).alias("r"),
        ),
    )
    return {
        counted: counts,
        "n_symbols": _times(text, SYMBOLS).cast("bigint"),
        "n_dup_lines": _let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def clean(
    docs: DataFrame, text_col: str = "text", most_lost: float = MOST_LOST, boilerplate: Sequence[str] = BOILERPLATE
) -> DataFrame:
    """Adds the measures, `clean_text` (the lines that pass), `lost` (share of word characters removed),
    `base_failed` and `kept`."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost", "kept")
    if text_col in names:
        raise ValueError(f"{text_col} is an output column")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD) & ~line_fails(x, boilerplate))
    own = free_names([*docs.columns, *names], 1)[0]
    found = held.withColumns({**measures(text, own), "clean_text": F.array_join(lines, "\n")})
    left = F.char_length(F.regexp_replace("clean_text", SPACE_CLASS, ""))
    counted = found.withColumns(
        {
            "n_words": F.col(f"{own}.n"),
            "word_chars": F.col(f"{own}.c"),
            "n_repeat_words": F.col(f"{own}.r"),
            "lost": F.when(F.col(f"{own}.c") > 0, 1 - left / F.col(f"{own}.c")).otherwise(F.lit(1.0)),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    judged = counted.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost))
    return judged.drop(own)
