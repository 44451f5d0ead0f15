"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import let

BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
REPEAT = 5

#: Frequent function words, four languages.
STOP_WORDS = (
    "the be to of and that have with this for not from are was der die das und ist nicht mit ein eine den von zu "
    "le la les de des et que qui dans un une est pour el los las y en por con para una del se"
).split()

#: name, ratio or count, least, most; a text is kept if every row holds.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("words", "n_words", 10, None),
    ("word_length", "word_chars / n_words", 2, 12),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.02, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.3),
    ("repeated_words", "n_repeat_words / n_words", None, 0.2),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
]


def _repeated(words: Column) -> Column:
    """Words in windows of REPEAT words that the text has twice or more; the first occurrence counts too.

    Window hashes are sorted as plain longs to see whether any comes twice. Only then are they sorted with their
    places, and every place covers the words up to the next one, REPEAT at most.
    """

    def places(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda m: F.filter(
            F.transform(
                m,
                lambda x, i: F.when(
                    (F.try_element_at(m, i + 2)["h"] == x["h"]) | ((i > 0) & (F.try_element_at(m, F.greatest(i, F.lit(1)))["h"] == x["h"])), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return let(marked, lambda m: F.sort_array(twice(m)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.try_element_at(p, i + 2) - x, F.lit(REPEAT)), F.lit(REPEAT)).cast("bigint"))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        twice = let(ordered, lambda s: F.exists(F.sequence(F.lit(2), F.size(s)), lambda i: F.element_at(s, i) == F.element_at(s, i - 1)))
        return F.when((F.size(hashes) < 2) | ~F.when(F.size(hashes) < 2, False).otherwise(twice), F.lit(0).cast("bigint")).otherwise(let(places(hashes), covered))

    def hashes(w: Column) -> Column:
        starts = F.when(F.size(w) >= REPEAT, F.sequence(F.lit(1), F.size(w) - (REPEAT - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(REPEAT)]))

    return let(words, lambda w: let(hashes(w), count))


def measures(text: Column) -> dict[str, Column]:
    """Counts of a whole text; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(_BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    n = lambda c: c.cast("bigint")
    stop = r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?=[.,;:!?]*(?:[\x20\x09-\x0D]|\z))"
    return {
        "n_words": n(F.size(words)),
        "word_chars": n(F.length(t) - F.regexp_count(t, F.lit(BLANK))),
        "n_symbols": n(F.regexp_count(t, F.lit(SYMBOLS))),
        "n_dup_lines": n(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": _repeated(words),
        "n_lines": n(F.size(lines)),
        "n_stop_words": n(F.regexp_count(t, F.lit(stop))),
        "n_bullet_lines": n(F.regexp_count(t, F.lit(r"(?m)^[\x20\x09]*[-*•]"))),
        "n_ellipsis_lines": n(F.regexp_count(t, F.lit(r"(?m)(?:\.\.\.|…)[\x20\x09]*$"))),
    }


def verdict(rules=RULES) -> Column:
    """The table as one expression; a ratio over nothing counts as 0."""
    held = F.lit(True)
    for _, ratio, least, most in rules:
        top, _, below = ratio.partition(" / ")
        value = F.col(top).cast("double")
        if below:
            value = F.when(F.col(below) == 0, F.lit(0.0)).otherwise(value / F.col(below))
        if least is not None:
            held = held & (value >= F.lit(float(least)))
        if most is not None:
            held = held & (value <= F.lit(float(most)))
    return held


def assess(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, all measures, base_failed and kept of every row.

    A null or empty text has zeros everywhere and fails. Repeated rows each get a row; other columns are ignored; no
    row leaves its task.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = docs.select("doc_id", *[c.alias(k) for k, c in measures(F.col("text")).items()])
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
