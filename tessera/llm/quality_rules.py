"""Quality rules: a threshold table compiled into one projection of built-in column functions.

Words are runs of characters other than 0x20 and 0x09-0x0D. Counts per text:

- n_words, word_chars (code points in words), n_symbols (characters of `[#*$%&|<>]`);
- n_lines (`\\n`-split lines that hold a word), n_dup_lines (those equal to an earlier one);
- n_repeat_words (words inside 8-word windows that occur twice or more in the text, the first included);
- n_stop_words (words that, in lower case, are stop words as they stand).

Defined results: null, empty and blank texts have zero counts and fail the base rule, so they are
rejected; a ratio over zero words is 0. Repeated rows are judged one by one. A long text is judged whole, in memory that follows
its length. An empty table gives no rows. Other columns pass through; one that has the name of a count, of base_failed or of kept (in
any case) is replaced. Windows are compared by 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import unused

WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with his they at be this from have or by "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le de un et être à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire les des la est une "
    "el la que y los se del las un por con no una su para es al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes when low <= ratio <= high; an open end is None."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: ratio is SQL over the counts; the bounds follow published heuristic filters for web text.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeated(tagged: str) -> Column:
    """Start positions, ascending, of the windows whose hash a neighbour in sorted order shares."""
    near = lambda k, h: F.coalesce(F.get(tagged, k)["h"] == h, F.lit(False))
    twice = F.filter(tagged, lambda x, k: near(k - 1, x["h"]) | near(k + 1, x["h"]))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts as long columns. One pass, no shuffle, no Python."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in COUNTS]
    words, lines, symbols, h, h2, h4, h8, tagged, places = unused(docs, "words", "lines", "symbols", "h", "h2", "h4", "h8", "tagged", "places")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(
        *keep,
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias(words),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias(symbols),
    )
    pair = lambda c, d: F.transform(F.slice(c, 1, F.greatest(F.size(c) - d, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(c, i + d)))
    step = step.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    for made, of, d in ((h2, h, 1), (h4, h2, 2), (h8, h4, 4)):
        step = step.withColumn(made, pair(F.col(of), d))
    places_of = F.array_sort(F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn(tagged, F.when(F.size(F.array_distinct(h8)) < F.size(h8), places_of))  # most texts repeat nothing
    step = step.withColumn(places, _repeated(tagged))
    gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col(symbols).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )
    # a one-row generator: filters on the counts stay above it, where the counts are computed once
    return step.select(*keep, F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        up, down = r.ratio.split(" / ")
        ratio = F.when(F.col(down) == 0, F.lit(0.0)).otherwise(F.col(up) / F.col(down))
        if r.low is not None:
            out = out & (ratio >= r.low)
        if r.high is not None:
            out = out & (ratio <= r.high)
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed and kept."""
    out = measured(docs.drop("base_failed", "kept"), text)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes(rules))
