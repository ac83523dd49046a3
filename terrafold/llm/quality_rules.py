"""Quality rules as a short-circuit cascade, DataFrame functions only.

Words are longest runs of other characters than space, tab and line or page breaks. Base measures: words, code points in words, symbols,
repeated lines, and words inside 3-word windows that a text holds twice or more. A text fails the base rules with fewer than 50 words,
or more than half of its words in repeated windows.

The further rules form a cascade: a document meets the next rule only if it passed those before. Each rule's cost (seconds of a
run over a sample) and its rejection rate there are measured, and rules are run in falling order of rejections per cost. The order
changes the time, never the verdict: a document is kept if it passes all rules. The sample has at most ``sample_rows`` documents,
those with the smallest hash of their id.

The windows of a text are sorted by their 64-bit hash and place inside the row, so a text of n words costs n log n and needs no
shuffle; every document is worked on by itself, whatever its source. Two different windows of one text share a hash with probability
2^-64 times the pairs of windows.

Null text: no words, fails. Repeated rows give equal results. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 1000
#: Times that a rule is run over each row of the sample.
REPEATS = 10
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"


class Rule(NamedTuple):
    name: str
    fails: Callable[[], Column]


def value_of(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of x, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def word_array(text: Column) -> Column:
    """Words; only the ends of a text could give empty ones, so they are trimmed."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    return value_of(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def window_hashes(words: Column) -> Column:
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                       lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def neighbours(ordered_: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """Flattened ``pair`` (an array or null) of each two neighbours."""
    later = F.slice(ordered_, F.lit(2), F.greatest(F.size(ordered_) - 1, F.lit(0)))
    found = F.zip_with(F.slice(ordered_, F.lit(1), F.greatest(F.size(ordered_) - 1, F.lit(0))), later, pair)
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def repeated_windows(words: Column) -> Column:
    """First positions of 3-word windows that occur at least twice: windows sorted by hash and place, equal neighbours kept."""
    def of(h: Column) -> Column:
        keyed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return value_of(F.sort_array(keyed), lambda s: neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))

    return value_of(words, lambda w: value_of(window_hashes(w), of))


def repeated_words(words: Column) -> Column:
    """Words in such windows, each place counted once."""
    return F.size(F.array_distinct(F.flatten(F.transform(repeated_windows(words), lambda i: F.array(i, i + 1, i + 2)))))


def measured(docs: DataFrame, text: str, ids: str) -> DataFrame:
    """doc_id, text, and the base measures."""
    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text")))
    return rows.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"))


def base_failed(min_words: int, percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def default_rules() -> tuple[Rule, ...]:
    """Rules of published filters of web text: what they reject is not prose. Each is true where the document fails."""
    text, words = F.col("text"), F.col("n_words")

    def lines() -> Column:
        return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""))

    def letters() -> Column:
        return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))

    return (
        Rule("mean_word_length", lambda: (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 14 * words)),
        Rule("symbols", lambda: 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", lambda: 10 * F.col("n_dup_lines") > 5 * lines()),
        Rule("letters", lambda: 10 * letters() < 6 * F.col("word_chars")),
        Rule("capitals", lambda: 10 * F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) > 6 * F.col("word_chars")),
        Rule("exclamations", lambda: 10 * F.regexp_count(text, F.lit("[!?]")) > 3 * words),
        Rule("ellipses", lambda: 10 * F.size(F.filter(F.split(text, "\n", -1), lambda x: F.rtrim(x).endswith("..."))) > 3 * lines()),
    )


def ordered(table: DataFrame, rules: tuple[Rule, ...], repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """Rules with their rejection rate and cost on the sample, most rejections per cost first.

    A cost is the time of a rule over the sample's rows, each ``repeats`` times, less the time of a job that reads them and does nothing.
    """
    sample = table.cache()
    try:
        many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def timed(value: Column) -> tuple[float, int]:
            start = time.perf_counter()
            found = many.select(F.sum(value)).first()[0] or 0
            return time.perf_counter() - start, found

        total = sample.count() * repeats
        timed(F.length("text"))  # warm
        idle, _ = timed(F.length("text"))
        found = []
        for rule in rules:
            seconds, rejected = timed(rule.fails().cast("int"))
            found.append((rule, rejected / total if total else 0.0, max(seconds - idle, 1e-4)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda r: (-r[1] / r[2], r[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; a branch is evaluated only when those before it passed."""
    out = F.when(rules[0].fails(), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.fails(), rule.name)
    return out


def judge(docs: DataFrame, text: str = "text", ids: str = "doc_id", rules: tuple[Rule, ...] | None = None, min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row: doc_id, n_words, the base measures, base_failed, kept, rejected_by."""
    rules = default_rules() if rules is None else rules
    place = F.xxhash64(F.col(ids).cast("long"))
    last = docs.select(place.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    # Only hashes are sorted. Rows of one id share a hash, so a limit follows; which of them it takes only touches the order.
    small = docs.select(ids, text).where(place <= F.lit(last)).limit(sample_rows)
    passing = measured(small, text, ids).where(~base_failed(min_words, max_repeat_percent))  # the cascade sees no others
    order = [r for r, _, _ in ordered(passing, rules)]
    table = measured(docs, text, ids).withColumn("base_failed", base_failed(min_words, max_repeat_percent))
    rejected = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)) if order else F.when(F.col("base_failed"), F.lit("base"))
    return (table.withColumn("rejected_by", rejected)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.col("rejected_by").isNull().alias("kept"), "rejected_by"))
