"""Quality rules: a threshold table compiled into one projection, without user functions.

The counts are higher-order functions over a document's own words and lines, so nothing is
shuffled. Repeated words are those in 5-word windows found twice or more: the windows' hashes
are sorted together with their places, equal neighbours give the repeated places, and the
words they cover are summed place by place. The sort is left out where all windows differ.

Edge cases: a null or blank text has no words and fails the base rule; texts of fewer than
5 words have no window; a text of any length is counted whole, its words in one row's memory; a
count that is exactly at a threshold passes; repeated rows each get their row; a column of the
table that has a name of this module's is kept by ``keep`` and ignored by ``measure``; an empty
table gives none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "er", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "se", "su", "una", "y",
)


class Rule(NamedTuple):
    """Keep a text only if low <= 1000 * count <= high * base holds in thousandths; a text with fewer than ``words`` words is not judged by it."""

    name: str
    count: str
    base: str
    low: int
    high: int
    words: int = 0


#: Ratios in thousandths; None would be no bound, so bounds that never bind are 0 and a billion.
RULES = (
    Rule("symbols to words", "n_symbols", "n_words", 0, 250),
    Rule("mean word length", "word_chars", "n_words", 2000, 15000),
    Rule("upper case to characters", "n_upper", "word_chars", 0, 300),
    Rule("stop words to words", "n_stop", "n_words", 20, 1_000_000_000, 50),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", 0, 400),
)

#: Blanks, symbols and capital letters, as classes of patterns. ``translate`` would make an object of every character.
_BLANK, _SYMBOL, _CAPITAL = r"[ \t-\r]", r"[#*$%&|<>]", "[A-ZÀ-ÖØ-Þ]"


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The threshold table as one boolean SQL expression over the counts."""
    return " AND ".join(f"(n_words < {r.words} OR (1000 * {r.count} >= {r.low} * {r.base} AND 1000 * {r.count} <= {r.high} * {r.base}))" for r in rules)


def _windows(hashes: Column, n_windows: Column) -> Column:
    """A hash of each 5 consecutive words, from the words' own."""
    return F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(*(F.element_at(hashes, (i + k).cast("int")) for k in range(5))))


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base_failed and kept for each row of (doc_id, text)."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t_"))
    d = d.select(
        "doc_id",
        "t_",
        F.filter(F.split("t_", _BLANK + "+"), lambda x: x != "").alias("w_"),
        F.filter(F.split("t_", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))).alias("l_"),
    )
    d = d.withColumn("n_words", F.size("w_").cast("long"))
    d = d.withColumn("x_", F.transform("w_", lambda x: F.xxhash64(x)))
    d = d.withColumn("h_", F.when(F.col("n_words") >= 5, _windows(F.col("x_"), (F.col("n_words") - 4).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.zip_with("h_", F.sequence(F.lit(0), F.size("h_") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("s_", F.when(F.size(F.array_distinct("h_")) < F.size("h_"), pairs))
    # repeated windows' places in order, then the words each adds to those before it
    same = F.filter(
        F.transform(F.col("s_"), lambda x, i: F.when((x["h"] == F.try_element_at("s_", i + 2)["h"]) | ((i > 0) & (x["h"] == F.try_element_at("s_", F.when(i > 0, i).otherwise(-1))["h"])), x["i"])),
        lambda x: x.isNotNull(),
    )
    d = d.withColumn("p_", F.when(F.col("s_").isNotNull(), F.sort_array(same)))
    covered = F.aggregate("p_", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    d = d.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("w_", "")).cast("long").alias("word_chars"),
        F.regexp_count("t_", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("l_").cast("long").alias("n_lines"),
        # stop words are of ASCII letters whose other lower-case origins (the Kelvin sign) stand in none of them
        F.size(F.filter("w_", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.regexp_count("t_", F.lit(_CAPITAL)).cast("long").alias("n_upper"),
    )
    d = d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    d = d.withColumn("kept", F.expr(f"NOT base_failed AND {rules_sql(rules)}"))
    # a filter on these columns stays above a generator; else it would be pushed down below the
    # projections, with the counts' expressions copied into it many times over
    return d.select(F.explode(F.array(F.struct(*d.columns))).alias("row_")).select("row_.*")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")
    return measure(whole, rules).where("kept").select(*(F.col("doc_id").getField(c).alias(c) for c in docs.columns))
