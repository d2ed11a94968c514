"""Ranked search over an index: one query or a batch, as one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from scholia.functions import scoring
from scholia.functions.analysis import analyze, analyze_column, plain_tokens
from scholia.operators import batch
from scholia.operators.index import Index

RELEVANCE, CITATIONS, YEAR = "relevance", "citations", "year"
MOST_NAMES = 10


@dataclass
class Filters:
    """What a hit must be. Filters do not score, and statistics stay those of the whole corpus."""

    year_min: int | None = None
    year_max: int | None = None
    section: str | None = None
    include_retracted: bool = True
    exclude_types: tuple[str, ...] = field(default=())
    author: str | None = None
    journal: str | None = None


def parse_names(value: str, allow_all: bool = True) -> tuple[list[str], bool]:
    """Names of ``A AND B``, ``A OR B`` or ``A; B``, and whether all are required."""
    has_and, has_or = " AND " in value, " OR " in value or ";" in value
    if has_and and has_or:
        raise ValueError("AND and OR can't be mixed")
    if has_and and not allow_all:
        raise ValueError("a work has one journal: use OR")
    names = [n.strip() for n in re.split(r" AND | OR |;", value) if n.strip()]
    if not names:
        raise ValueError("no name given")
    if len(names) > MOST_NAMES:
        raise ValueError(f"at most {MOST_NAMES} names")
    return names, has_and


def phrase_match(tokens: Column, words: list[str], slop: int) -> Column:
    """Whether an analysed token array holds the words in order, or with slop 2 with their places moved by two in all (two neighbours may swap)."""
    n = F.size(tokens)
    if len(words) == 1:
        return F.array_contains(tokens, words[0])
    shifts = _shifts(len(words), slop)
    hit = lambda i: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.coalesce(F.try_element_at(tokens, F.when(i + o > 0, i + o).otherwise(2**31 - 1).cast("int")) == w, F.lit(False)) for w, o in zip(words, s))) for s in shifts))
    return F.when(n == 0, False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), hit))


def _shifts(n: int, slop: int) -> list[tuple[int, ...]]:
    """Offsets of the words from the first, whose displacements from their order span at most slop."""
    out: list[tuple[int, ...]] = []

    def grow(made: tuple[int, ...]) -> None:
        if len(made) == n:
            out.append(made)
            return
        k = len(made)
        moved = [p - i for i, p in enumerate(made)]
        for d in range(-slop, slop + 1):
            if k + d not in made and max([*moved, d]) - min([*moved, d]) <= slop:
                grow((*made, k + d))

    grow((0,))
    return out


def phrase_in(tokens: list[str], words: list[str], slop: int) -> bool:
    """The worker-side twin of phrase_match."""
    n = len(tokens)
    return any(all(0 <= i + o < n and tokens[i + o] == w for w, o in zip(words, s)) for s in _shifts(len(words), slop) for i in range(n))


def _name_test(index: Index, column: Column, name: str, slop: int) -> Column:
    words = analyze(name) if index.stemmed else re.findall("[a-z0-9]+", name.lower())
    if not words:  # a name of stop words only is looked up as it is
        return F.contains(F.lower(column), F.lit(name.lower()))
    if not index.stemmed:
        return phrase_match(plain_tokens(column), words, slop)

    def test(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: phrase_in(analyze(t), words, slop))

    return F.pandas_udf(test, BooleanType())(column)


def _names(column: Column, index: Index, value: str, slop: int, allow_all: bool) -> Column:
    names, every = parse_names(value, allow_all)
    return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [_name_test(index, column, n, slop) for n in names])


def matching(index: Index, f: Filters, allowed: DataFrame | None = None) -> DataFrame:
    """Documents that pass the filters; allowed: ids, which are joined on."""
    docs = index.docs
    if f.year_min is not None or f.year_max is not None:  # an unknown year is outside any bound
        docs = docs.where(F.col("year").isNotNull() & (F.col("year") > 0))
        docs = docs.where(F.col("year") >= f.year_min) if f.year_min is not None else docs
        docs = docs.where(F.col("year") <= f.year_max) if f.year_max is not None else docs
    if f.section:
        docs = docs.where(F.lower("section") == f.section.lower())
    if not f.include_retracted:
        docs = docs.where(~F.coalesce("is_retracted", F.lit(False)))
    if f.exclude_types:
        docs = docs.where(~F.coalesce(F.lower("work_type").isin([t.lower() for t in f.exclude_types]), F.lit(False)))
    if f.author:
        docs = docs.where(_names(F.coalesce("authors", F.lit("")), index, f.author, 2, True))
    if f.journal:
        docs = docs.where(_names(F.concat_ws(". ", "journal", "publisher"), index, f.journal, 0, False))
    if allowed is not None:
        docs = docs.join(allowed.select(F.col(allowed.columns[0]).alias("article_key")).distinct(), "article_key", "left_semi")
    return docs


def query_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, place, term) of queries (query_id, query_text); a repeated word counts again."""
    tokens = (analyze_column if index.stemmed else plain_tokens)(F.col("query_text"))
    return queries.select("query_id", F.posexplode(tokens).alias("place", "term"))


def breakdown(index: Index, queries: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """Every query term's boosted score in every field of every document that has it: what a score is made of."""
    boosts = boosts or scoring.FIELD_BOOSTS
    boost = F.coalesce(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))[F.col("field")], F.lit(0.0))
    return index.lookup(query_terms(index, queries)).select("query_id", "place", "term", "field", "id", "tf", (boost * F.col("weight")).alias("score"))


def scores(parts: DataFrame) -> DataFrame:
    """(query_id, id, score): the best field of each query term with a tenth of the others, summed."""
    best = parts.groupBy("query_id", "id", "place").agg(F.max("score").alias("best"), F.sum("score").alias("total"))
    return best.groupBy("query_id", "id").agg(F.sum(scoring.dismax(F.col("best"), F.col("total"))).alias("score"))


def _stored(docs: DataFrame) -> DataFrame:
    return docs.select("id", "article_key", "title", "year", F.coalesce("citations", F.lit(0)).alias("citations"))


def ranked(index: Index, queries: DataFrame, filters: Filters | None = None, allowed: DataFrame | None = None, prior: float = 0.0, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """All documents that a query finds, scored, without rank. Filters come before scoring. digits: scores are rounded so, and those that differ only by the order of addition are ties."""
    parts = breakdown(index, queries, boosts)
    docs = matching(index, filters or Filters(), allowed)
    if docs is not index.docs:
        parts = parts.join(docs.select("id"), "id", "left_semi")
    out = scores(parts).join(_stored(index.docs), "id")
    if prior:
        out = out.withColumn("score", scoring.citation_boost(F.col("score"), F.col("citations"), prior))
    return out.withColumn("score", F.round("score", digits)) if digits is not None else out


def search(index: Index, queries: DataFrame, k: int, filters: Filters | None = None, allowed: DataFrame | None = None, sort: str = RELEVANCE, prior: float = 0.0, boosts: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """The k best documents of each query, with rank. A blank query finds nothing here: see browse(). digits: by scores that are rounded so; sorted by relevance without a prior, the scores themselves are returned whole."""
    if sort == RELEVANCE and not prior:  # the scores alone decide: stored columns are read for what is left
        docs = matching(index, filters or Filters(), allowed)
        found = batch.best(index, docs, query_terms(index, queries).select("query_id", "term"), k, boosts or scoring.FIELD_BOOSTS, digits)
        if found is None:
            parts = breakdown(index, queries, boosts)
            if docs is not index.docs:
                parts = parts.join(docs.select("id"), "id", "left_semi")
            found = scores(parts)
        found = found.select("query_id", "id", (F.round("score", digits) if digits is not None else F.col("score")).alias("score"), F.col("score").alias("whole_"))
        return top(found, k).withColumn("score", F.col("whole_")).drop("whole_").join(_stored(index.docs), "id")
    return top(ranked(index, queries, filters, allowed, prior if sort == RELEVANCE else 0.0, boosts, digits), k, sort)


def browse(index: Index, k: int, filters: Filters, allowed: DataFrame | None = None, sort: str = RELEVANCE, query_id: str = "") -> DataFrame:
    """The first k documents that pass the filters, when there is nothing to score."""
    docs = matching(index, filters, allowed)
    return top(_stored(docs).select(F.lit(query_id).alias("query_id"), "*", F.lit(1.0).alias("score")), k, sort)


def _order(sort: str) -> list[Column]:
    first = {RELEVANCE: F.desc("score"), CITATIONS: F.desc_nulls_last("citations"), YEAR: F.desc_nulls_last("year")}[sort]
    return [first, F.desc("score"), F.asc("id")]


def top(ranked: DataFrame, k: int, sort: str = RELEVANCE) -> DataFrame:
    """The k best rows of each query; ties by id."""
    w = Window.partitionBy("query_id").orderBy(*_order(sort))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def collapse(ranked: DataFrame, k: int, sort: str = RELEVANCE) -> DataFrame:
    """The best passage of each article, then the k best articles; grouping comes first, so no over-fetch is needed. The requested order is kept."""
    w = Window.partitionBy("query_id", "article_key").orderBy(F.desc("score"), "id")
    return top(ranked.drop("rank").withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_"), k, sort)


def cap_per_article(ranked: DataFrame, cap: int = 2) -> DataFrame:
    """At most cap passages of an article, in order of rank."""
    w = Window.partitionBy("query_id", "article_key").orderBy("rank")
    kept = ranked.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= max(1, cap)).drop("r_")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank"))))


def dedup_titles(ranked: DataFrame) -> DataFrame:
    """One row per title: the most cited (then first ranked) one, with its own score, in the place of the group's first; rows without title count by article, and an article comes once."""
    from scholia.functions.text import title_key

    keyed = ranked.withColumn("key_", F.when(title_key(F.col("title")) != "", F.concat(F.lit("t:"), title_key(F.col("title")))).otherwise(F.concat(F.lit("a:"), "article_key")))
    row = F.struct(*[c for c in ranked.columns if c not in ("query_id", "rank")])
    won = keyed.groupBy("query_id", "key_").agg(F.min("rank").alias("rank"), F.max_by(row, F.struct(F.coalesce("citations", F.lit(0)), -F.col("rank"))).alias("w"))
    flat = won.select("query_id", "rank", "w.*")
    once = flat.withColumn("r_", F.row_number().over(Window.partitionBy("query_id", "article_key").orderBy("rank"))).where("r_ = 1").drop("r_")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
