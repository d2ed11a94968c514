"""The engine's tools: search of works and passages, context, lookup, statistics."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.text import excerpt, rerank_text
from scholia.operators import search as S
from scholia.operators.index import Index
from scholia.operators.rerank import Scorer, lexical_scorer, rerank
from scholia.sources import readers, sinks

MOST_RESULTS, MOST_CONTEXT = 50, 5
DEPTH = 100


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


@dataclass
class Corpus:
    """A collection: an index of works, one of passages, optionally an allowlist (one column of article keys). Calls never leave it."""

    spark: SparkSession
    name: str
    works: Index
    passages: Index | None = None
    allowed: DataFrame | None = None
    prior: float = 2.0
    exclude_types: tuple[str, ...] = ("peer-review", "dataset", "paratext")
    digits: int | None = 9
    scorer: Callable[[], Scorer] = field(default=lambda: lexical_scorer)

    def __post_init__(self) -> None:
        if self.allowed is not None and self.allowed.isEmpty():
            raise ValueError("an allowlist must hold an id at least")

    def _query(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([("q", text)], "query_id string, query_text string")

    def search_works(self, query: str = "", limit: int = 10, author: str | None = None, journal: str | None = None, sort: str = S.RELEVANCE, year_min: int | None = None, year_max: int | None = None, fast: bool = False) -> DataFrame:
        """Ranked works: BM25 over fields, one row per article, reranked unless fast or sorted, one row per title."""
        if not (query.strip() or author or journal):
            raise ValueError("give a query, an author or a journal")
        if sort not in (S.RELEVANCE, S.CITATIONS, S.YEAR):
            raise ValueError(f"unknown sort: {sort}")
        limit = clamp(limit, 1, MOST_RESULTS)
        filters = S.Filters(year_min, year_max, exclude_types=self.exclude_types, author=author, journal=journal)
        again = bool(query.strip()) and sort == S.RELEVANCE and not fast
        depth = max(limit, DEPTH) if again else 4 * limit
        if query.strip():
            found = S.ranked(self.works, self._query(query), filters, self.allowed, self.prior if sort == S.RELEVANCE else 0.0, digits=self.digits)
        else:
            found = S.browse(self.works, 1 << 30, filters, self.allowed, sort, "q")
        # one row per article before the cut, so that no article of the first ones is lost
        best = S.collapse(found, depth, sort)
        stage = "bm25" if sort == S.RELEVANCE else f"sorted:{sort}"
        if again:
            c = F.col
            bodies = self.works.docs.select("id", rerank_text(c("title"), c("authors"), c("journal"), c("institutions"), c("doi"), c("topics"), c("body")).alias("text_of"))
            best, stage = rerank(best.join(bodies, "id"), self._query(query), F.col("text_of"), depth, self.prior, self.scorer, self.digits).drop("text_of"), "bm25+rerank"
        return S.dedup_titles(best).where(F.col("rank") <= limit).withColumn("stage", F.lit(stage))

    def search_passages(self, query: str, limit: int = 10, section: str | None = None, year_min: int | None = None, year_max: int | None = None, include_retracted: bool = True, per_article: int = 2, fast: bool = False) -> DataFrame:
        """Ranked passages, at most per_article of an article; no citation prior, no type filter."""
        if not query.strip():
            raise ValueError("give a query")
        limit = clamp(limit, 1, MOST_RESULTS)
        filters = S.Filters(year_min, year_max, section, include_retracted)
        found = S.search(self.passages, self._query(query), max(limit, DEPTH), filters, self.allowed, digits=self.digits)
        if not fast:
            bodies = self.passages.docs.select("id", F.concat_ws(". ", "title", "body").alias("text_of"))
            found = rerank(found.join(bodies, "id"), self._query(query), F.col("text_of"), max(limit, DEPTH), 0.0, self.scorer, self.digits).drop("text_of")
        return S.cap_per_article(found, per_article).where(F.col("rank") <= limit).withColumn("stage", F.lit("bm25" if fast else "bm25+rerank"))

    def context(self, passage_id: str, before: int = 1, after: int = 1) -> DataFrame:
        """A passage with its neighbours, in order; fewer at the ends of an article."""
        before, after = clamp(before, 0, MOST_CONTEXT), clamp(after, 0, MOST_CONTEXT)
        key, _, place = passage_id.rpartition("#")
        if not key or not place.isdigit():
            raise ValueError("no passage id")
        ids = [f"{key}#{i:04d}" for i in range(max(0, int(place) - before), int(place) + after + 1)]
        return self.passages.docs.where(F.col("id").isin(ids)).orderBy("id").withColumn("stage", F.lit("context"))

    def paper(self, key: str) -> DataFrame:
        """One work by key, if it belongs to the collection."""
        return S.matching(self.works, S.Filters(), self.allowed).where(F.col("article_key") == key).limit(1).withColumn("stage", F.lit("lookup"))

    def stats(self) -> DataFrame:
        """Works, passages, articles with passages, and their share in percent."""
        works = S.matching(self.works, S.Filters(), self.allowed).agg(F.count("*").alias("works"))
        if self.passages is None:
            return works
        own = self.passages.docs.agg(F.count("*").alias("passages"), F.count_distinct("article_key").alias("articles"))
        row = works.first().works
        return own.select(F.lit(row).alias("works"), "passages", "articles", F.round(100 * F.col("articles") / F.lit(max(row, 1)), 1).alias("coverage_percent"))


@dataclass
class Registry:
    """Named collections. Every call names one, and nothing reads across them."""

    members: dict[str, Corpus]

    def __getitem__(self, name: str) -> Corpus:
        if name not in self.members:
            raise KeyError(f"no collection {name!r}; there are: {', '.join(sorted(self.members))}")
        return self.members[name]


def prepared(spark: SparkSession, collection: readers.Collection, root: str) -> dict:
    """What was published for a collection; it must have been made from what the configuration names now."""
    state = json.loads(sinks.read_text(spark, f"{root}/{collection.name}/current.json") or "null")
    if not state:
        raise FileNotFoundError(f"{collection.name} has not been prepared")
    if set(state) != {"name", "path", "generation"} or state["name"] != collection.name or state["path"] != collection.path:
        raise ValueError(f"the configuration of {collection.name} has changed: prepare it again")
    return state


def prepare(spark: SparkSession, collection: readers.Collection, root: str, works: Index, passages: Index | None = None) -> bool:
    """Save a collection's indexes as a new generation and point to it; False if that generation is there and current. The pointer moves last, so a failure leaves the last good one."""
    content = sinks.cache_path("", {"name": collection.name, "path": collection.path, "stats": [tuple(r) for r in works.fields.orderBy("field").collect()]}).strip("/")
    place = f"{root}/{collection.name}/{content}"
    pointer = f"{root}/{collection.name}/current.json"
    state = json.dumps({"name": collection.name, "path": collection.path, "generation": content}, sort_keys=True)
    if sinks.read_text(spark, pointer) == state and sinks.exists(spark, f"{place}/ingest-report.json"):
        return False
    works.save(f"{place}/works")
    if passages is not None:
        passages.save(f"{place}/passages")
    sinks.mark_complete(spark, place, {"passages": passages is not None})
    sinks.write_text(spark, pointer, state)
    return True


def serve(spark: SparkSession, collections: list[readers.Collection], root: str, stemmed: bool = True) -> Registry:
    """All collections of a configuration from their published generations; one that is not prepared, or was from other input, is an error."""
    out = {}
    for c in collections:
        place = sinks.require_complete(spark, f"{root}/{c.name}/{prepared(spark, c, root)['generation']}")
        load = lambda part: Index.load(spark, f"{place}/{part}", stemmed)  # noqa: B023, E731
        out[c.name] = Corpus(spark, c.name, load("works"), load("passages") if sinks.exists(spark, f"{place}/passages") else None)
    return Registry(out)


def neighbours(passages: DataFrame, wanted: DataFrame, before: int, after: int) -> DataFrame:
    """Neighbours of many passages at once: (article_key, place) pairs become equi-join keys."""
    near = wanted.select("article_key", F.col("chunk_index").alias("of_index"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - before), F.col("chunk_index") + after)).alias("chunk_index"))
    return near.join(passages, ["article_key", "chunk_index"])


def render(results: DataFrame, text: Column, limit: int = 400) -> DataFrame:
    """One JSON object per row: nulls for blanks, scores to three digits, half to even, text as an excerpt."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return results.select("query_id", "rank", F.to_json(F.struct("article_key", blank("title").alias("title"), "year", F.bround("score", 3).alias("score"), excerpt(text, limit).alias("text")), {"ignoreNullFields": "false"}).alias("json"))
