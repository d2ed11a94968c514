"""Retrieval metrics and report statistics as plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import scoring
from scholia.functions.text import blank_to_null, normalise_doi


def nearest_ranks(rows: DataFrame, groups: list[str], value: str, places: dict[str, float]) -> DataFrame:
    """For each group and each name of places, the value at place floor(n * p) of the sorted values: no interpolation. Equal values are counted before they are ordered, and the running sum holds one row at a time."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n_"))
    totals = counts.groupBy(*groups).agg(F.sum("n_").alias("all_"))
    counts = counts.join(totals, groups)
    upto = F.sum("n_").over(Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("upto_", upto)
    return counts.groupBy(*groups).agg(*(F.min(F.when(F.col("upto_") > F.floor(F.col("all_") * p), F.col(value))).alias(name) for name, p in places.items()))


def pool(runs: DataFrame, depth: int) -> DataFrame:
    """(query_id, hit) pairs of the first depth hits of any system, in first-seen order; runs: system, query_id, rank, hit."""
    return runs.where(F.col("rank") <= depth).groupBy("query_id", "hit").agg(F.min(F.struct("rank", "system")).alias("first")).select("query_id", "hit", "first.*")


def judged(runs: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """Metrics of each system and query: nDCG at k against the pooled ideal, mean grade, useful share, hit at 1 and k, reciprocal rank; grades: query_id, hit, grade. Queries without a grade are left out."""
    ideal = grades.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "hit"))).where(F.col("place") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(scoring.gain(F.col("grade"), F.col("place"))).alias("ideal"))
    hits = runs.where(F.col("rank") <= k).join(grades, ["query_id", "hit"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    per = hits.groupBy("system", "query_id").agg(
        F.sum(scoring.gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        F.avg("grade").alias("mean_grade"),
        F.avg((F.col("grade") >= 2).cast("double")).alias("useful"),
        F.max(((F.col("grade") >= 2) & (F.col("rank") == 1)).cast("double")).alias("hit_1"),
        F.max((F.col("grade") >= 2).cast("double")).alias("hit_k"),
        F.coalesce(F.max(F.when(F.col("grade") >= 2, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    return per.join(ideal, "query_id").withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0))


def by_system(per_query: DataFrame) -> DataFrame:
    """Means over queries."""
    return per_query.groupBy("system").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in ("ndcg", "mean_grade", "useful", "hit_1", "hit_k", "rr")))


def known_item(ranks: DataFrame) -> DataFrame:
    """Hit rates and mean reciprocal rank of (system, query_id, rank; null: not found)."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}")
    return ranks.groupBy("system").agg(F.count("*").alias("queries"), hit(1), hit(3), hit(10), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def token_report(lengths: DataFrame, length: str, caps: tuple[int, ...] = (128, 192, 256, 384, 512)) -> DataFrame:
    """Length statistics, and for each cap the share of compute and of texts cut: one row."""
    c = F.col(length)
    total = F.sum(c)
    parts = [F.avg(c).alias("mean"), F.max(c).alias("longest")]
    for cap in caps:
        parts += [(F.sum(F.least(c, F.lit(cap))) / total).alias(f"compute_{cap}"), F.avg((c > cap).cast("double")).alias(f"cut_{cap}")]
    whole = lengths.withColumn("all_rows_", F.lit(1))
    ranks = nearest_ranks(whole, ["all_rows_"], length, {f"p{p}": p / 100 for p in (50, 90, 95, 99)})
    return whole.groupBy("all_rows_").agg(*parts).join(ranks, "all_rows_").drop("all_rows_")


def missing_share(rows: DataFrame, group: str, column: Column) -> DataFrame:
    """Share of rows of each group whose column is null or blank."""
    missing = (column.isNull() | (F.trim(column.cast("string")) == "")).cast("double")
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.avg(missing).alias("missing"))


def intersect_queries(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Ids that every system and the question set have."""
    systems = runs.select("system").distinct().count()
    shared = runs.groupBy("query_id").agg(F.count_distinct("system").alias("n")).where(F.col("n") == systems).select("query_id")
    return shared.join(questions.select("query_id"), "query_id", "left_semi")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows on any cluster."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def rank_of(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank) of the expected DOI among results (query_id, rank, doi); null where it does not appear. DOIs are compared in canonical form."""
    want = expected.select("query_id", normalise_doi(F.col("expect_doi")).alias("doi_"))
    hits = results.select("query_id", "rank", normalise_doi(F.col("doi")).alias("doi_"))
    return want.join(hits, ["query_id", "doi_"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))


def judge_text(title: Column, meta: list[Column], bodies: list[Column]) -> Column:
    """What a judge reads of a hit: the title, what identifies it in one line, and the first body that is not blank."""
    filled = lambda c: blank_to_null(c.cast("string"))
    line = F.concat_ws(" | ", *map(filled, meta))
    return F.concat_ws("\n", filled(title), F.when(line != "", line), F.coalesce(*map(filled, bodies)))


def pooled_texts(pooled: DataFrame, runs: DataFrame, articles: DataFrame, most: int = 2000) -> DataFrame:
    """A text for each pooled (query_id, hit): that which a run showed (the first system's by name), else title and abstract of the article, else null. runs: system, hit, text; articles: openalex_id, title, abstract."""
    shown = runs.where(blank_to_null(F.col("text")).isNotNull()).groupBy("hit").agg(F.min_by("text", F.struct("system", "text")).alias("shown_"))
    stored = articles.select(F.col("openalex_id").alias("hit"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.substring(F.coalesce("abstract", F.lit("")), 1, most)).alias("stored_"))
    return pooled.join(shown, "hit", "left").join(stored, "hit", "left").select("query_id", "hit", F.coalesce("shown_", "stored_").alias("text"))


def titles_agree(a: Column, b: Column) -> Column:
    """Whether two titles agree in their first 40 letters and digits; null if one is missing."""
    first = lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), 1, 40)
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), first(a) == first(b))


def cohort(rows: DataFrame, has_abstract: bool, where: str | None = None) -> DataFrame:
    """Rows with (or without) an abstract, that pass a predicate of the user's."""
    filled = F.trim(F.coalesce("abstract", F.lit(""))) != ""
    out = rows.where(filled if has_abstract else ~filled)
    return out.where(F.expr(where)) if where else out


def cohort_summary(records: DataFrame) -> DataFrame:
    """What a second source adds, by cohort: rates over all rows say what a merge would bring, those over the rows that resolve say whether the join is right. records: cohort, doi, found, abstract, pdf, title, other_title."""
    c = F.col
    resolves = F.coalesce(c("doi"), F.lit("")) != ""
    found = resolves & F.coalesce(c("found"), F.lit(False))
    filled = found & (F.trim(F.coalesce(c("abstract"), F.lit(""))) != "")
    pdf = found & (F.coalesce(c("pdf"), F.lit("")) != "")
    agree = F.when(found, titles_agree(c("title"), c("other_title")))
    n = records.groupBy("cohort").agg(F.count("*").alias("sampled"), F.count_if(resolves).alias("with_doi"), F.count_if(found).alias("found"), F.count_if(filled).alias("with_abstract"), F.count_if(pdf).alias("with_pdf"), F.avg(agree.cast("double")).alias("title_agreement"))
    rate = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return n.select("*", rate("with_doi", "sampled").alias("doi_rate"), rate("with_abstract", "sampled").alias("abstract_rate"), rate("with_pdf", "sampled").alias("pdf_rate"), rate("found", "with_doi").alias("found_of_resolvable"), rate("with_abstract", "found").alias("abstract_of_found"))


def filtered_sample(rows: DataFrame, where: str, key: str, n: int, seed: int) -> DataFrame:
    """n of the rows that pass: the filter comes before the sample."""
    return seeded_sample(rows.where(F.expr(where)), key, n, seed)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows with their place in a seeded order, the same on any cluster."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)) - 1)


def side_by_side(runs: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """One row per query and rank with each system's hit, those of the gold set marked by a star. runs: system, query_id, rank, hit; gold: query_id, hit."""
    marked = runs.where(F.col("rank") <= depth).join(gold.select("query_id", "hit").distinct().withColumn("gold_", F.lit("*")), ["query_id", "hit"], "left")
    cell = F.concat(F.coalesce("gold_", F.lit(" ")), "hit")
    return marked.withColumn("cell_", cell).groupBy("query_id", "rank").pivot("system").agg(F.min("cell_"))
