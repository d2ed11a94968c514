"""Registered queries that run the engine's tools, readers and corrections as a whole, with their SQL.

Roles of the tables: documents are works, conversations passages, orders records with a date,
customers papers of a store, parts titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import embedding, evaluation, index, repair, rerank, retrieval, search
from scholia.operators import relational as R
from scholia.plans.catalog import _FIELDS, _KEY, _QT_PLACES, _R, QUERY, TOKENS, corpus, read
from scholia.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ASKED = QUERY + " en src1"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _blank(*names: str) -> dict[str, Column]:
    return {n: F.lit(None).cast("string") for n in names}


def passages(spark: SparkSession, d: str) -> DataFrame:
    """conversations as passages: turns of one article, the role as the section."""
    c = read(spark, d, "conversations")
    chunks = c.select(F.concat("conv_id", F.lit("#"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), F.col("conv_id").cast("string").alias("article_key"), F.col("role").alias("section_kind"), "text", F.lit(None).cast("string").alias("title"), (2000 + F.col("conv_id") % 25).cast("int").alias("pub_year"), F.lit(False).alias("is_retracted"))
    return readers.chunk_articles(chunks)


def collection(spark: SparkSession, d: str) -> retrieval.Corpus:
    """Works and passages of the tables, without stems, so that SQL can say what is found."""
    return retrieval.Corpus(spark, "tables", index.build(corpus(spark, d), stemmed=False), index.build(passages(spark, d), stemmed=False), scorer=lambda: rerank.plain_scorer)


def _found(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "rank", "stage")


_DEDUP = f"""h AS (SELECT *, CASE WHEN tk <> '' THEN 't:' || tk ELSE 'a:' || article_key END AS key FROM l),
g AS (SELECT key, min(rank) AS rank, arg_max(struct_pack(doc_id := doc_id, score := score), struct_pack(c := n_chars, r := -rank)) AS w FROM h GROUP BY key)
SELECT w.doc_id AS doc_id, round(w.score, 6) AS score, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, '{{stage}}' AS stage FROM g QUALIFY row_number() OVER (ORDER BY rank) <= 10"""
_WORKS = rf"""WITH {_QT_PLACES}, {_FIELDS},
b AS (SELECT doc_id, {_KEY} AS article_key, lang, source, text, n_chars, 2000 + doc_id % 25 AS year, round(CASE WHEN n_chars > 0 THEN score * (1 + {{prior}} * least(1.0, log10(1 + n_chars) / 5.5)) ELSE score END, 9) AS score, lower(regexp_replace(trim(string_split(text, chr(10))[1]), '\.+$', '')) AS tk FROM sc JOIN documents USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY article_key ORDER BY score DESC, doc_id) AS m FROM b)"""


@query(_WORKS.format(prior="2.0") + ", l AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE m = 1 QUALIFY rank <= 40), " + _DEDUP.format(stage="bm25"))
def search_works(spark: SparkSession, d: str) -> DataFrame:
    """The work tool without its second stage: fields, prior, one row per article, one per title."""
    return _found(collection(spark, d).search_works(ASKED, 10, fast=True))


@query(_WORKS.format(prior="0.0") + ", l AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, score DESC, doc_id) AS rank FROM c WHERE m = 1 QUALIFY rank <= 40), " + _DEDUP.format(stage="sorted:citations"))
def search_works_by_citations(spark: SparkSession, d: str) -> DataFrame:
    """The work tool in order of citations."""
    return _found(collection(spark, d).search_works(ASKED, 10, sort=search.CITATIONS))


@query(_WORKS.format(prior="0.0") + ", l AS (SELECT *, row_number() OVER (ORDER BY year DESC, score DESC, doc_id) AS rank FROM c WHERE m = 1 AND year BETWEEN 2003 AND 2020 QUALIFY rank <= 40), " + _DEDUP.format(stage="sorted:year"))
def search_works_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The work tool in order of years, within a range. Scores of a year's works are compared only within an article, so the range may follow the collapse here: an article has one year."""
    return _found(collection(spark, d).search_works(ASKED, 10, sort=search.YEAR, year_min=2003, year_max=2020))


@query(_WORKS.format(prior="2.0") + f""", l0 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank0 FROM c WHERE m = 1 QUALIFY rank0 <= 100),
l1 AS (SELECT * EXCLUDE (score), len(list_intersect(list_distinct(regexp_extract_all(lower(lang || '. ' || source || '. ' || text), '[a-z0-9]+')), {sorted(set(ASKED.split()))})) / {float(len(set(ASKED.split())))} AS share FROM l0),
l2 AS (SELECT *, round(share + CASE WHEN n_chars > 0 THEN 2.0 * log10(1 + n_chars) ELSE 0 END, 9) AS score FROM l1),
l AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM l2), """ + _DEDUP.format(stage="bm25+rerank"))
def search_works_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The work tool with its second stage."""
    return _found(collection(spark, d).search_works(ASKED, 10))


@query(f"SELECT doc_id, 1.0 AS score, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank, 'bm25' AS stage FROM (SELECT min(doc_id) AS doc_id FROM documents WHERE lang = 'de' AND regexp_matches(coalesce(text, ''), '\\S') GROUP BY {_KEY}) QUALIFY row_number() OVER (ORDER BY doc_id) <= 10".replace("\\S", "\\S"))
def browse_author(spark: SparkSession, d: str) -> DataFrame:
    """Filters without a query: all that pass, scored alike, one row per article."""
    c = collection(spark, d)
    found = search.collapse(search.browse(c.works, 1 << 30, search.Filters(author="de"), query_id="q"), 10)
    return _found(found.withColumn("stage", F.lit("bm25")))


_PASSAGE = f"""WITH q0 AS (SELECT regexp_extract_all('{QUERY}', '[a-z0-9]+') AS w), qt AS (SELECT unnest(w) AS term, unnest(range(len(w))) AS place FROM q0),
p AS (SELECT conv_id, turn, role, text FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S')),
toks AS (SELECT conv_id, turn, unnest({TOKENS}) AS term FROM p), tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM toks GROUP BY ALL), dl AS (SELECT conv_id, turn, count(*) AS len FROM toks GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM p) AS mean), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT conv_id, turn, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (conv_id, turn), st GROUP BY ALL),
i AS (SELECT conv_id || '#' || lpad(CAST(turn AS VARCHAR), 4, '0') AS passage_id, conv_id, score FROM sc JOIN conversations USING (conv_id, turn) WHERE role = 'user' AND 2000 + conv_id % 25 >= 2005),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, passage_id) AS rank FROM i QUALIFY rank <= 100), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS m FROM r)
SELECT passage_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, 'bm25' AS stage FROM k WHERE m <= 2 QUALIFY row_number() OVER (ORDER BY rank) <= 10"""


@query(_PASSAGE)
def search_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passage tool: a section, a first year, two passages of an article at most."""
    found = collection(spark, d).search_passages(QUERY, 10, section="USER", year_min=2005, fast=True)
    return found.select(F.col("id").alias("passage_id"), F.round("score", 6).alias("score"), "rank", "stage")


@query("SELECT CAST(conv_id AS VARCHAR) || '#' || lpad(CAST(turn AS VARCHAR), 4, '0') AS passage_id, text, 'context' AS stage FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn BETWEEN 1 AND 4")
def passage_window(spark: SparkSession, d: str) -> DataFrame:
    """The context tool: a passage with its neighbours."""
    first = read(spark, d, "conversations").agg(F.min("conv_id")).first()[0]
    return collection(spark, d).context(f"{first}#0002", 1, 2).select(F.col("id").alias("passage_id"), F.col("body").alias("text"), "stage")


@query(f"WITH u AS (SELECT doc_id, {_KEY} AS article_key, source FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')) SELECT doc_id, article_key, source AS journal, 'lookup' AS stage FROM u WHERE article_key = (SELECT min(article_key) FROM (SELECT article_key FROM u GROUP BY article_key HAVING count(*) = 1))")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lookup tool, for the first key that one work alone has."""
    c = collection(spark, d)
    key = c.works.docs.groupBy("article_key").count().where("count = 1").agg(F.min("article_key")).first()[0]
    return c.paper(key or "").select(F.col("id").cast("long").alias("doc_id"), "article_key", "journal", "stage")


@query("SELECT (SELECT count(*) FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')) AS works, count(*) AS passages, count(DISTINCT conv_id) AS articles, round(100.0 * count(DISTINCT conv_id) / greatest((SELECT count(*) FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')), 1), 1) AS coverage_percent FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S')")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics tool."""
    return collection(spark, d).stats()


# --- readers and shapes

_META = "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0"


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").cast("string").alias("openalex_id"), F.when(k % 7 == 0, "10.1/x").alias("doi"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("title"), F.when(k % 5 > 1, F.concat(F.lit("abstract "), k.cast("string"))).when(k % 5 == 1, "  ").alias("abstract"), F.when(k % 6 > 0, F.year("o_orderdate")).alias("publication_year"), *(v.alias(n) for n, v in _blank("pmid", "pmcid", "primary_source_name", "work_type").items()), k.alias("cited_by_count"), F.lit(True).alias("is_oa"))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_custkey % 3 <> 0")
    return c.select(F.col("c_custkey").cast("string").alias("article_key"), F.col("c_mktsegment").alias("journal"), F.concat(F.lit("10.9/"), F.col("c_custkey").cast("string")).alias("doi"), F.col("c_name").alias("meta_title"), (1990 + F.col("c_nationkey")).cast("int").alias("pub_year"), F.col("c_name").alias("authors"), *(v.alias(n) for n, v in _blank("issn_electronic", "issn_print", "publisher", "keywords", "pmid", "pmcid").items()))


@query(f"""WITH m AS ({_META}), a AS (SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS k, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 5 > 1 THEN 'abstract ' || o_orderkey WHEN o_orderkey % 5 = 1 THEN '  ' END AS body, o_custkey, o_orderdate FROM orders)
SELECT id, k AS citations, coalesce(title, c_name) AS title, body, coalesce(CASE WHEN k % 7 = 0 THEN '10.1/x' END, CASE WHEN c_custkey IS NOT NULL THEN '10.9/' || c_custkey END) AS doi, c_mktsegment AS journal, coalesce(CASE WHEN k % 6 > 0 THEN CAST(year(o_orderdate) AS INTEGER) END, CAST(1990 + c_nationkey AS INTEGER)) AS year
FROM a LEFT JOIN m ON o_custkey = c_custkey WHERE k % 5 > 1 OR (c_custkey IS NOT NULL AND trim(coalesce(title, c_name)) <> '')""")
def abstract_articles(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of the abstract tier with their metadata."""
    return readers.abstract_articles(_abstracts(spark, d), _metadata(spark, d)).select("id", "citations", "title", "body", "doi", "journal", "year")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '' END AS title, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS body, lower(p_brand) AS work_type FROM part WHERE p_partkey % 3 > 0 OR p_partkey % 5 > 0")
def work_articles(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of works: a title or an abstract is needed."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    works = p.select(k.cast("string").alias("openalex_id"), F.when(k % 3 > 0, F.col("p_name")).when(k % 2 == 0, "").alias("title"), F.when(k % 5 > 0, F.col("p_type")).alias("abstract"), F.col("p_brand").alias("type"), F.lit(1999).alias("publication_year"), F.lit(3).alias("cited_by_count"), F.lit(False).alias("is_retracted"), *(v.alias(n) for n, v in _blank("doi", "pmid", "issn", "authors", "institutions", "journal", "topics", "keywords").items()))
    return readers.work_articles(works).select("id", "title", "body", "work_type")


@query(f"WITH m AS ({_META}) SELECT o_orderkey || '#0000' AS id, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS VARCHAR) END, o_orderkey || '#0000') AS article_key, c_name AS authors, c_mktsegment AS journal, lower(o_orderstatus) AS section FROM orders LEFT JOIN m ON CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END = c_custkey")
def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    """Index rows of passages with their article's metadata; one without article stands for itself."""
    o = read(spark, d, "orders")
    chunks = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("#0000")).alias("chunk_id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey").cast("string")).alias("article_key"), F.col("o_orderstatus").alias("section_kind"), F.col("o_orderpriority").alias("text"), F.lit(None).cast("string").alias("title"), F.lit(2000).alias("pub_year"), F.lit(False).alias("is_retracted"))
    return readers.chunk_articles(chunks, _metadata(spark, d)).select("id", "article_key", "authors", "journal", "section")


@query("SELECT CAST(o_custkey AS VARCHAR) AS article_key, max('p' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS source_path, arg_max(o_orderpriority, 'p' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS meta_title FROM orders WHERE o_custkey % 11 <> 0 GROUP BY o_custkey")
def article_metadata(spark: SparkSession, d: str) -> DataFrame:
    """One row of metadata per article key: the last path wins, rows without key are left out."""
    o = read(spark, d, "orders")
    rows = o.select(F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey").cast("string")).alias("article_key"), F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("source_path"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("pub_year"), F.lit(1).alias("pub_month"), F.lit(1).alias("pub_day"), *(v.alias(n) for n, v in _blank("pmcid", "pmid", "doi", "journal", "issn_electronic", "issn_print", "publisher", "article_type", "license_url", "authors", "keywords").items()))
    return readers.jats_metadata(rows).select("article_key", "source_path", "meta_title")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS openalex_id, CASE WHEN o_orderkey % 3 > 0 THEN '10.1/' || o_orderkey WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN ' ' END AS doi, strftime(o_orderdate, '%Y') || '-' || CASE WHEN month(o_orderdate) < 7 THEN strftime(o_orderdate, '%m') ELSE '01' END || '-' || strftime(o_orderdate, '%d') AS publication_date,
CASE WHEN o_orderkey % 3 > 0 THEN 'https://doi.org/10.1/' || o_orderkey END AS best_oa_landing_page_url, CASE WHEN o_orderkey % 5 > 0 THEN true END AS is_oa, CAST(NULL AS BIGINT) AS cited_by_count FROM orders""")
def abstract_tier(spark: SparkSession, d: str) -> DataFrame:
    """The projection of articles that the work index reads."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    month = F.month("o_orderdate")
    a = o.select(k.cast("string").alias("article_key"), F.when(k % 3 > 0, F.concat(F.lit("10.1/"), k.cast("string"))).when(k % 2 == 0, " ").alias("doi"), F.col("o_orderpriority").alias("title"), F.lit("x").alias("abstract"), F.year("o_orderdate").alias("pub_year"), F.when(month < 7, month).otherwise(month + 12).alias("pub_month"), F.dayofmonth("o_orderdate").alias("pub_day"), F.when(k % 5 > 0, "http://l").alias("license_url"), *(v.alias(n) for n, v in _blank("pmid", "pmcid", "article_type", "journal").items()))
    return sinks.abstract_tier(a).select("openalex_id", "doi", "publication_date", "best_oa_landing_page_url", "is_oa", "cited_by_count")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """documents as raw works: every 5th malformed, every 7th without id, every 11th without title, some without abstract."""
    k = F.col("doc_id")
    t = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    words = F.slice("w", 1, 6)
    index_ = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.transform(F.filter(F.transform(words, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == w), lambda s: s["i"]))))
    named = lambda *names: F.array(*(F.struct(n.alias("display_name")) for n in names))
    return t.select(
        F.when(k % 7 > 0, F.concat(F.lit("W"), k.cast("string"))).alias("id"), F.when(k % 11 > 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.lit(None).cast("string").alias("display_name"), F.when(k % 3 > 0, index_).alias("abstract_inverted_index"),
        F.lit("2020-01-01").alias("publication_date"), F.lit(2020).alias("publication_year"), F.struct(F.lit("1").alias("pmid")).alias("ids"), F.lit(None).cast("string").alias("doi"), "lang", F.col("lang").alias("language"), F.lit("article").alias("type"), F.col("n_chars").cast("int").alias("cited_by_count"),
        F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"), F.lit("raw").alias("raw_author_name"), named(F.col("source"), F.upper("source")).alias("institutions")), F.struct(F.struct(F.lit(None).cast("string").alias("display_name")).alias("author"), F.lit("Raw Name").alias("raw_author_name"), F.lit(None).cast("array<struct<display_name:string>>").alias("institutions"))).alias("authorships"),
        F.struct(F.struct(F.lit(None).cast("string").alias("display_name"), F.lit("1-2").alias("issn_l")).alias("source"), F.col("source").alias("raw_source_name")).alias("primary_location"), F.struct(F.lit("1").alias("volume"), F.lit("2").alias("issue"), F.lit("3").alias("first_page"), F.lit("4").alias("last_page")).alias("biblio"),
        named(F.lit("A"), F.lit(" a "), F.lit("B")).alias("topics"), F.array().cast("array<struct<display_name:string>>").alias("keywords"), F.lit(None).cast("boolean").alias("is_retracted"), F.when(k % 5 == 0, "{").alias("malformed"),
    )


@query(r"""WITH t AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '')[1:6] AS w FROM documents),
f AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 11 > 0 THEN 'T' || doc_id END AS title, CASE WHEN doc_id % 3 > 0 AND len(w) > 0 THEN array_to_string(w, ' ') END AS abstract, n_chars FROM t WHERE doc_id % 5 <> 0 AND doc_id % 7 > 0)
SELECT 'W' || doc_id AS openalex_id, title, abstract, lang || '; Raw Name' AS authors, source AS institutions, source AS journal, 'A; B' AS topics, CAST(NULL AS VARCHAR) AS keywords, CAST(n_chars AS INTEGER) AS cited_by_count, false AS is_retracted FROM f WHERE title IS NOT NULL OR regexp_matches(coalesce(abstract, ''), '\S')""")
def works_digest(spark: SparkSession, d: str) -> DataFrame:
    """Raw works, nested and with abstracts as word positions, as flat rows."""
    return readers.works_digest(_raw(spark, d)).select("openalex_id", "title", "abstract", "authors", "institutions", "journal", "topics", "keywords", "cited_by_count", "is_retracted")


@query(r"SELECT count(*) AS lines, count(*) FILTER (doc_id % 5 = 0) AS malformed, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 = 0) AS no_id, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0 AND (doc_id % 3 = 0 OR len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) = 0)) AS no_text FROM documents")
def reject_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many raw works were malformed, without id, or without text, in one pass."""
    return readers.reject_counts(_raw(spark, d))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS article_key, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN '10.5/own' END, CASE WHEN o_orderkey % 4 = 1 THEN '10.1162/neco_a_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END) AS doi, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, 'Neural Computation') AS journal FROM orders")
def store_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """A store's articles with its one journal, and DOIs from the names of checkpoint files."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    articles = o.select(k.cast("string").alias("article_key"), F.when(k % 3 == 0, "10.5/own").alias("doi"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("journal"))
    number = F.lpad((k % 100000).cast("string"), 5, "0")
    files = o.where(k % 4 > 0).select(k.cast("string").alias("paper_key"), F.when(k % 4 == 1, F.concat(F.lit("neco_a_"), number, F.lit(".pdf"))).when(k % 4 == 2, F.concat(F.lit("neco_x_"), number, F.lit(".pdf"))).otherwise("other.pdf").alias("filename"))
    return readers.store_enriched(articles, files, ["unknown", "Neural Computation", " ", "Neural Computation"])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS pub_year FROM orders WHERE o_orderkey % 9 > 0 AND year(o_orderdate) BETWEEN 1994 AND 1996")
def year_range(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a range of years; those without year are out."""
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.year("o_orderdate")).alias("pub_year"))
    return readers.in_years(o, 1994, 1996)


@query("SELECT p_partkey FROM part WHERE p_size > 20 OR (p_partkey % 3 > 0 AND trim(p_name) <> '')")
def ingest_keeps(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a body, or an abstract where the abstract tier is wanted."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") > 20).alias("has_body"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise(" ").alias("abstract"))
    return readers.keep_ingested(p, True).select("p_partkey")


@query("SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) + (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AS nations, false AS regions")
def key_sets_equal(spark: SparkSession, d: str) -> DataFrame:
    """Whether two tables have the same keys: nations of customers, and regions against nations."""
    k = lambda t, c: read(spark, d, t).select(F.col(c).alias("k"))
    nations, regions = R.same_keys(k("nation", "n_nationkey"), k("customer", "c_nationkey"), "k"), R.same_keys(k("region", "r_regionkey"), k("nation", "n_nationkey"), "k")
    return spark.range(1).select(F.lit(nations).alias("nations"), F.lit(regions).alias("regions"))


# --- text and dates

@query("SELECT doc_id, concat_ws('. ', CASE WHEN trim(lang) <> '' THEN lang END, substr(text, 1, 400), CASE WHEN doc_id % 2 = 0 THEN substr(source, 1, 200) END, substr(source, 1, 150), CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN text END) AS text FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')")
def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the second stage reads of a work: bounded fields, blanks left out."""
    t = read(spark, d, "documents").where(text.blank_to_null(F.col("text")).isNotNull())
    c, none = F.col, F.lit(None).cast("string")
    return t.select("doc_id", text.rerank_text(c("lang"), c("text"), F.when(c("doc_id") % 2 == 0, c("source")), none, c("source"), F.lit(" "), c("text")).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS flexible,
CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 3 = 0 THEN '-01-01' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '-%m') || '-01' ELSE strftime(o_orderdate, '-%m-%d') END END AS whole FROM orders""")
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates as far as they are known, and filled up."""
    k, t = F.col("o_orderkey"), "o_orderdate"
    year, month, day = F.when(k % 5 > 0, F.year(t)), F.when(k % 3 > 0, F.month(t)), F.when(k % 3 == 2, F.dayofmonth(t))
    return read(spark, d, "orders").select("o_orderkey", text.flexible_date(year, month, day).alias("flexible"), text.full_date(year, month, day).alias("whole"))


@query("SELECT p_partkey, array_to_string(list_distinct(list_filter(list_transform(string_split(replace(p_name, ' ', '; ') || ';x; ' || upper(p_name) || ' ;', ';'), lambda x: lower(trim(x))), lambda x: length(x) > 1)), '|') AS names FROM part".replace("list_distinct(", "list_sort(list_distinct(").replace("> 1)), '|')", "> 1))), '|')"))
def split_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a list: trimmed, lower case, longer than a letter, each once (sorted here, as SQL keeps no order)."""
    names = F.concat(F.replace("p_name", F.lit(" "), F.lit("; ")), F.lit(";x; "), F.upper("p_name"), F.lit(" ;"))
    return read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(text.split_names(names)), "|").alias("names"))


@query("SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{Nd}]', '', 'g') AS bare FROM documents WHERE text IS NOT NULL")
def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Texts by their letters and digits alone, without marks."""
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.fingerprint(F.col("text")).alias("bare"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&#34;', '\"'), '&#60;', '<'), '&#62;', '>'), '&nbsp;', chr(160)), '&#38;', '&'), '&amp;', '&') AS text FROM pages")
def unescaped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their entities decoded."""
    return read(spark, d, "pages").select("page_id", text.unescape(F.col("html")).alias("text"))


# --- evaluation

@query("SELECT CAST(c_custkey AS VARCHAR) AS query_id, min(rank) AS rank FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey % 13 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) ON o_custkey = c_custkey AND m = c_custkey % 13 GROUP BY c_custkey")
def known_item_rank(spark: SparkSession, d: str) -> DataFrame:
    """The rank of the expected DOI in each query's results, in whatever form the DOIs come."""
    from pyspark.sql.window import Window

    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("query_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat(F.lit("https://doi.org/10.1/A"), (F.col("o_orderkey") % 13).cast("string")).alias("doi"))
    want = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("query_id"), F.concat(F.lit(" doi:10.1/a"), (F.col("c_custkey") % 13).cast("string")).alias("expect_doi"))
    return evaluation.rank_of(o, want)


@query("SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 4 > 0 OR n_chars IS NOT NULL THEN concat_ws(' | ', CASE WHEN doc_id % 4 > 0 THEN source END, CAST(n_chars AS VARCHAR)) END, CASE WHEN doc_id % 2 = 0 AND regexp_matches(coalesce(text, ''), '\\S') THEN text ELSE source END) AS text FROM documents")
def judge_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge reads of a hit."""
    c, k = F.col, F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", evaluation.judge_text(F.when(k % 3 > 0, c("lang")), [F.when(k % 4 > 0, c("source")).otherwise(" "), c("n_chars")], [F.when(k % 2 == 0, c("text")), c("source")]).alias("text"))


@query("SELECT 'q' || (l.doc_id % 7) AS query_id, CAST(l.doc_id AS VARCHAR) AS hit, CASE WHEN l.doc_id % 3 = 0 THEN 'shown ' || l.doc_id WHEN l.doc_id % 5 > 0 THEN d.lang || chr(10) || chr(10) || substr(d.text, 1, 2000) END AS text FROM labels l LEFT JOIN documents d USING (doc_id)")
def pooled_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text for each pooled hit: the one a run showed, else that of the article."""
    lab, k = read(spark, d, "labels"), F.col("doc_id")
    pooled = lab.select(F.concat(F.lit("q"), k % 7).alias("query_id"), k.cast("string").alias("hit"))
    runs = lab.where(k % 3 == 0).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system"), k.cast("string").alias("hit"), F.concat(F.lit("shown "), k).alias("text")).withColumn("text", F.when(F.col("system") == "a", F.col("text")).otherwise("later"))
    articles = read(spark, d, "documents").where("doc_id % 5 > 0").select(k.cast("string").alias("openalex_id"), F.col("lang").alias("title"), F.col("text").alias("abstract"))
    return evaluation.pooled_texts(pooled, runs, articles)


_COHORT = """r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'has' ELSE 'lacks' END AS cohort, l_orderkey % 4 > 0 AS doi, l_partkey % 3 > 0 AS fnd, l_suppkey % 2 = 0 AS abstract, l_partkey % 5 = 0 AS pdf, l_orderkey % 10 AS k FROM lineitem WHERE l_quantity < 30),
s AS (SELECT *, doi AND fnd AS found FROM r)"""


@query(f"""WITH {_COHORT}, n AS (SELECT cohort, count(*) AS sampled, count(*) FILTER (doi) AS with_doi, count(*) FILTER (found) AS found, count(*) FILTER (found AND abstract) AS with_abstract, count(*) FILTER (found AND pdf) AS with_pdf, avg(CASE WHEN found AND k <> 0 THEN CASE WHEN k = 1 THEN 0.0 ELSE 1.0 END END) AS title_agreement FROM s GROUP BY cohort)
SELECT cohort, sampled, with_doi, found, with_abstract, with_pdf, round(title_agreement, 9) AS title_agreement, round(with_doi / sampled, 9) AS doi_rate, round(with_abstract / sampled, 9) AS abstract_rate, round(with_pdf / sampled, 9) AS pdf_rate, round(found / with_doi, 9) AS found_of_resolvable, round(with_abstract / found, 9) AS abstract_of_found FROM n""")
def cohort_report(spark: SparkSession, d: str) -> DataFrame:
    """What a second source would add to rows with and without an abstract, under a predicate of the user's."""
    l = read(spark, d, "lineitem").withColumn("abstract", F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise(" "))
    k = F.col("l_orderkey") % 10
    rows = R.union_all([evaluation.cohort(l, has, "l_quantity < 30").withColumn("cohort", F.lit(name)) for name, has in (("has", True), ("lacks", False))])
    records = rows.select("cohort", F.when(F.col("l_orderkey") % 4 > 0, "10.1/x").alias("doi"), (F.col("l_partkey") % 3 > 0).alias("found"), F.when(F.col("l_suppkey") % 2 == 0, "text").otherwise(" ").alias("abstract"), F.when(F.col("l_partkey") % 5 == 0, "url").alias("pdf"), F.lit("The Title: of a work, " + "long " * 20 + "one").alias("title"), F.when(k == 0, "").when(k == 1, "Another").otherwise("the title OF a work " + "long " * 20 + "two").alias("other_title"))
    s = evaluation.cohort_summary(records)
    return s.select("cohort", "sampled", "with_doi", "found", "with_abstract", "with_pdf", *(F.round(c, 9).alias(c) for c in s.columns[6:]))


@query("SELECT 'q' || (doc_id % 7) AS query_id, CAST(rank AS INTEGER) AS rank, max(CASE WHEN s = 0 THEN h END) AS s0, max(CASE WHEN s = 1 THEN h END) AS s1, max(CASE WHEN s = 2 THEN h END) AS s2 FROM (SELECT doc_id, doc_id % 3 AS s, CASE WHEN quality = 1 THEN '*' ELSE ' ' END || doc_id AS h, row_number() OVER (PARTITION BY doc_id % 3, doc_id % 7 ORDER BY doc_id) AS rank FROM labels) WHERE rank <= 10 GROUP BY ALL")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Systems side by side, with the gold set's hits marked."""
    from pyspark.sql.window import Window

    lab, k = read(spark, d, "labels"), F.col("doc_id")
    runs = lab.select(F.concat(F.lit("s"), k % 3).alias("system"), F.concat(F.lit("q"), k % 7).alias("query_id"), F.row_number().over(Window.partitionBy(k % 3, k % 7).orderBy("doc_id")).alias("rank"), k.cast("string").alias("hit"))
    gold = lab.where("quality = 1").select(F.concat(F.lit("q"), k % 7).alias("query_id"), k.cast("string").alias("hit"))
    return evaluation.side_by_side(runs, gold, 10)


# --- corrections and vectors

def _papers(spark: SparkSession, d: str) -> DataFrame:
    """documents as papers: lines are sentences; the abstract is one of them, two, none, or a changed one."""
    t = read(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l")).where("size(l) > 2")
    k = F.col("doc_id") % 4
    reference = F.when(k == 0, F.upper(F.element_at("l", 2))).when(k == 1, F.concat(F.element_at("l", 1), F.lit(" - "), F.element_at("l", 2))).when(k == 2, F.concat(F.element_at("l", 2), F.lit(" and something that is not there")))
    return t.select(F.col("doc_id").cast("string").alias("key"), reference.alias("reference"), F.transform("l", lambda x, i: F.struct(i.cast("string").alias("path"), x.alias("text"))).alias("sentences"))


@query()
def body_matches(spark: SparkSession, d: str) -> DataFrame:
    """Published abstracts looked for in bodies: how many papers and edits of each status (tests hold the matcher against brute force)."""
    return repair.status_histogram(repair.match_bodies(_papers(spark, d)))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'Corrected ' || c_custkey ELSE c_name END AS c_name, c_mktsegment FROM customer")
def corrected_records(spark: SparkSession, d: str) -> DataFrame:
    """Originals with the reviewed corrections of a plan; the keys of plan and corrections must agree."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    plan = c.where("c_custkey % 10 = 3").select("c_custkey")
    return repair.corrected(c, plan, plan.select("c_custkey", F.concat(F.lit("Corrected "), F.col("c_custkey").cast("string")).alias("c_name")), "c_custkey", ["c_name"])


@query()
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of benchmark items by the stand-in model: mean of states, length 1 (tests hold them against brute force)."""
    return embedding.embed(read(spark, d, "benchmark"), "item_id", F.col("text"), pooling="mean")
