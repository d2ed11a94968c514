"""Queries by name over the driver's tables, with the SQL that they are held against.

Roles of the tables: documents is the corpus, benchmark the query set, labels the grades,
conversations the ordered passages, pages markup, embeddings vectors, events JSON and latencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import scoring, text
from scholia.functions.analysis import plain_tokens
from scholia.operators import chunking, evaluation, index, markup, rerank, search, vectors
from scholia.session import share_code
from scholia.sources import readers, sinks

QUERY = "the and with thanea tion"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str, body: Column | None = None) -> DataFrame:
    """documents as index rows: the first line is the title, the source the venue, the length stands in for citations."""
    null = lambda kind="string": F.lit(None).cast(kind)
    first = F.substring_index("text", "\n", 1)
    rest = body if body is not None else F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)")
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.col("lang"), F.lit("-"), F.pmod("doc_id", F.lit(100))).alias("article_key"), first.alias("title"), rest.alias("body"),
        *(null().alias(c) for c in ("doi", "pmcid", "pmid", "issn", "institutions", "publisher", "topics", "keywords")), F.col("lang").alias("authors"), F.col("source").alias("journal"),
        (2000 + F.pmod("doc_id", F.lit(25))).cast("int").alias("year"), F.col("lang").alias("section"), F.col("source").alias("work_type"), F.col("n_chars").alias("citations"),
        (F.pmod("doc_id", F.lit(17)) == 0).alias("is_retracted"), null("boolean").alias("is_oa"),
    )


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("q", QUERY)], "query_id string, query_text string")


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"))


def _whole(spark: SparkSession, d: str) -> index.Index:
    """One field, the whole text, plain tokens."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang", "source", F.col("n_chars").alias("citations"), F.concat(F.col("lang"), F.lit("-"), F.pmod("doc_id", F.lit(100))).alias("article_key"), F.lit(None).cast("int").alias("year"), F.substring_index("text", "\n", 1).alias("title"))
    return index.build(docs, stemmed=False, fields={"body": F.col("body")})


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# BM25 over one field as common table expressions: sc(query_id, doc_id, score)
_BM25 = f"""
toks AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS len FROM toks GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
"""
_QT_ONE = f"qt AS (SELECT 'q' AS query_id, unnest(regexp_extract_all('{QUERY}', '[a-z0-9]+')) AS term)"
_QT_BENCH = "qt AS (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark)"
_R = "round(score, 6)"


#: Sums of doubles differ by the order of addition: scores that agree to so many digits are ties.
DIGITS = 9


def _shown(found: DataFrame, *columns: str) -> DataFrame:
    return found.select(*columns, F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_QT_ONE}, {_BM25} SELECT doc_id, {_R} AS score FROM sc ORDER BY round(sc.score, 9) DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ranked retrieval for one query."""
    return _shown(search.search(_whole(spark, d), _one(spark), 10, digits=DIGITS))


@query(f"WITH {_QT_BENCH}, {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, {_R} AS score FROM r WHERE rank <= 5")
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items as one batch of queries."""
    return _shown(search.search(_whole(spark, d), _benchmark(spark, d), 5, digits=DIGITS), "query_id", "rank")


_FIELDS = """
u AS (SELECT * FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')),
f AS (SELECT doc_id, 'title' AS field, 3.0 AS boost, string_split(text, chr(10))[1] AS x FROM u
      UNION ALL SELECT doc_id, 'body', 1.0, substr(text, length(string_split(text, chr(10))[1]) + 2) FROM u
      UNION ALL SELECT doc_id, 'authors', 2.0, lang FROM u UNION ALL SELECT doc_id, 'venue', 1.5, source FROM u),
toks AS (SELECT doc_id, field, boost, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS term FROM f),
tf AS (SELECT doc_id, field, boost, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT doc_id, field, count(*) AS len FROM toks GROUP BY ALL),
st AS (SELECT field, count(*) / (SELECT count(*) FROM u) AS mean, (SELECT count(*) FROM u) AS n FROM toks GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
parts AS (SELECT place, term, field, doc_id, tf, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS score
          FROM qt JOIN tf USING (term) JOIN df USING (field, term) JOIN dl USING (doc_id, field) JOIN st USING (field)),
best AS (SELECT doc_id, place, max(score) + 0.1 * (sum(score) - max(score)) AS s FROM parts GROUP BY ALL),
sc AS (SELECT doc_id, sum(s) AS score FROM best GROUP BY ALL)
"""
_QT_PLACES = f"q0 AS (SELECT regexp_extract_all('{QUERY} en src1', '[a-z0-9]+') AS w), qt AS (SELECT unnest(w) AS term, unnest(range(len(w))) AS place FROM q0)"


def _fielded(spark: SparkSession, d: str) -> tuple[index.Index, DataFrame]:
    return index.build(corpus(spark, d), stemmed=False), spark.createDataFrame([("q", QUERY + " en src1")], "query_id string, query_text string")


@query(f"WITH {_QT_PLACES}, {_FIELDS} SELECT doc_id, {_R} AS score FROM sc ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25f_dismax(spark: SparkSession, d: str) -> DataFrame:
    """Fields with boosts; each query word counts its best field and a tenth of the others."""
    ix, q = _fielded(spark, d)
    return _shown(search.search(ix, q, 20, digits=DIGITS))


@query(f"WITH {_QT_PLACES}, {_FIELDS} SELECT field, term, doc_id, CAST(place AS INTEGER) AS place, tf, {_R} AS score FROM parts")
def explain_terms(spark: SparkSession, d: str) -> DataFrame:
    """What scores are made of: one row per query word, field and document."""
    ix, q = _fielded(spark, d)
    return search.breakdown(ix, q).select("field", "term", F.col("id").alias("doc_id"), "place", "tf", F.round("score", 6).alias("score"))


@query(f"WITH {_QT_ONE}, {_BM25}, b AS (SELECT doc_id, CASE WHEN n_chars > 0 THEN score * (1 + 2.0 * least(1.0, log10(1 + n_chars) / 5.5)) ELSE score END AS score FROM sc JOIN documents USING (doc_id)) SELECT doc_id, {_R} AS score FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def bm25_citation_boost(spark: SparkSession, d: str) -> DataFrame:
    """The multiplicative prior, with the length as a stand-in for citations."""
    return _shown(search.search(_whole(spark, d), _one(spark), 10, prior=2.0, digits=DIGITS))


@query(f"WITH {_QT_ONE}, {_BM25}, b AS (SELECT doc_id, CASE WHEN n_chars > 0 THEN score + 2.0 * log10(1 + n_chars) ELSE score END AS score FROM sc JOIN documents USING (doc_id)) SELECT doc_id, {_R} AS score FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def additive_prior_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The additive prior of the second stage."""
    s = search.ranked(_whole(spark, d), _one(spark))
    return _shown(search.top(s.withColumn("score", F.round(scoring.citation_bonus(F.col("score"), F.col("citations"), 2.0), DIGITS)), 10))


_PLAIN_SEARCH = f"WITH {_QT_PLACES}, {_FIELDS} SELECT doc_id, {_R} AS score FROM sc JOIN documents USING (doc_id) WHERE {{}} ORDER BY round(score, 9) DESC, doc_id LIMIT 10"


def _filtered(spark: SparkSession, d: str, filters: search.Filters, allowed: DataFrame | None = None) -> DataFrame:
    ix, q = _fielded(spark, d)
    return _shown(search.search(ix, q, 10, filters, allowed, digits=DIGITS))


@query(_PLAIN_SEARCH.format("doc_id % 25 BETWEEN 5 AND 15 AND lang = 'en' AND doc_id % 17 <> 0 AND source NOT IN ('src0', 'src1')"))
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Year range, section, retraction and type filters; none of them scores."""
    return _filtered(spark, d, search.Filters(2005, 2015, "EN", False, ("SRC0", "src1")))


@query(_PLAIN_SEARCH.format("lang IN ('de', 'fr') AND source = 'src3'"))
def name_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Author list and journal phrase."""
    return _filtered(spark, d, search.Filters(author="de OR fr", journal="src3"))


@query(_PLAIN_SEARCH.format("lang || '-' || (doc_id % 100) IN (SELECT 'en-' || CAST(i AS VARCHAR) FROM range(0, 100, 7) t(i))"))
def allowlist_search(spark: SparkSession, d: str) -> DataFrame:
    """A sub-corpus by semi join: scores are those of the whole corpus."""
    allowed = spark.range(0, 100, 7).select(F.concat(F.lit("en-"), F.col("id")).alias("key"))
    return _filtered(spark, d, search.Filters(), allowed)


_KEY = "lang || '-' || (doc_id % 100)"


@query(f"WITH {_QT_ONE}, {_BM25}, k AS (SELECT {_KEY} AS article_key, doc_id, round(score, 9) AS score FROM sc JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY article_key ORDER BY score DESC, doc_id) AS n FROM k) SELECT article_key, doc_id, {_R} AS score FROM r WHERE n = 1 ORDER BY r.score DESC, doc_id LIMIT 20")
def collapse_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The best passage of each article."""
    return _shown(search.collapse(search.ranked(_whole(spark, d), _one(spark), digits=DIGITS), 20), "article_key")


@query(f"WITH {_QT_ONE}, {_BM25}, k AS (SELECT {_KEY} AS article_key, doc_id, round(score, 9) AS score FROM sc JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k), c AS (SELECT *, row_number() OVER (PARTITION BY article_key ORDER BY rank) AS n FROM r WHERE rank <= 100) SELECT article_key, doc_id, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 2")
def cap_per_group(spark: SparkSession, d: str) -> DataFrame:
    """At most two passages of an article among the first hundred."""
    s = search.search(_whole(spark, d), _one(spark), 100, digits=DIGITS)
    return search.cap_per_article(s, 2).select("article_key", F.col("id").alias("doc_id"), "rank")


@query(f"""WITH {_QT_ONE}, {_BM25}, k AS (SELECT {_KEY} AS article_key, doc_id, n_chars, round(score, 9) AS score, lower(regexp_replace(trim(string_split(text, chr(10))[1]), '\\.+$', '')) AS tk FROM sc JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k), h AS (SELECT *, CASE WHEN tk <> '' THEN 't:' || tk ELSE 'a:' || article_key END AS key FROM r WHERE rank <= 200),
g AS (SELECT key, min(rank) AS rank, arg_max(struct_pack(doc_id := doc_id, article_key := article_key, score := score), struct_pack(c := n_chars, r := -rank)) AS w FROM h GROUP BY key),
o AS (SELECT rank, w.doc_id AS doc_id, w.score AS score, row_number() OVER (PARTITION BY w.article_key ORDER BY rank) AS n FROM g)
SELECT doc_id, {_R} AS score, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank FROM o WHERE n = 1""")
def title_dedup_best(spark: SparkSession, d: str) -> DataFrame:
    """One row per title: the most cited in the place of the first."""
    s = search.search(_whole(spark, d), _one(spark), 200, digits=DIGITS)
    return search.dedup_titles(s).select(F.col("id").alias("doc_id"), F.round(F.round("score", DIGITS), 6).alias("score"), "rank")


@query(f"""WITH {_QT_ONE}, {_BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc),
t AS (SELECT doc_id, n_chars, list_distinct({TOKENS}) AS w FROM documents JOIN r USING (doc_id) WHERE rank <= 100),
s AS (SELECT doc_id, len(list_intersect(w, ['and', 'the', 'with', 'thanea', 'tion'])) / 5.0 + CASE WHEN n_chars > 0 THEN 0.1 * log10(1 + n_chars) ELSE 0 END AS score FROM t)
SELECT doc_id, {_R} AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def rerank_lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    """The second stage over the first hundred, through the pluggable scorer: share of the query's words, plus the prior."""
    s = search.search(_whole(spark, d), _one(spark), 100, digits=DIGITS)
    bodies = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body_"))
    return _shown(rerank.rerank(s.join(bodies, "id"), _one(spark), F.col("body_"), 10, 0.1, lambda: rerank.plain_scorer, DIGITS))


@query()
def rerank_scorer_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same stage through the pluggable scorer, with stems and stop words."""
    s = search.search(_whole(spark, d), _one(spark), 100, digits=DIGITS)
    bodies = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body_"))
    return rerank.rerank(s.join(bodies, "id"), _one(spark), F.col("body_"), 10, 0.1).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def tokens_df_top(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of the most common terms."""
    return _whole(spark, d).terms.select("term", "df").orderBy(F.desc("df"), "term").limit(100)


@query("SELECT lang, count(*) AS docs, sum(n) AS words, max(n) AS longest FROM (SELECT lang, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n FROM documents) GROUP BY lang")
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words per language."""
    n = read(spark, d, "documents").select("lang", text.word_count(F.col("text")).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.max("n").alias("longest"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS id, source || '. ' || text AS text FROM documents WHERE regexp_matches(coalesce(text, ''), '\S')")
def scan_nonblank_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows with text, with their prefix."""
    return readers.texts(spark, f"{d}/documents.parquet", "doc_id", "text", "source")


_CASES = " ".join(f"WHEN contains(t, '{p}') THEN '{k}'" for p, k in text.SECTION_TITLES)
_SECTIONS = f"""s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ['intro', 'results|discussion', 'COI-statement', 'other'][p_size % 4 + 1] END AS sec_type,
['3. Materials and Methods', '2.1 Study results', 'Background', 'Limitations of it', 'Funding', 'Animals', 'Summary', 'Interpretation', 'Nothing', NULL][p_size % 10 + 1] AS title FROM part),
k AS (SELECT *, regexp_replace(lower(trim(coalesce(title, ''))), '^[0-9. ]+', '') AS t FROM s),
c AS (SELECT p_partkey, CASE lower(coalesce(sec_type, '')) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.SECTION_TYPES.items())} ELSE CASE {_CASES} ELSE 'Unknown' END END AS kind FROM k)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    titles = ["3. Materials and Methods", "2.1 Study results", "Background", "Limitations of it", "Funding", "Animals", "Summary", "Interpretation", "Nothing", None]
    types = ["intro", "results|discussion", "COI-statement", "other"]
    pick = lambda xs, c: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (c % len(xs) + 1).cast("int"))
    p = read(spark, d, "part")
    return p.select("p_partkey", text.classify_section(F.when(F.col("p_partkey") % 5 == 0, pick(types, F.col("p_size"))), pick(titles, F.col("p_size"))).alias("kind"))


@query(f"WITH {_SECTIONS} SELECT p_partkey, kind, kind IN ('Acknowledgements', 'Supplementary') AS non_evidential FROM c")
def section_classify(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of section titles."""
    return _sections(spark, d).withColumn("non_evidential", text.is_non_evidential(F.col("kind")))


@query(f"WITH {_SECTIONS}, g AS (SELECT kind AS section_kind, count(*) AS chunks, CAST(sum(p_partkey) AS BIGINT) AS words FROM c GROUP BY kind) SELECT *, round(100 * chunks / (SELECT sum(chunks) FROM g), 2) AS percent FROM g")
def section_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Share of each kind."""
    return chunking.section_distribution(_sections(spark, d).select(F.col("kind").alias("section_kind"), F.col("p_partkey").alias("word_count")))


def _cleaned(column: str) -> str:
    """SQL for clean_text(). DuckDB has no look-ahead: a replacement that puts back what it looked at, done eight times, reaches chains of up to 2**8 separators."""
    out = f"translate(coalesce({column}, ''), chr(160) || chr(10) || chr(13) || chr(9), '    ')"
    for pattern in (r"\[\s*[,;–—-]*\s*\]", r"\(\s*[,;–—-]*\s*\)"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for _ in range(8):
        out = f"regexp_replace({out}, '[,;–—]+(\\s*[.,;:!?])', '\\1', 'g')"
    out = f"regexp_replace({out}, '[,;–—]+\\s*$', '')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '\s+([,.;:!?])', '\1', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_cleaned('html')} AS text FROM pages")
def clean_markup(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages cleaned, their markup and all."""
    return read(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query(f"SELECT doc_id, {_cleaned('text')} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts of all documents."""
    return read(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 80)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(s // 80 AS INTEGER) AS part, array_to_string(w[s + 1:s + 100], ' ') AS text FROM s WHERE s = 0 OR len(w) - s >= 30""")
def chunk_hard_split(spark: SparkSession, d: str) -> DataFrame:
    """Windows of words with an overlap."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return read(spark, d, "documents").select("doc_id", F.posexplode(text.hard_split(w, 100, 20, 30)).alias("part", "text"))


@query()
def sentence_chunker(spark: SparkSession, d: str) -> DataFrame:
    """Passages of all documents, each line a block."""
    b = read(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("article_key"), F.col("source").alias("source_corpus"), F.lit("Unknown").alias("kind"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("section_path"), F.lit(0).alias("section_index"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("pub_year"), F.lit(False).alias("is_retracted"), F.lit(True).alias("has_body"), F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    return chunking.chunk(b)


@query()
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of pages, by blocks."""
    return markup.page_blocks(read(spark, d, "pages"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE coalesce(substr(text, 1, nullif(CASE WHEN substr(text, 401, 1) = ' ' THEN 401 WHEN strpos(substr(text, 1, 400), ' ') > 0 THEN 400 - strpos(reverse(substr(text, 1, 400)), ' ') + 1 END, 1) - 1), substr(text, 1, 400)) || ' ...' END AS excerpt FROM documents")
def excerpt_last_space(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts that end at a word, if there is one."""
    return read(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), 400).alias("excerpt"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
y AS (SELECT doc_id, min(i) AS i, arg_min(trim(w), i) AS w FROM x WHERE trim(w) <> '' GROUP BY doc_id, lower(trim(w))), z AS (SELECT doc_id, string_agg(w, '; ' ORDER BY i) AS names FROM y GROUP BY doc_id)
SELECT doc_id, names FROM documents LEFT JOIN z USING (doc_id)""")
def join_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Names once each, whatever their case."""
    return read(spark, d, "documents").select("doc_id", text.join_distinct(F.split("text", " ")).alias("names"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    """A typed field of a JSON column."""
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS text FROM documents WHERE text IS NOT NULL")
def inverted_index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Texts made again from word -> positions."""
    t = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    m = t.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return m.select("doc_id", text.inverted_index_text(F.col("m")).alias("text"))


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'https://doi.org/10.1/AB' WHEN 1 THEN 'doi: 10.5/x' WHEN 2 THEN 'http://dx.doi.org/10.2/Q' WHEN 3 THEN '10.9/plain' WHEN 4 THEN 'nothing' END || c_custkey AS doi,
CASE c_custkey % 4 WHEN 0 THEN 'https://openalex.org/W' WHEN 1 THEN 'w' WHEN 2 THEN 'X' ELSE 'W' END || c_custkey AS work FROM customer),
y AS (SELECT *, regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') AS bare FROM x)
SELECT c_custkey, CASE WHEN starts_with(bare, '10.') THEN bare END AS doi, CASE WHEN c_custkey % 4 <> 2 THEN 'https://openalex.org/W' || c_custkey END AS work_id FROM y""")
def normalise_ids(spark: SparkSession, d: str) -> DataFrame:
    """DOIs and work ids in their canonical form."""
    k = F.col("c_custkey")
    doi = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("https://doi.org/10.1/AB", "doi: 10.5/x", "http://dx.doi.org/10.2/Q", "10.9/plain", "nothing", None))), (k % 6 + 1).cast("int")), k.cast("string"))
    work = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("https://openalex.org/W", "w", "X", "W"))), (k % 4 + 1).cast("int")), k.cast("string"))
    return read(spark, d, "customer").select("c_custkey", text.normalise_doi(doi).alias("doi"), text.normalise_work_id(work).alias("work_id"))


@query("SELECT system, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM (SELECT source AS system, CASE WHEN n_chars % 13 > 0 THEN n_chars % 13 END AS rank FROM documents) GROUP BY system")
def known_item_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates by system."""
    r = read(spark, d, "documents").select(F.col("source").alias("system"), F.when(F.col("n_chars") % 13 > 0, F.col("n_chars") % 13).alias("rank"))
    return evaluation.known_item(r).select("system", "queries", *(F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_10", "mrr")))


_RUNS = """runs AS (SELECT 's' || (l.doc_id % 3) AS system, 'q' || (l.doc_id % 7) AS query_id, CAST(l.doc_id AS VARCHAR) AS hit, row_number() OVER (PARTITION BY l.doc_id % 3, l.doc_id % 7 ORDER BY d.n_chars DESC, l.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
grades AS (SELECT 'q' || (doc_id % 7) AS query_id, CAST(doc_id AS VARCHAR) AS hit, quality + 2 * toxic AS grade FROM labels)"""


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lab, doc = read(spark, d, "labels"), read(spark, d, "documents").select("doc_id", "n_chars")
    q, s = F.col("doc_id") % 7, F.col("doc_id") % 3
    runs = lab.join(doc, "doc_id").select(F.concat(F.lit("s"), s).alias("system"), F.concat(F.lit("q"), q).alias("query_id"), F.col("doc_id").cast("string").alias("hit"), F.row_number().over(Window.partitionBy(s, q).orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return runs, lab.select(F.concat(F.lit("q"), q).alias("query_id"), F.col("doc_id").cast("string").alias("hit"), (F.col("quality") + 2 * F.col("toxic")).alias("grade"))


@query(f"""WITH {_RUNS}, i0 AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, hit) AS p FROM grades),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM i0 WHERE p <= 10 GROUP BY query_id),
h AS (SELECT r.*, coalesce(grade, 0) AS grade FROM runs r LEFT JOIN grades USING (query_id, hit) WHERE rank <= 10),
per AS (SELECT system, query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, avg(grade) AS mean_grade, avg(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END) AS useful,
max(CASE WHEN grade >= 2 AND rank = 1 THEN 1.0 ELSE 0.0 END) AS hit_1, max(CASE WHEN grade >= 2 THEN 1.0 ELSE 0.0 END) AS hit_k, coalesce(max(CASE WHEN grade >= 2 THEN 1.0 / rank END), 0) AS rr FROM h GROUP BY ALL)
SELECT system, count(*) AS queries, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg, round(avg(mean_grade), 6) AS mean_grade, round(avg(useful), 6) AS useful, round(avg(hit_1), 6) AS hit_1, round(avg(hit_k), 6) AS hit_k, round(avg(rr), 6) AS rr FROM per JOIN ideal USING (query_id) GROUP BY system""")
def ndcg_mrr_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Pooled nDCG and its companions by system."""
    out = evaluation.by_system(evaluation.judged(*_runs(spark, d), 10))
    return out.select("system", "queries", *(F.round(c, 6).alias(c) for c in ("ndcg", "mean_grade", "useful", "hit_1", "hit_k", "rr")))


@query(f"WITH {_RUNS} SELECT query_id, hit, min(rank) AS rank FROM runs WHERE rank <= 20 GROUP BY ALL")
def pooled_union(spark: SparkSession, d: str) -> DataFrame:
    """Pooled pairs of all systems."""
    return evaluation.pool(_runs(spark, d)[0], 20).select("query_id", "hit", "rank")


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, v[CAST(floor(len(v) * 0.5) AS INTEGER) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS INTEGER) + 1] AS p95 FROM s")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by place, without interpolation."""
    return evaluation.nearest_ranks(read(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT source, count(*) AS rows, round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def missing_share_by_group(spark: SparkSession, d: str) -> DataFrame:
    """How much of each source has no label."""
    j = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return evaluation.missing_share(j, "source", F.col("quality")).withColumn("missing", F.round("missing", 9))


@query(f"WITH n AS (SELECT CAST(len({TOKENS}) AS BIGINT) AS n FROM documents), s AS (SELECT list_sort(list(n)) AS v FROM n) SELECT round((SELECT avg(n) FROM n), 6) AS mean, (SELECT max(n) FROM n) AS longest, " + ", ".join(f"v[CAST(floor(len(v) * {p / 100}) AS INTEGER) + 1] AS p{p}" for p in (50, 90, 95, 99)) + ", " + ", ".join(f"round((SELECT sum(least(n, {c})) / sum(n) FROM n), 9) AS compute_{c}, round((SELECT avg(CASE WHEN n > {c} THEN 1.0 ELSE 0.0 END) FROM n), 9) AS cut_{c}" for c in (128, 192, 256, 384, 512)) + " FROM s")
def token_budget_report(spark: SparkSession, d: str) -> DataFrame:
    """Token lengths and what caps would cost."""
    n = read(spark, d, "documents").select(F.size(plain_tokens(F.col("text"))).cast("long").alias("n"))
    r = evaluation.token_report(n, "n")
    return r.select(F.round("mean", 6).alias("mean"), "longest", "p50", "p90", "p95", "p99", *(F.round(c, 9).alias(c) for c in r.columns if c[:3] in ("com", "cut")))


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT upper(substr(sha256(string_agg(source || ':' || n || chr(10), '' ORDER BY source)), 1, 16)) AS fingerprint FROM n")
def fingerprint_sources(spark: SparkSession, d: str) -> DataFrame:
    """A digest over ordered names and sizes."""
    return sinks.fingerprint(read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


def _checksum(vector: Column) -> Column:
    """All elements of a vector in one number, which place and value of each decide."""
    return F.round(F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)


@query(f"SELECT vec_id, round({_NORM}, 5) AS norm, round(list_sum([CAST(embedding[i + 1] AS DOUBLE) * (i + 1) FOR i IN range(len(embedding))]) / {_NORM}, 3) AS checksum FROM embeddings")
def vector_l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Vectors at length 1."""
    return read(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), _checksum(vectors.normalise(F.col("embedding"))).alias("checksum"))


@query("WITH q AS (SELECT [CAST(((i * 7) % 11) - 5 AS DOUBLE) FOR i IN range(64)] AS q), s AS (SELECT vec_id, list_sum([CAST(embedding[i + 1] AS DOUBLE) * q[i + 1] FOR i IN range(64)]) / (sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) * sqrt(list_sum([x * x FOR x IN q]))) AS c FROM embeddings, q) SELECT vec_id, round(c, 5) AS cosine FROM s ORDER BY c DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors most like a fixed one."""
    q = [float((i * 7) % 11 - 5) for i in range(64)]
    return vectors.cosine_top(read(spark, d, "embeddings"), "vec_id", "embedding", q, 10).select("vec_id", F.round("cosine", 5).alias("cosine"))


@query("WITH e AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL) SELECT label, round(sum(x * i), 3) AS checksum FROM m GROUP BY label")
def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of groups."""
    m = vectors.mean_pool(read(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", _checksum(F.col("embedding")).alias("checksum"))
