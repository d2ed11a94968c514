"""The registered queries of this package, one for each operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import decontaminate, langid, maxent, neardup, packing, pii, quality, toxicity, urlfilter, warc
from scholia.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' archives hold, read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("file", "start")


OP1_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return neardup.classes(spark, table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    return decontaminate.scan(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_WORDS4 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS4} AS ws FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS4} AS ws FROM benchmark),
bi AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, ws[i:i + n - 1] AS win FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
di AS (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
dw AS (SELECT rid, n, i, ws[i:i + n - 1] AS win FROM di),
found AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win),
spots AS (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM found)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM spots GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""

def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in each document."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of each document."""
    return maxent.score(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of each document."""
    return quality.measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BLANK = "\\x20\\x09-\\x0D"

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{_BLANK}]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, i, hash(ws[i:i + 4]) AS g, ws[i:i + 4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
many AS (SELECT rid, g, win FROM g GROUP BY rid, g, win HAVING count(*) > 1),
spots AS (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT g.rid, g.i FROM g JOIN many USING (rid, g, win))),
r AS (SELECT rid, count(DISTINCT p) AS n FROM spots GROUP BY rid),
f AS (SELECT rid, doc_id, t, len(ws) AS n_words, coalesce(n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[{_BLANK}]+', '', 'g')) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(list_filter(ls, lambda x: regexp_matches(x, '[^{_BLANK}]'))) AS n_lines,
      len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^{_BLANK}]')))) AS n_lines_distinct,
      len(list_filter(ws, lambda x: list_contains({list(quality.STOP_WORDS)}, translate(x, '{_UPPER}', '{_LOWER}')))) AS n_stop,
      length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_lines - n_lines_distinct AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {quality.rules_sql()} AS kept
FROM b
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in its sequence."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of each page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, urlfilter.CONTRACT_RULES))


OP9_SQL = rf"""
WITH r(verdict, h, p) AS (VALUES {", ".join(str(x) for x in urlfilter.CONTRACT_RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id,
      translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT rid, h || p AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS k
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document."""
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_language_model": op6_language_model, "op10_toxicity": op10_toxicity, "op1_warc": op1_warc, "op3_language": op3_language, "op5_personal_data": op5_personal_data, "op2_near_duplicates": op2_near_duplicates, "op8_packing": op8_packing, "op7_quality": op7_quality, "op9_url_filter": op9_url_filter, "op4_decontaminate": op4_decontaminate}
ORACLES = {"op1_warc": OP1_SQL, "op7_quality": OP7_SQL, "op9_url_filter": OP9_SQL, "op4_decontaminate": OP4_SQL}
