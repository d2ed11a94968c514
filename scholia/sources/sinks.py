"""Writers: sharded Parquet, reports, run files, stamps, generations. Paths may lie in any store that Spark reaches."""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import relational

LAYOUT_VERSION = 3


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over it."""
    fs, p = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(content.encode()))
    out.close()
    # one step that replaces: between a delete and a rename there would be no file
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.org.apache.hadoop.fs.Options
    replace = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    replace[0] = getattr(options, "Rename").OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(p), replace)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's content; None if there is none."""
    if not exists(spark, path):
        return None
    return "\n".join(r.value for r in spark.read.text(path).toLocalIterator())


def shards(df: DataFrame, path: str, rows: int = 25_000) -> None:
    """Zstandard Parquet in files of at most so many rows; an existing folder is never overwritten."""
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)


def corpus_tables(articles: DataFrame, chunks: DataFrame, path: str, every_abstract: bool = False, rows: int = 25_000) -> None:
    """articles, chunks and abstracts below path; abstracts only of articles that have one, unless all are asked for."""
    shards(articles.drop("blocks", "error"), f"{path}/articles", rows)
    shards(chunks, f"{path}/chunks", rows)
    shaped = abstract_tier(articles)
    shards(shaped if every_abstract else shaped.where(text.blank_to_null(F.col("abstract")).isNotNull()), f"{path}/abstracts", rows)


def abstract_tier(articles: DataFrame) -> DataFrame:
    """The 18-column projection of articles that the work index reads."""
    c = F.col
    page = F.when(text.blank_to_null(c("doi")).isNotNull(), F.concat(F.lit("https://doi.org/"), c("doi")))
    null = lambda kind: F.lit(None).cast(kind)
    return articles.select(
        c("article_key").alias("openalex_id"), "doi", "title", "abstract", text.full_date(c("pub_year"), c("pub_month"), c("pub_day")).alias("publication_date"), c("pub_year").alias("publication_year"), "pmid", "pmcid",
        null("string").alias("language"), c("article_type").alias("work_type"), null("bigint").alias("cited_by_count"), F.when(text.blank_to_null(c("license_url")).isNotNull(), True).alias("is_oa"),
        page.alias("best_oa_landing_page_url"), null("string").alias("best_oa_pdf_url"), c("license_url").alias("best_oa_license"), page.alias("primary_landing_page_url"), null("string").alias("primary_pdf_url"), c("journal").alias("primary_source_name"),
    )


def ingest_report(spark: SparkSession, articles: DataFrame, chunks: DataFrame, path: str, options: dict) -> dict:
    """Counts and the section mix of an ingest, as JSON at path."""
    a = articles.agg(F.count("*").alias("articles"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("has_body")).alias("with_body"), F.count_if(F.col("abstract").isNotNull()).alias("with_abstract")).first().asDict()
    kinds = {r.section_kind: {"chunks": r.chunks, "words": r.words} for r in chunks.groupBy("section_kind").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words")).collect()}
    report = {"options": options, **a, "chunks": sum(k["chunks"] for k in kinds.values()), "sections": kinds}
    write_text(spark, path, json.dumps(report, sort_keys=True))
    return report


def fingerprint(rows: DataFrame, name: str, size: str) -> DataFrame:
    """One row: a digest over the names and sizes of a few rows, in order of the names."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(size).alias("s")))), lambda x: F.concat(x["n"], F.lit(":"), x["s"].cast("string"), F.lit("\n"))), "")
    return rows.agg(F.upper(F.substring(F.sha2(line, 256), 1, 16)).alias("fingerprint"))


def stamp(spark: SparkSession, pattern: str, schema: str, **options: object) -> dict:
    """What an index was made from: layout, options, and a digest of the source files' names and lengths (not their content)."""
    fs, p = _fs(spark, pattern)
    found = sorted((s.getPath().getName(), s.getLen()) for s in fs.globStatus(p) or [] if s.isFile())
    if not found:
        raise FileNotFoundError(pattern)
    lines = "".join(f"{name}:{size}\n" for name, size in found)
    return {"layout": LAYOUT_VERSION, "schema": schema, "files": len(found), "source": hashlib.sha256(lines.encode()).hexdigest()[:16].upper(), **options}


def is_current(spark: SparkSession, path: str, wanted: dict) -> bool:
    """Whether the stamp at path says the same; a malformed one is stale."""
    try:
        return json.loads(read_text(spark, path) or "") == wanted
    except ValueError:
        return False


def source_digest(spark: SparkSession, pattern: str) -> str:
    """A digest over the content of the files of a pattern, in order of their names; files are read by tasks."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("h"))
    return fingerprint(rows, "path", "h").first()[0]


@contextmanager
def unchanged(spark: SparkSession, pattern: str):
    """A block during which the source files must stay as they are; a change is an error, and what the block made is not to be published."""
    before = source_digest(spark, pattern)
    yield before
    if source_digest(spark, pattern) != before:
        raise OSError(f"{pattern} changed meanwhile")


def mark_complete(spark: SparkSession, path: str, report: dict) -> None:
    """Put a report beside finished tables: without it they don't count as complete."""
    write_text(spark, f"{path}/ingest-report.json", json.dumps(report, sort_keys=True))


def require_complete(spark: SparkSession, path: str, fallback: str | None = None) -> str:
    """The path if its tables are complete, else that of the fallback; neither is an error."""
    for place in (path, fallback):
        if place and exists(spark, f"{place}/ingest-report.json"):
            return place
    raise FileNotFoundError(f"{path} has no ingest report")


def vectors(df: DataFrame, path: str, key: str = "id", rows: int = 250_000) -> int:
    """Append the vectors (key, embedding) whose key is not there yet, in files of at most so many rows; how many were new. A run that was broken off goes on where it stopped."""
    spark = df.sparkSession
    new = df.join(spark.read.parquet(path).select(key), key, "left_anti") if exists(spark, path) else df
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    new.write.option("maxRecordsPerFile", rows).mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def publish(spark: SparkSession, pointer: str, generation: str) -> bool:
    """Point to a finished generation; False if it is the current one already. The last good one stays until then."""
    content = json.dumps({"generation": generation})
    if read_text(spark, pointer) == content:
        return False
    if not exists(spark, generation):
        raise FileNotFoundError(generation)
    write_text(spark, pointer, content)
    return True


def current(spark: SparkSession, pointer: str) -> str | None:
    """The published generation."""
    content = read_text(spark, pointer)
    return json.loads(content)["generation"] if content else None


def cache_path(root: str, config: dict) -> str:
    """Where the result of a configuration lies: equal configurations share it."""
    return f"{root}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Write, read back and compare all rows; any difference is an error."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if not relational.same_rows(df, back):
        raise OSError(f"{path} does not hold what was written")
    return back


def run_file(ranked: DataFrame, path: str) -> None:
    """Ranked results as JSON lines: query_id, hits, scores."""
    row = F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("hit"), F.col("score").cast("float").alias("score"))))
    runs = ranked.groupBy("query_id").agg(row.alias("r")).select("query_id", F.transform("r", lambda x: x["hit"]).alias("hits"), F.transform("r", lambda x: x["score"]).alias("scores"))
    runs.write.mode("errorifexists").json(path)
