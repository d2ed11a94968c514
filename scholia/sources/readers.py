"""Readers with explicit schemas; none infers, and each says what an invalid row becomes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia import schemas
from scholia.functions import text
from scholia.operators import relational
from scholia.sources import sinks

SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
RESERVED = frozenset({"health"})


def parquet(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Parquet files of a glob with a fixed schema; columns that aren't asked for are not read. A glob without files is an error."""
    return spark.read.schema(schema).parquet(*files(spark, pattern))


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a pattern in the order of their names' code points; only the name, not the folder, may hold a star; none is an error."""
    folder, _, name = pattern.rpartition("/")
    if "*" in folder:
        raise ValueError(f"a star in a folder's name: {pattern}")
    fs, p = sinks._fs(spark, pattern)
    found = sorted(s.getPath().toString() for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found


def texts(spark: SparkSession, pattern: str, id_column: str, text_column: str, title_column: str | None = None) -> DataFrame:
    """(id, text) with the title before the text if there is one; rows without id or text are left out."""
    df = spark.read.parquet(pattern)
    body = text.blank_to_null(F.col(text_column))
    whole = F.concat_ws(". ", text.blank_to_null(F.col(title_column)), body) if title_column else body
    return df.where(F.col(id_column).isNotNull() & body.isNotNull()).select(F.col(id_column).cast("string").alias("id"), whole.alias("text"))


def jats_metadata(articles: DataFrame) -> DataFrame:
    """One row of metadata per article key, the last path winning."""
    return relational.last_per_key(articles.where("article_key IS NOT NULL").select("article_key", "source_path", "pmcid", "pmid", "doi", "journal", "issn_electronic", "issn_print", "publisher", "article_type", "pub_year", "pub_month", "pub_day", "license_url", "authors", "keywords", F.col("title").alias("meta_title")), "article_key", [F.col("source_path")])


def _indexable(df: DataFrame, **columns: object) -> DataFrame:
    kinds = dict(c.strip().split() for c in schemas.INDEXABLE.replace("\n", " ").split(","))
    return df.select(*((columns[n] if n in columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def abstract_articles(abstracts: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Index rows of the abstract tier. A row needs an abstract, or metadata and a title; its own values go before the metadata's."""
    d = abstracts.withColumnRenamed("openalex_id", "article_key")
    if metadata is None:
        d = d.withColumns({c: F.lit(None).cast("string") for c in ("journal", "issn_electronic", "issn_print", "publisher", "authors", "keywords", "meta_title")} | {"known": F.lit(False)})
    else:
        m = metadata.select("article_key", "journal", "issn_electronic", "issn_print", "publisher", "authors", "keywords", "meta_title", F.col("doi").alias("m_doi"), F.col("pmid").alias("m_pmid"), F.col("pmcid").alias("m_pmcid"), F.col("pub_year").alias("m_year"), F.lit(True).alias("known"))
        d = d.join(relational.bounded(m), "article_key", "left")
        d = d.withColumns({"doi": F.coalesce("doi", "m_doi"), "pmid": F.coalesce("pmid", "m_pmid"), "pmcid": F.coalesce("pmcid", "m_pmcid"), "publication_year": F.coalesce("publication_year", "m_year"), "known": F.coalesce("known", F.lit(False))})
    has = text.blank_to_null(F.col("abstract")).isNotNull()
    d = d.where(F.col("article_key").isNotNull() & (has | (F.col("known") & text.blank_to_null(F.coalesce("title", "meta_title")).isNotNull())))
    c = F.col
    counted = F.greatest(F.lit(0), F.least(F.lit(2**31 - 1), F.coalesce(c("cited_by_count"), F.lit(0))))
    return _indexable(d, id=c("article_key"), article_key=c("article_key"), title=F.coalesce("title", "meta_title"), body=c("abstract"), doi=c("doi"), pmcid=c("pmcid"), pmid=c("pmid"), issn=F.coalesce("issn_electronic", "issn_print"), authors=c("authors"), journal=F.coalesce("journal", "primary_source_name"), publisher=c("publisher"), keywords=c("keywords"), year=c("publication_year"), work_type=c("work_type"), citations=counted, is_retracted=F.lit(False), is_oa=c("is_oa"))


def work_articles(works: DataFrame) -> DataFrame:
    """Index rows of the works digest; a row needs a title or an abstract."""
    c = F.col
    d = works.where(text.blank_to_null(c("title")).isNotNull() | text.blank_to_null(c("abstract")).isNotNull())
    return _indexable(d, id=c("openalex_id"), article_key=c("openalex_id"), title=c("title"), body=c("abstract"), doi=c("doi"), pmid=c("pmid"), issn=c("issn"), authors=c("authors"), institutions=c("institutions"), journal=c("journal"), topics=c("topics"), keywords=c("keywords"), year=c("publication_year"), work_type=F.lower(c("type")), citations=c("cited_by_count"), is_retracted=c("is_retracted"))


def chunk_articles(chunks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Index rows of passages, with their article's metadata; a passage without article stands for itself."""
    d = chunks
    if metadata is not None:
        d = d.join(relational.bounded(metadata.select("article_key", "authors", "journal", "publisher", "doi", "pmid", "pmcid", "keywords")), "article_key", "left")
    else:
        d = d.withColumns({n: F.lit(None).cast("string") for n in ("authors", "journal", "publisher", "doi", "pmid", "pmcid", "keywords")})
    c = F.col
    return _indexable(d, id=c("chunk_id"), article_key=F.coalesce("article_key", "chunk_id"), title=c("title"), body=c("text"), doi=c("doi"), pmid=c("pmid"), pmcid=c("pmcid"), authors=c("authors"), journal=c("journal"), publisher=c("publisher"), keywords=c("keywords"), year=c("pub_year"), section=F.lower(c("section_kind")), citations=F.lit(0), is_retracted=c("is_retracted"))


def in_years(rows: DataFrame, low: int | None = None, high: int | None = None, year: str = "pub_year") -> DataFrame:
    """Rows of a range of years; with any bound given, a row without year is out."""
    if low is None and high is None:
        return rows
    own = F.col(year)
    return rows.where(own.isNotNull() & (own >= low if low is not None else F.lit(True)) & (own <= high if high is not None else F.lit(True)))


#: Names of files whose stem is the end of a DOI, and what stands before it.
STORE_FILE, STORE_PREFIX = r"^neco_[ace]_[0-9]{5}\.pdf$", "10.1162/"


def store_enriched(articles: DataFrame, checkpoints: DataFrame, journals: list[str]) -> DataFrame:
    """Articles of one store: a missing journal is the store's, if it names one only ("unknown" is none); a missing DOI comes from the checkpoint's file name, if that is of the known form. checkpoints: paper_key, filename."""
    named = sorted({j for j in journals if j.strip() and j.lower() != "unknown"})
    files = checkpoints.select(F.col("paper_key").alias("key_"), F.col("filename").alias("file_"))
    doi = F.when(F.regexp_like("file_", F.lit(STORE_FILE)), F.concat(F.lit(STORE_PREFIX), F.regexp_replace("file_", r"\.pdf$", "")))
    out = articles.join(relational.bounded(files), F.col("article_key") == F.col("key_"), "left")
    out = out.withColumns({"doi": F.coalesce("doi", doi), "journal": F.coalesce("journal", F.lit(named[0] if len(named) == 1 else None).cast("string"))})
    return out.drop("key_", "file_")


def keep_ingested(articles: DataFrame, abstract_tier: bool = False) -> DataFrame:
    """Articles with a body, or with an abstract where those are wanted."""
    has = F.coalesce("has_body", F.lit(False))
    return articles.where(has | (text.blank_to_null(F.col("abstract")).isNotNull()) if abstract_tier else has)


def done_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of text files ids-part-*.txt, one a line; none if there is no file yet."""
    fs, p = sinks._fs(spark, f"{folder}/ids-part-*.txt")
    if not len(fs.globStatus(p) or []):
        return spark.createDataFrame([], "id string")
    return spark.read.text(f"{folder}/ids-part-*.txt").select(F.trim("value").alias("id")).where("id <> ''").distinct()


def raw_works(spark: SparkSession, folder: str, skip_broken_files: bool = True) -> DataFrame:
    """Gzip JSON lines of a folder and those below it; a malformed line keeps its text in ``malformed``. A file that can't be decompressed gives the lines before the fault (broken_files() names it)."""
    schema = schemas.RAW_WORK + ", malformed string"
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").option("ignoreCorruptFiles", skip_broken_files).json(folder)


def broken_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, error) of gzip files that can't be read to their end; bytes are decompressed in pieces and not kept."""

    def run(batches):
        import gzip
        import io

        for pdf in batches:
            errors = []
            for content in pdf["content"]:
                try:
                    with gzip.open(io.BytesIO(content)) as f:
                        while f.read(1 << 20):
                            pass
                    errors.append(None)
                except (OSError, EOFError, ValueError) as e:
                    errors.append(str(e) or type(e).__name__)
            yield pdf[["path"]].assign(error=errors)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, error string").where("error IS NOT NULL")


def works_digest(raw: DataFrame) -> DataFrame:
    """The flat digest of raw works that have an id and a text."""
    names = lambda arr: text.join_distinct(F.transform(arr, lambda x: x["display_name"]))
    abstract = text.inverted_index_text(F.col("abstract_inverted_index"))
    flat = raw.where("malformed IS NULL").select(
        F.col("id").alias("openalex_id"), F.coalesce("title", "display_name").alias("title"), abstract.alias("abstract"), "publication_date", "publication_year", F.col("ids.pmid").alias("pmid"), "doi",
        text.join_distinct(F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], a["raw_author_name"]))).alias("authors"),
        names(F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>"))))).alias("institutions"),
        F.coalesce("primary_location.source.display_name", "primary_location.raw_source_name").alias("journal"), F.col("primary_location.source.issn_l").alias("issn"), "language", "type",
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), "biblio.*", names(F.col("topics")).alias("topics"), names(F.col("keywords")).alias("keywords"), F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
    )
    return flat.where(text.blank_to_null(F.col("openalex_id")).isNotNull() & (text.blank_to_null(F.col("title")).isNotNull() | text.blank_to_null(F.col("abstract")).isNotNull()))


def reject_counts(raw: DataFrame) -> DataFrame:
    """How many raw works were malformed, without id, or without text."""
    blank = lambda c: text.blank_to_null(c).isNull()
    empty = blank(F.coalesce("title", "display_name")) & F.coalesce(F.size("abstract_inverted_index") <= 0, F.lit(True))
    return raw.agg(F.count("*").alias("lines"), F.count_if(F.col("malformed").isNotNull()).alias("malformed"), F.count_if(F.col("malformed").isNull() & blank(F.col("id"))).alias("no_id"), F.count_if(F.col("malformed").isNull() & ~blank(F.col("id")) & empty).alias("no_text"))


def xml_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(path, content, source_corpus) of XML files below labelled folders."""
    one = lambda label, folder: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder).select("path", "content", F.lit(label).alias("source_corpus"))
    return relational.union_all([one(label, folder) for label, folder in roots.items()])


def pds_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, path) of JSON lines {"key": ..., "value": {...}}; the value stays text. Keys are in order."""
    raw = spark.read.text(path).select(F.from_json("value", "key string, value string").alias("r"), F.col("_metadata.file_path").alias("path"))
    return raw.select("r.key", "r.value", "path").where("key IS NOT NULL").orderBy("key")


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A question set: ids are unique, ids and texts are not blank, and there is one at least; anything else is an error."""
    q = spark.read.schema(schemas.QUESTIONS).json(path)
    bad = q.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.count_if(text.blank_to_null(F.col("query_id")).isNull() | text.blank_to_null(F.col("query_text")).isNull()).alias("blank")).first()
    if not bad.n or bad.blank or bad.ids != bad.n:
        raise ValueError(f"{path}: {bad.n} questions, {bad.ids} ids, {bad.blank} blank")
    return q.limit(limit) if limit else q


def allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Work ids of a text file, one a line, in canonical form and each once; a bad line or an empty list is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").select("line", text.normalise_work_id(F.col("line")).alias("article_key"))
    bad = lines.where("article_key IS NULL").first()
    if bad:
        with_number = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
        number = with_number.where(F.trim("line") == bad.line).agg(F.min("n")).first()[0]
        raise ValueError(f"{path}:{number + 1}: no work id: {bad.line}")
    ids = lines.select("article_key").distinct()
    if ids.isEmpty():
        raise ValueError(f"{path}: no ids")
    return ids


@dataclass(frozen=True)
class Collection:
    """A named collection and where its parts lie."""

    name: str
    path: str


def collections(config: str) -> list[Collection]:
    """Collections of a JSON list; unknown members, doubled or reserved names, and paths that leave the root are errors."""
    out: list[Collection] = []
    for item in json.loads(config):
        if set(item) != {"name", "path"}:
            raise ValueError(f"members must be name and path: {sorted(item)}")
        name, path = item["name"], item["path"]
        if not SLUG.fullmatch(name) or name in RESERVED or any(c.name == name for c in out):
            raise ValueError(f"bad name: {name}")
        if path.startswith("/") or ".." in path.split("/") or re.search(r"[\\:*?\"<>|]", path):
            raise ValueError(f"bad path: {path}")
        out.append(Collection(name, path))
    return out
