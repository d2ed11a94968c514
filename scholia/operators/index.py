"""The fielded index as tables: postings with their weights, and statistics of terms and fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import scoring
from scholia.functions.analysis import analyze_column, plain_tokens
from scholia.functions.text import blank_to_null


def field_texts() -> dict[str, Column]:
    """The searchable fields of a row of schemas.INDEXABLE; composites are joined by ``. ``."""
    join = lambda *names: F.concat_ws(". ", *(blank_to_null(F.col(n)) for n in names))
    return {"identifiers": join("doi", "pmcid", "issn", "pmid"), "title": F.col("title"), "authors": F.col("authors"), "venue": join("journal", "publisher"), "body": F.col("body"), "institutions": F.col("institutions"), "topics": join("topics", "keywords")}


#: Query terms up to so many rows are broadcast; a larger batch is joined by shuffle.
BROADCAST_TERMS = 100_000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """docs: the stored rows. fields: field, n, mean. An index that was built holds tokens (field, id, tokens), from which postings are made for the terms that are asked for, and the same as columns of docs by field (analysed); one that was saved holds all postings and terms by bucket."""

    docs: DataFrame
    fields: DataFrame
    stemmed: bool
    tokens: DataFrame | None = None
    saved_postings: DataFrame | None = None
    saved_terms: DataFrame | None = None
    buckets: int = 0
    analysed: dict[str, Column] | None = None

    @property
    def postings(self) -> DataFrame:
        """field, term, id, tf, length, weight (BM25 without boost) of all terms."""
        return self.saved_postings.drop("bucket") if self.saved_postings is not None else self._weighed(self._counts())

    @property
    def terms(self) -> DataFrame:
        """field, term, df of all terms."""
        if self.saved_terms is not None:
            return self.saved_terms
        once = self.tokens.select("field", F.explode(F.array_distinct("tokens")).alias("term"))
        return once.groupBy("field", "term").agg(F.count("*").alias("df"))

    def _counts(self, only: DataFrame | None = None) -> DataFrame:
        hits = self.tokens.select("field", "id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        if only is not None:
            hits = hits.join(only, "term", "left_semi")
        return hits.groupBy("field", "term", "id", "length").agg(F.count("*").alias("tf"))

    def _weighed(self, counts: DataFrame) -> DataFrame:
        # counting by tf keeps this side's aggregation equal to the other's, so that Spark reuses it
        df = counts.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
        weight = scoring.idf(F.col("n"), F.col("df")) * scoring.tf_weight(F.col("tf"), F.col("length"), F.col("mean"))
        return counts.join(df, ["field", "term"]).join(F.broadcast(self.fields), "field").select("field", "term", "id", "tf", "length", weight.alias("weight"))

    def lookup(self, terms: DataFrame) -> DataFrame:
        """The postings of terms (a column ``term``, and others that are kept). The terms go below the aggregation of tokens, or choose the buckets of a saved index that are read."""
        hint = lambda n: F.broadcast if n <= BROADCAST_TERMS else (lambda x: x)
        if self.saved_postings is None:
            mark = hint(terms.limit(BROADCAST_TERMS + 1).count())
            return self._weighed(self._counts(mark(terms.select("term").distinct()))).join(mark(terms), "term")
        # the numbers of the buckets, of which there are few, become a filter on folders
        terms = terms.withColumn("bucket", _bucket(self.buckets))
        found = terms.agg(F.count("*").alias("n"), F.collect_set("bucket").alias("b")).first()
        return self.saved_postings.where(F.col("bucket").isin(found.b)).join(hint(found.n)(terms), ["bucket", "term"]).drop("bucket")

    def save(self, path: str, buckets: int = 64) -> None:
        """Write the tables; postings lie by hash of the term, sorted, so that a query reads few folders and row groups."""
        self.docs.write.parquet(f"{path}/docs")
        self.postings.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("term", "field", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        self.terms.write.parquet(f"{path}/terms")
        self.fields.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/fields")

    @staticmethod
    def load(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        fields = read("fields")
        row = fields.select("buckets").first()
        return Index(read("docs"), fields.drop("buckets"), stemmed, None, read("postings"), read("terms"), row.buckets if row else 1)


def usable(docs: DataFrame, require_body: bool = False) -> DataFrame:
    """Rows that can be found: with a title or body, or with a body."""
    body = blank_to_null(F.col("body")).isNotNull()
    return docs.where(body if require_body else body | blank_to_null(F.col("title")).isNotNull())


def build(docs: DataFrame, stemmed: bool = True, fields: dict[str, Column] | None = None, require_body: bool = False) -> Index:
    """Index the usable rows of schemas.INDEXABLE (or any rows with an id, with fields given).

    Nothing runs here. The number of documents counts all rows, also those without the field;
    the statistics of fields are a handful of rows, which are broadcast.
    """
    if fields is None:
        docs, fields = usable(docs, require_body), field_texts()
    analyse = analyze_column if stemmed else plain_tokens
    texts = docs.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in fields.items()))).alias("f")).select("id", "f.*")
    tokens = texts.select("field", "id", analyse(F.col("text")).alias("tokens"))
    stats = tokens.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))
    stats = stats.where("total > 0").select("field", "n", (F.col("total") / F.col("n")).alias("mean"))
    return Index(docs, stats, stemmed, tokens.where("size(tokens) > 0"), analysed={f: analyse(c) for f, c in fields.items()})
