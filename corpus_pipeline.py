"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents`` (the last: the packed pieces). ``run`` writes each stage's rows as Parquet to the
shared folder and reads them as the next one's documents.

What a stage does with odd rows: quality rules drop null, empty and blank texts with all others
that fail; of a class of near-duplicates the row with the least doc_id stays, one of them if rows
repeat it; decontamination cuts benchmark passages out of a text and drops a document of which
more than half is benchmark; personal data is replaced by its kind, and no row goes; packing
gives every id one place. Texts of any length go through whole. A null doc_id is kept until the
end. Other columns of the documents, whatever their names, are kept up to packing. An empty table
passes every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import decontaminate, neardup, packing, pii, quality
from scholia.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages: the spans are cut out, and a document that is mostly benchmark goes."""
    return decontaminate.remove(spark, docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can't tokenize or sample shingles: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
