"""Incremental ingest and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia import schemas
from scholia.sources.readers import works_digest


def ingest_works(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Digest the raw work files that have arrived since the last call; the checkpoint knows the files that are done."""
    schema = schemas.RAW_WORK + ", malformed string"
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").option("columnNameOfCorruptRecord", "malformed").json(folder)
    return works_digest(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 day", late: str | None = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by type in tumbling (or sliding) windows; state older than the lateness is dropped. late is None if the events have a watermark already. Works on streams and tables."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once_each(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, within the lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
