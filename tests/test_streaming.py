import gzip
import json

from pyspark.sql import functions as F

from scholia.sources import readers
from scholia.streaming import ingest


def work(i, **more):
    return json.dumps({"id": f"W{i}", "title": f"T{i}", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "Ann"}, "institutions": [{"display_name": "X"}, {"display_name": "x"}]}, {"raw_author_name": "Bob"}], **more})


def test_incremental_digest(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    (src / "deep").mkdir(parents=True)
    with gzip.open(src / "a.gz", "wt") as f:
        f.write(work(1) + "\n{broken\n" + json.dumps({"id": "W9"}) + "\n" + json.dumps({"title": "x"}))
    ingest.ingest_works(spark, str(src), str(out), str(mark)).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert [(r.openalex_id, r.abstract, r.authors, r.institutions, r.cited_by_count) for r in rows] == [("W1", "a b", "Ann; Bob", "X", 0)]
    counts = readers.reject_counts(readers.raw_works(spark, str(src)).cache()).first()
    assert (counts.lines, counts.malformed, counts.no_id, counts.no_text) == (4, 1, 1, 1)
    with gzip.open(src / "deep" / "b.gz", "wt") as f:
        f.write(work(2))
    ingest.ingest_works(spark, str(src), str(out), str(mark)).awaitTermination()
    assert sorted(r.openalex_id for r in spark.read.parquet(str(out)).collect()) == ["W1", "W2"]


def test_windows_on_stream_and_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "e"))
    table = {tuple(r)[:2]: r.n for r in ingest.windowed(e).collect()}
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = ingest.windowed(ingest.once_each(s, "event_id"), late=None).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r)[:2]: r.n for r in spark.table("w").collect()}
    assert got and all(table[k] == n for k, n in got.items())
