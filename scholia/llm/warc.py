"""WARC archives: records of pages, and a reader that verifies the chain of record boundaries.

Writing: Spark's text writer puts one record after another (its line separator is the last
CRLF of a record), so that archives can lie in any store that Spark writes to. Records with
equal payloads of ``REVISIT_BYTES`` or more have one response, that of the largest page_id;
the others are revisits without payload.

Reading: the archive is split at every ``WARC/1.0`` line, wherever it stands, so a payload
that holds one yields false candidates. Each candidate names its successor's offset (its own
plus header and Content-Length). Only candidates that the chain from the file's start reaches
are records: within blocks of ``CHAIN_BYTES`` by pointer jumping in numpy, between blocks by
pointer jumping over the blocks' entries and exits. A record whose payload holds the magic is
put together from its pieces.

Edge cases: a null html is an empty payload; a null url leaves the target empty, line ends in
it are escaped; a null page_id comes back as null and is never a response to others; rows that
repeat one page_id are each a record, and all of the largest one are responses; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import cut, remove_dir, shared_dir

MAGIC = "WARC/1.0\r\n"
REVISIT_BYTES = 1000
CHAIN_BYTES = 64 << 20
#: Lists up to so many rows (about 60 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_ROWS = 100_000
RECORDS_PER_FILE = 100_000
SALTS = 64


def _revisits(pages: DataFrame, broadcast_rows: int) -> DataFrame:
    """Pages with ``first_``, the page that they are copies of (null: none)."""
    big = pages.where(F.col("bytes_") >= REVISIT_BYTES)
    groups = cut(pages.sparkSession, big.groupBy("sha_").agg(F.max("page_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1 AND first_ IS NOT NULL").drop("n_"), "warc-copies")
    if groups.count() <= broadcast_rows:
        return pages.join(F.broadcast(groups), "sha_", "left")
    salted = groups.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt_", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha_", "salt_"], "left")


def write(pages: DataFrame, path: str, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """One record per row of (page_id, url, html) below path."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "%0A").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("bytes_", F.octet_length("html")).withColumn("sha_", F.sha1(F.col("html").cast("binary")))
    p = _revisits(p, broadcast_rows)
    again = F.col("first_").isNotNull() & (F.col("bytes_") >= REVISIT_BYTES) & ~F.coalesce(F.col("page_id") == F.col("first_"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes_").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha_"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first_")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n"),
    )
    p.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _field(head: Column, name: str, value: str) -> Column:
    return F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *{value}", 1)


def _parsed(df: DataFrame) -> DataFrame:
    """Columns that a candidate's text (``value``, after the magic) gives."""
    df = df.withColumn("head_", F.substring_index("value", "\r\n\r\n", 1)).withColumn("head_n", F.octet_length("head_").cast("long"))
    df = df.withColumn("body_n", F.when(F.octet_length("value") > F.col("head_n"), _field(F.col("head_"), "Content-Length", r"([0-9]{1,15})\b").try_cast("long")))
    df = df.withColumn("http_", F.when(_field(F.col("head_"), "Content-Type", "([a-z]+/[a-z]+)") == "application/http", F.substring_index(F.expr("substring(value, char_length(head_) + 5)"), "\r\n\r\n", 1)))
    df = df.withColumn("whole", F.coalesce((F.octet_length("value") == F.col("head_n") + F.col("body_n") + 8) & F.endswith("value", F.lit("\r\n\r\n")), F.lit(False)))
    skip = F.coalesce(F.octet_length("http_") + 4, F.lit(0))
    payload = F.substring(F.col("value").cast("binary"), (F.col("head_n") + 5 + skip).cast("int"), (F.col("body_n") - skip).cast("int"))
    kind = _field(F.col("head_"), "WARC-Type", r"([a-z]+)")
    again = kind == "revisit"
    return df.select(
        *[c for c in df.columns if c not in ("value", "head_", "http_", "head_n", "body_n", "whole")],
        "whole",
        (F.col("head_n") + F.col("body_n") + 8).alias("need"),
        F.octet_length("value").cast("long").alias("seg_n"),
        _field(F.col("head_"), "WARC-Record-ID", r"<urn:page:(-?[0-9]+)>").try_cast("long").alias("page_id"),
        kind.alias("record_type"),
        _field(F.col("head_"), "WARC-Refers-To", r"<urn:page:(-?[0-9]+)>").try_cast("long").alias("refers_to"),
        F.when(again, _field(F.col("http_"), "Content-Length", "([0-9]+)").try_cast("long")).when(F.col("whole"), F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(again, _field(F.col("head_"), "WARC-Payload-Digest", "sha1:([0-9a-f]+)")).when(F.col("whole"), F.sha1(payload)).alias("payload_digest"),
    )


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics, in order of ``seq`` within a file's splits."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))


def _local(start: np.ndarray, succ: np.ndarray, end: int) -> np.ndarray:
    """Number of each candidate's successor within a block; itself where the chain leaves or breaks."""
    at = np.minimum(np.searchsorted(start, succ), len(start) - 1)
    return np.where((start[at] == succ) & (succ < end), at, np.arange(len(start)))


def _exits(chain_bytes: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        start, succ = pdf["start"].to_numpy(), pdf["succ"].fillna(-1).to_numpy(np.int64)
        ptr = _local(start, succ, (key[1] + 1) * chain_bytes)
        while True:
            far = ptr[ptr]
            if (far == ptr).all():
                break
            ptr = far
        return pd.DataFrame({"file": key[0], "start": start, "exit": succ[ptr]})

    return run


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of one file's blocks that its start reaches."""
    pdf = pdf.sort_values("start")
    start = pdf["start"].to_numpy()
    reach = start == 0
    ptr = _local(start, pdf["exit"].to_numpy(), np.iinfo(np.int64).max)
    return pdf.assign(reach=_reached(ptr, reach))[["file", "start", "reach"]]


def _reached(ptr: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """All that the marked ones lead to, by pointer jumping."""
    reach = reach.copy()
    for _ in range(max(1, len(ptr).bit_length())):
        reach[ptr[reach]] = True
        ptr = ptr[ptr]
    return reach


def _mark(chain_bytes: int):
    def run(key: tuple, own: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own.assign(real=pd.Series(dtype=bool))
        own = own.sort_values("start")
        start = own["start"].to_numpy()
        ptr = _local(start, own["succ"].fillna(-1).to_numpy(np.int64), (key[1] + 1) * chain_bytes)
        return own.assign(real=_reached(ptr, np.isin(start, entries["start"].to_numpy())))

    return run


def read(spark: SparkSession, path: str, chain_bytes: int = CHAIN_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The archives' records: page_id, payload_bytes, payload_digest, record_type, refers_to, file, start."""
    seg = cut(spark, _parsed(_segments(spark, path)), "warc-segments")
    m = len(MAGIC)
    splits = seg.groupBy("file", "split").agg(F.sum(F.col("seg_n") + m).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = seg.withColumn("at", F.coalesce(F.sum(F.col("seg_n") + m).over(within), F.lit(0))).join(splits, ["file", "split"])
    cand = placed.withColumn("start", F.col("base") + F.col("at") - m).where("start >= 0").drop("at", "base")
    cand = cand.withColumn("succ", F.col("start") + m + F.col("need")).withColumn("block", F.floor(F.col("start") / chain_bytes).cast("long"))
    cand = cut(spark, cand, "warc-candidates")

    light = cand.select("file", "block", "start", "succ")
    exits = light.groupBy("file", "block").applyInPandas(_exits(chain_bytes), "file string, start long, exit long")
    exits = cut(spark, exits, "warc-exits")
    doors = exits.select("file", F.col("exit").alias("start")).distinct()
    inner = exits.join(doors, ["file", "start"], "left_semi").unionByName(exits.where("start = 0")).distinct()
    entries = inner.groupBy("file").applyInPandas(_entries, "file string, start long, reach boolean").where("reach").withColumn("block", F.floor(F.col("start") / chain_bytes).cast("long"))
    schema = ", ".join(f"{n} {t}" for n, t in cand.dtypes) + ", real boolean"
    marked = cand.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(_mark(chain_bytes), schema)
    marked = cut(spark, marked, "warc-marked")

    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start"]
    done = marked.where("real AND whole").select(out)
    broken = marked.where("real AND NOT whole AND succ IS NOT NULL").select("file", F.col("start").alias("from_"), "succ", F.explode(F.expr(f"sequence(block, (succ - 1) div {chain_bytes})")).alias("block"))
    pieces = cut(spark, broken.join(marked.select("file", "block", "start", "seq", "split", "seg_n"), ["file", "block"]).where("start >= from_ AND start < succ").select("file", "split", "seq", "from_", "start", "seg_n"), "warc-pieces")
    n = pieces.count()
    if not n:
        return done
    pieces = F.broadcast(pieces) if n <= broadcast_rows else pieces
    found = _segments(spark, path).join(pieces, ["file", "split", "seq"])
    same = F.when(F.octet_length("value") == F.col("seg_n"), F.struct("start", "value")).otherwise(F.raise_error(F.lit("the archive was split otherwise than before")))
    joined = found.groupBy("file", "from_").agg(F.array_sort(F.collect_list(same)).alias("p")).select("file", F.col("from_").alias("start"), F.concat_ws(MAGIC, F.transform("p", lambda x: x["value"])).alias("value"))
    rest = cut(spark, _parsed(joined).where("whole").select(out), "warc-joined")
    return reduce(DataFrame.unionByName, [done, rest])


def round_trip(spark: SparkSession, pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write the pages' archives, read them back, and drop them."""
    path = shared_dir(spark, "warc")
    write(pages, path, broadcast_rows)
    out = read(spark, path, broadcast_rows=broadcast_rows)
    remove_dir(spark, path)
    return out
