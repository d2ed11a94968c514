"""Registered queries over joins, sets, windows and the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import chunking, evaluation, retrieval
from scholia.operators import relational as R
from scholia.session import share_code
from scholia.streaming.ingest import windowed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return add


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber > 1 THEN l_returnflag END, o_orderpriority) AS flag, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey")
def metadata_left_join_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their metadata; the row's own value first."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("flag"))
    meta = read(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("flag"), "o_orderstatus")
    return R.enrich(rows, meta, "key", ["flag", "o_orderstatus"]).withColumnRenamed("key", "l_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def last_metadata_wins(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the last."""
    return R.last_per_key(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", [F.col("o_orderkey")])


@query("SELECT source, arg_min(doc_id, struct_pack(n := n_chars, d := doc_id)) AS doc_id FROM documents GROUP BY source")
def first_key_wins(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, the first in a stated order."""
    return R.first_per_key(read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.col("n_chars"), F.col("doc_id")]).select("source", "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """What is still to do."""
    return R.outstanding(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were never ordered in large numbers."""
    return R.difference(read(spark, d, "part").select(F.col("p_partkey").alias("k")), read(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS query_id FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20 GROUP BY o_custkey HAVING count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def intersect_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that every run and the question set have: order states stand for runs, customers for questions."""
    runs = read(spark, d, "orders").select(F.col("o_orderstatus").alias("system"), F.col("o_custkey").cast("string").alias("query_id"))
    return evaluation.intersect_queries(runs, read(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").cast("string").alias("query_id")))


@query("SELECT 'a' AS origin, r_name AS name FROM region UNION ALL SELECT 'b', n_name FROM nation")
def union_roots(spark: SparkSession, d: str) -> DataFrame:
    """Two roots as one, with labels."""
    a = read(spark, d, "region").select(F.lit("a").alias("origin"), F.col("r_name").alias("name"))
    b = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("b").alias("origin"))
    return R.union_all([a, b])


@query("SELECT a.conv_id, a.turn AS of_turn, b.turn, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'assistant'")
def passage_context(spark: SparkSession, d: str) -> DataFrame:
    """Each wanted passage with its neighbours."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("article_key"), F.col("turn").alias("chunk_index"), "role", "text")
    near = retrieval.neighbours(c.drop("role"), c.where("role = 'assistant'").select("article_key", "chunk_index"), 1, 1)
    return near.select(F.col("article_key").alias("conv_id"), F.col("of_index").alias("of_turn"), F.col("chunk_index").alias("turn"), "text")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM conversations")
def prefix_sum_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each turn begins in its conversation."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return R.prefix_sums(c, "conv_id", "turn", "n").select("conv_id", "turn", "begin")


@query("SELECT conv_id, CAST(unnest(range(len(t))) AS INTEGER) AS place, unnest(t) AS turn, unnest(r) AS role FROM (SELECT conv_id, list(turn ORDER BY turn) AS t, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)")
def zip_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two lists by place."""
    pairs = F.array_sort(F.collect_list(F.struct("turn", "role")))
    g = read(spark, d, "conversations").groupBy("conv_id").agg(pairs.alias("p")).select("conv_id", F.transform("p", lambda x: x["turn"]).alias("turn"), F.transform("p", lambda x: x["role"]).alias("role"))
    return R.zip_by_position(g, "turn", "role")


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index, CAST(conv_id AS VARCHAR) || '#' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR), 4, '0') AS chunk_id FROM conversations")
def running_index(spark: SparkSession, d: str) -> DataFrame:
    """A running number within a group."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("article_key"), "conv_id", "turn", "role")
    return chunking.numbered(c, "turn").select("conv_id", "turn", "role", "chunk_index", "chunk_id")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A grouped report over the largest table."""
    l = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A five-way join, in any order that the optimizer likes."""
    j = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows, as the streaming variant computes them."""
    return windowed(read(spark, d, "events"), "1 day", None).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
