"""Vector columns: pooling, normalisation, similarity, all on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def norm(v: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of each group's vectors, element by element."""
    parts = vectors.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select(group, F.transform("p", lambda e: e["x"]).alias(vector))


def cosine_top(vectors: DataFrame, ids: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows most like one query vector."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(ids, (dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q))).alias("cosine")).orderBy(F.desc("cosine"), ids).limit(k)


def fuse(ranked: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists."""
    every = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
