"""Connected components by alternating stars, in joins and partial sums only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import cut, spread_join


#: Up to so many edges (32 bytes each) one task joins sets; more of them go through the stars.
LOCAL_EDGES = 200_000


def _joined_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of a bounded number of edges, by union of sets."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"], pdf["v"]):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame([(x, root(x)) for x in list(up)], columns=["node", "component"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 50, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of the nodes of edges (u, v); a component is named after its least node.

    Each round a node's larger neighbours, then its smaller ones, move to its least neighbour
    (large star, small star). Minima are partial sums, and no node's neighbours are gathered,
    and the joins deal a node of many edges over several tasks.
    """
    spark = edges.sparkSession
    e = cut(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = _mark(e)
    if last[0] <= local_edges:
        kind = e.schema["u"].dataType.simpleString()
        return cut(spark, e.coalesce(1).mapInPandas(_joined_sets, f"node {kind}, component {kind}"), "components")
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = cut(spark, e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(spark, large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(spark, small.where("u <> v").distinct(), "edges")
        now = _mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
