"""A Spark session with this engine's settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but lies on a path that they see."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def build_session(app: str = "scholia", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Adaptive execution on, UTC; partition counts are left to the cluster unless given."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
