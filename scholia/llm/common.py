"""What the operators of this package share: tables, the shared folder, batch mapping."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but lies on a path that they see."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only a master on one machine may do without that setting. The folder is deleted when the driver's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "scholia-shared")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_made)
    _made[path] = spark
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_dir()."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def remove_made() -> None:
    """Delete all folders that shared_dir() has made, which no result is read from any more; where the JVM is gone they stay."""
    for path, spark in list(_made.items()):
        try:
            remove_dir(spark, path)
        except Exception:  # the process is ending, and there is no one left to tell
            return


def cut(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    ready(spark)
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more rows than this are dealt over several tasks.
HOT_ROWS = 10_000
#: At most so many keys are dealt so, which bounds the broadcast of them.
MOST_HOT = 100_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(key, pieces_) of the keys that hold more than hot_rows rows, MOST_HOT of them at most; None if there are none."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_")).where(F.col("n_") > hot_rows)
    top = [r.n_ for r in sizes.orderBy(F.desc("n_")).limit(MOST_HOT + 1).select("n_").collect()]
    if not top:
        return None
    least = max(hot_rows, top[MOST_HOT] if len(top) > MOST_HOT else 0)
    return F.broadcast(sizes.where(F.col("n_") > least).select(key, F.ceil(F.col("n_") / least).cast("int").alias("pieces_")))


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left with the one row that right has for each key; a hot key's rows are dealt over tasks by a salt, and its row of right is repeated for each."""
    if hot is None:
        return left.join(right, key, how)
    dealt = left.join(hot, key, "left").withColumn("salt_", F.when(F.col("pieces_").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(f"`{c}`" for c in left.columns)), "pieces_")).cast("int")).drop("pieces_")
    again = right.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("pieces_", F.lit(1)) - 1))).drop("pieces_")
    return dealt.join(again, [key, "salt_"], how).drop("salt_")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """dealt_join() by the hot keys of left, which is read twice, so it should lie in a table."""
    return dealt_join(left, right, key, hot_keys(left, key, hot_rows), how)


#: Columns of packed arrays.
PACKED = "packed binary, filled int"


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """An array's bytes and -1; of a mostly empty one the places and values that are not 0, and how many they are."""
    at = np.flatnonzero(x)
    if len(at) * (4 + x.itemsize) < x.nbytes:
        return at.astype(np.uint32).tobytes() + x[at].tobytes(), len(at)
    return x.tobytes(), -1


def packed_batch(x: np.ndarray) -> pa.RecordBatch:
    """One row of PACKED."""
    raw, filled = packed(x)
    return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([filled], pa.int32())], ["packed", "filled"])


def _add_packed(total: np.ndarray, raw: pa.Buffer, filled: int) -> None:
    if filled < 0:
        total += np.frombuffer(raw, total.dtype)
    else:  # places are distinct
        total[np.frombuffer(raw, np.uint32, filled)] += np.frombuffer(raw, np.uint8)[4 * filled :].copy().view(total.dtype)


def tree_sum(parts: DataFrame, size: int, kind: type = np.float64, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x, fan: int = 4) -> np.ndarray | None:
    """finish() of the sum of the arrays (of that size and kind) in all rows of PACKED. They are added in a tree of groups of fan tasks' arrays, so that none holds more than a few; only the end's result comes to the driver. None without rows."""
    ready(parts.sparkSession)

    def adding(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            total = np.zeros(size, kind)
            for raw, filled in zip(table.column("packed"), table.column("filled").to_pylist()):
                _add_packed(total, raw.as_buffer(), filled)
            out = finish(total) if last else total
            raw, filled = (out.tobytes(), -1) if last else packed(out)
            return pa.table({"k": table.column("k").slice(0, 1), "packed": pa.array([raw], pa.binary()), "filled": pa.array([filled], pa.int32()), "kind": pa.array([out.dtype.str], pa.string())})

        return run

    rows, n = parts.select(F.spark_partition_id().cast("long").alias("k"), "packed", "filled"), parts.rdd.getNumPartitions()
    while True:
        n = partitions(n, fan)
        rows = rows.select((F.col("k") % n).alias("k"), "packed", "filled").groupBy("k").applyInArrow(adding(n == 1), f"k long, {PACKED}, kind string")
        if n == 1:
            break
    got = rows.collect()
    return np.frombuffer(got[0].packed, got[0].kind) if got else None


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches; it never sees more than one batch."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out
                out = None
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what freed arrays took to the machine: a worker lives on for the next tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def remainder(col: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("null")).cast("binary")) % n


def thinned(df: DataFrame, key: str, rows: int, margin: int = 4) -> DataFrame:
    """About margin * rows of many rows, those of the least hashes of key, so that a bounded sample of them passes through one task whatever their number; all of few rows."""
    n = df.count()
    if n <= margin * rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * margin * rows / n))


def partitions(rows: int, per: int) -> int:
    """So many partitions that each holds about per rows."""
    return max(1, -(-rows // per))
