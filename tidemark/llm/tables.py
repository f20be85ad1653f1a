"""Where intermediate tables go, how joins meet hot keys, and what a task's Python keeps."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a key with more than this share of a table's rows is hot; there are at most 1 / HOT of them
HOT = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the program set as its checkpoint directory.

    Where there is neither, a session on this machine alone gets one beside its warehouse; a cluster's is an error, since
    each executor would write its part to a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints")
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled_to(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_rows(df: DataFrame) -> DataFrame:
    """_doc: every row as one struct, whatever its columns are called."""
    return df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("_doc"))


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Whole texts reach Python in Arrow batches of at most so many bytes (or one row), whatever their number."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def trim() -> None:
    """Gives memory that is no longer in use back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work for mapInArrow; a worker that Spark keeps for its next task gives back what this one's arrays held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        trim()

    return run


def looked_up(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None = None, spread: Column | None = None) -> DataFrame:
    """rows left-joined with facts, which has one row per key; null keys meet nothing.

    A key that holds more than HOT of all rows would land in one task. There are at most 1 / HOT such keys, whatever the tables'
    sizes: their facts go to all tasks, and their rows, like those without a key, are dealt out by `spread` instead of the key.

    hot: the hot keys, where they are known from counts taken before; else rows are counted by key, and `rows`, which is then read twice,
    had better be a written table. spread: a number by which rows differ; a hash of all columns if not given.
    """
    if hot is None:
        most = HOT * rows.count()
        hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key)
    names = [c for c in facts.columns if c != key]
    of_hot = facts.join(F.broadcast(hot), key).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    rows_ = rows.join(F.broadcast(of_hot), F.col(key) == F.col("_hot"), "left")
    away = F.xxhash64(*[F.col(c) for c in rows.columns]) if spread is None else spread
    rows_ = rows_.withColumn("_salt", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.pmod(away, F.lit(1 << 20)) + 1))
    cold = facts.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_zero"), *[F.col(c).alias(f"_cold_{c}") for c in names]).hint("merge")
    met = rows_.join(cold, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return met.select(*rows.columns, *[F.coalesce(f"_cold_{c}", f"_hot_{c}").alias(c) for c in names])
