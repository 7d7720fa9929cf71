"""What the operators of this subpackage share: table access, checkpoints, folders that all executors see."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, cut, shuffles_dropped

__all__ = ["checkpoint_dir", "cut", "fresh", "lower_ascii", "partitions", "remove", "scratch", "shared_folder", "shuffles_dropped", "table", "tidy", "without_rows"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped before
        remove(spark, path)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which outlives any executor and is removed when the driver's program ends."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(_remove_late, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of two numbers that may be broadcast.
BROADCAST_ROWS = 200_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, like the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``gone`` (doc_id, own: the text's xxhash64), which is counted
    first: few of them are broadcast, of more both sides are shuffled."""
    i, h, gi, gh = fresh(docs, "id", "own", "gone_id", "gone_own")
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64(F.col("text").cast("string"))})
    gone = gone.select(F.col("doc_id").alias(gi), F.col("own").alias(gh))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, F.col(i).eqNullSafe(F.col(gi)) & (F.col(h) == F.col(gh)), "left_anti").drop(i, h)


def tidy(run: Callable) -> Callable:
    """``run`` over batches, after which the worker, which is kept for other tasks, gives its free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
