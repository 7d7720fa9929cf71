"""The event log as a stream.

It writes one folder for each micro-batch, named by the batch, and overwrites it when a batch is run again: a query that
restarts from its checkpoint loses and repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import events
from ..sources.readers import EVENT


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder of JSON-lines files as a stream; lines that are not objects are skipped."""
    reader = spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED")
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path).where("type is not null")


def _earlier(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame:
    """What batches before this one wrote below ``path``."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < batch)


def _last(spark: SparkSession, path: str, batch: int) -> int:
    """The largest number before this batch: noted by the batch before; all batches are read only where that note is not there."""
    note = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_last/{batch - 1}/_SUCCESS")
    if note.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(note):
        return spark.read.schema("last bigint").parquet(f"{path}/_last/{batch - 1}").first()[0]
    return _earlier(spark, path, batch, "seq bigint, batch bigint").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def append_sequenced(stream: DataFrame, order: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends events below ``path`` with ``seq`` going on from the batches before, without gaps, in order of ``order``."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = _last(spark, path, batch)
        events.sequenced(rows.drop("seq"), order, start=last).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        own = spark.read.schema("seq bigint").parquet(f"{path}/batch={batch}").agg(F.coalesce(F.max("seq"), F.lit(last)).alias("last"))
        own.write.mode("overwrite").parquet(f"{path}/_last/{batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
