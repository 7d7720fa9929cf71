"""Figures that come with a write: counted while the rows pass, kept once for each run, with a check that no row is lost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.punctuation import normalize_punctuation

#: Figures of a call, as in ``events.usage_samples``.
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_hit_tokens", "cache_miss_tokens")


def write_calls(calls: DataFrame, path: str, run: str, groups: dict[str, tuple[str, ...]], arrange: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Writes ``calls`` below ``path``/run=``run`` and their figures by the named values of ``groups`` (column: values) to
    ``path``_usage/run=``run``; both replace what an earlier try of the run left, so a run counts once however often it is done.

    The figures are observed on the writing plan, so the rows are not read again. ``arrange`` may deal and sort the rows
    within partitions but must keep their number: it is counted before and after, and a difference undoes the write and ends it.
    """
    before, after = Observation(), Observation()
    arranged = (arrange or (lambda df: df))(calls.observe(before, F.count(F.lit(1)).alias("n")))
    figures = []
    for g, names in groups.items():
        figures += [F.count_if(F.col(g) == n).alias(f"{g}:{i}:calls") for i, n in enumerate(names)]
        figures += [F.coalesce(F.sum(F.when(F.col(g) == n, F.col(f))), F.lit(0)).alias(f"{g}:{i}:{f}") for i, n in enumerate(names) for f in USAGE]
    spark, at = calls.sparkSession, f"{path}/run={run}"
    arranged.observe(after, F.count(F.lit(1)).alias("n"), *figures).write.mode("overwrite").parquet(at)
    got = after.get
    if got["n"] != before.get["n"]:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        raise RuntimeError(f"{before.get['n']} rows became {got['n']}")
    rows = [(g, n, *(got[f"{g}:{i}:{f}"] for f in ("calls", *USAGE))) for g, names in groups.items() for i, n in enumerate(names)]
    spark.createDataFrame(rows, "level string, name string, " + ", ".join(f"{f} bigint" for f in ("calls", *USAGE))).coalesce(1).write.mode("overwrite").parquet(f"{path}_usage/run={run}")
    return {"rows": got["n"], "usage": rows}


def usage(spark: SparkSession, path: str) -> DataFrame:
    """(level, name, calls, tokens, cache_hit_rate) over all runs, from their few kept figures alone."""
    rows = spark.read.option("basePath", f"{path}_usage").parquet(f"{path}_usage").groupBy("level", "name").agg(*(F.sum(f).alias(f) for f in ("calls", *USAGE)))
    seen = F.col("cache_hit_tokens") + F.col("cache_miss_tokens")
    return rows.withColumn("cache_hit_rate", F.when(seen > 0, F.bround(F.col("cache_hit_tokens") / seen, 4)).otherwise(0.0))


def normalized_files(texts: DataFrame, out: str | None = None) -> dict:
    """Files (path, text) with full-width punctuation below ``out``, and how many there are, how many changed, and by how many
    replacements; null texts stay null. Without ``out`` nothing is written and the figures are what would be."""
    done = texts.select("path", F.col("text").alias("_was"), normalize_punctuation("text").alias("r")).select("path", "r.text", "r.n_changes", (~F.col("_was").eqNullSafe(F.col("r.text"))).alias("changed"))
    figures = [F.count(F.lit(1)).alias("files"), F.count_if("changed").alias("changed"), F.coalesce(F.sum("n_changes"), F.lit(0)).alias("replacements")]
    if out is None:
        return done.agg(*figures).first().asDict()
    seen = Observation()
    done.observe(seen, *figures).select("path", "text").write.mode("overwrite").parquet(out)
    return seen.get
