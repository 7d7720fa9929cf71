"""Lists of terms taken into a glossary, sums of use from several runs, and the gates of a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def import_outcomes(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """(arrival, source, target, outcome): what a list (source, target, arrival) does to a glossary (source, target).

    Rows without source or target are skipped. With ``overwrite`` a source that the glossary or an earlier row has is
    updated; without it, a row that says the same is an update and any other is skipped. Each row depends only on the
    glossary and on the first row of its source, which is a minimum taken before the shuffle. Arrivals must be unique.
    """
    rows = incoming.withColumns({"source": F.trim("source"), "target": F.trim("target")})
    blank = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "")
    bad = rows.where(blank).select("arrival", "source", "target", F.lit("skipped").alias("outcome"))
    firsts = rows.where(~blank).groupBy("source").agg(F.min_by("target", "arrival").alias("first"), F.min("arrival").alias("_at"))
    known = existing.select("source", F.col("target").alias("had"))
    good = rows.where(~blank).join(firsts, "source").join(known, "source", "left")
    new = F.col("had").isNull() & (F.col("arrival") == F.col("_at"))
    same = F.lit(True) if overwrite else F.col("target") == F.coalesce("had", "first")
    return good.select("arrival", "source", "target", F.when(new, "added").when(same, "updated").otherwise("skipped").alias("outcome")).union(bad)


def imported(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """The glossary (source, target) after the list: the last taken row of a source with ``overwrite``, else the first."""
    taken = import_outcomes(existing, incoming, overwrite).where("outcome <> 'skipped'")
    pick = F.max_by if overwrite else F.min_by
    new = taken.groupBy("source").agg(pick("target", "arrival").alias("new"))
    both = existing.select("source", F.col("target").alias("had")).join(new, "source", "full")
    return both.select("source", F.coalesce("new", "had").alias("target") if overwrite else F.coalesce("had", "new").alias("target"))


def superseded(logged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The conflict log with the open conflicts of overwritten sources resolved."""
    done = outcomes.where("outcome = 'updated'").select(F.col("source").alias("_s")).distinct()
    return logged.join(done, F.col("source") == F.col("_s"), "left").withColumn("resolved", F.col("resolved") | F.col("_s").isNotNull()).drop("_s")


def usage_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums by (level, name) of two roll-ups' calls and tokens; what one lacks counts as zero."""
    rows = a.select("level", "name", "calls", "tokens").unionByName(b.select("level", "name", "calls", "tokens"))
    return rows.groupBy("level", "name").agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def gates(issues: DataFrame, rate: DataFrame, logged: DataFrame, least: float = 0.98) -> DataFrame:
    """One row for each gate (gate, passed): no error among the issues, the rate of terms, no open conflict."""
    errors = issues.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))
    terms = rate.agg(F.coalesce(F.min("rate"), F.lit(1.0)).alias("r")).select((F.col("r") >= least).alias("passed"))
    open_ = logged.agg((F.count_if(~F.col("resolved")) == 0).alias("passed"))
    return errors.select(F.lit("alignment").alias("gate"), "passed").union(terms.select(F.lit("terms"), "passed")).union(open_.select(F.lit("conflicts"), "passed"))
