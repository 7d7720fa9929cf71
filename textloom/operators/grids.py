"""Peaks of a grid of scores: a stencil over each place's neighbours, and the leading peaks of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places around one that it is compared with, itself included.
STENCIL = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
MOST, VISIBLE = 3000, 0.2


def peaks(cells: DataFrame) -> DataFrame:
    """(page, kind, y, x, score): cells (page, kind, y, x, score) whose score is the largest of the nine around and with them.

    Places that are missing, beyond the border too, count as 0, so a peak is above or at 0; equal neighbours are all peaks;
    null scores are no cells, and of several cells on one place the largest counts. Each cell goes to the nine places around
    it, where the largest is kept before and after the shuffle by place; the cell's own score travels with it, so there is no join.
    """
    own = cells.where("score is not null")
    sent = own.select("page", "kind", F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in STENCIL))).alias("d"), "y", "x", "score")
    sent = sent.select("page", "kind", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "score", F.when((F.col("d.dy") == 0) & (F.col("d.dx") == 0), F.col("score")).alias("own"))
    most = sent.groupBy("page", "kind", "y", "x").agg(F.max("score").alias("most"), F.max("own").alias("score"))
    return most.where((F.col("score") >= 0) & (F.col("score") == F.col("most"))).select("page", "kind", "y", "x", "score")


def leading(found: DataFrame, most: int = MOST, visible: float = VISIBLE) -> DataFrame:
    """(page, rank, kind, y, x, score): of each page's peaks the ``most`` best, equal ones by kind, row and column, without those
    whose score is below ``visible``; ranks begin at 1. Others are dropped before the shuffle by page."""
    best = Window.partitionBy("page").orderBy(F.desc("score"), "kind", "y", "x")
    return found.where(F.col("score") >= visible).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("page", "rank", "kind", "y", "x", "score")
