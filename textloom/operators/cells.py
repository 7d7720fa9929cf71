"""Lines in blocks and texts in table cells. Everything joins by page and so is bounded by a page's boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .layout import _by_page

# Kinds of blocks in the order in which they may own a line, and the shares of overlap that make one.
OWNERS = ("text", "ad", "table")
SAME_CELL, IN_CELL = 0.5, 0.2


def _inside(x: Column, y: Column, t: str) -> Column:
    return x.between(F.col(f"{t}.x0"), F.col(f"{t}.x1")) & y.between(F.col(f"{t}.y0"), F.col(f"{t}.y1"))


def line_owners(lines: DataFrame, blocks: DataFrame, least: float = 0.1) -> DataFrame:
    """(page, box, kind, block): the block (page, block, kind, corners) that owns each line (page, box, score, corners).

    Text blocks come before adverts before tables, and the first of a kind wins; a line without any is ``independent``, with
    no block. Lines of a score below ``least`` are left out, those without a score are kept. (page, box) must be unique.
    """
    rank = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(OWNERS)))
    ranked = blocks.where(F.col("kind").isin(*OWNERS)).withColumn("rank", rank)
    seen = lines.where(F.coalesce("score", F.lit(1.0)) >= least)
    x, y = F.floor((F.col("l.x0") + F.col("l.x1")) / 2), F.floor((F.col("l.y0") + F.col("l.y1")) / 2)
    held = seen.alias("l").join(ranked.alias("b"), (F.col("l.page") == F.col("b.page")) & _inside(x, y, "b"), "left")
    first = held.groupBy("l.page", "l.box").agg(F.min(F.when(F.col("b.rank").isNotNull(), F.struct("b.rank", "b.block", "b.kind"))).alias("o"))
    return first.select("page", "box", F.coalesce("o.kind", F.lit("independent")).alias("kind"), F.col("o.block").alias("block"))


def cell_texts(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, cell, content): each cell's texts, from top to bottom, then from the left; cells without any are empty.

    A text (page, box, text, corners) goes to the cell (page, cell, corners) that holds its centre; of several, to the one
    with the nearest centre, then the smallest number. Texts outside all cells go nowhere.
    """
    mid = lambda t, a, b: (F.col(f"{t}.{a}") + F.col(f"{t}.{b}")) / 2
    x, y = mid("t", "x0", "x1"), mid("t", "y0", "y1")
    away = F.pow(x - mid("c", "x0", "x1"), 2) + F.pow(y - mid("c", "y0", "y1"), 2)
    held = texts.alias("t").join(cells.alias("c"), (F.col("t.page") == F.col("c.page")) & _inside(x, y, "c"))
    placed = held.groupBy("t.page", "t.box").agg(F.min(F.struct(away.alias("away"), "c.cell")).alias("best"), F.first(F.struct("t.y0", "t.x0", "t.box", "t.text")).alias("t"))
    content = placed.groupBy("page", F.col("best.cell").alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "").alias("content"))
    return cells.select("page", "cell").join(content, ["page", "cell"], "left").select("page", "cell", F.coalesce("content", F.lit("")).alias("content"))


def _overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return max(w, 0) * max(h, 0) / least if least > 0 else 0.0


def grown(boxes: list[tuple]) -> list[int]:
    """For each box the place of the one that takes it in: in order, a box takes every later free one that it overlaps by
    over ``SAME_CELL`` of the smaller, and grows by it at once."""
    owner = [-1] * len(boxes)
    for i, box in enumerate(boxes):
        if owner[i] < 0:
            owner[i], hull = i, box
            for j in range(i + 1, len(boxes)):
                if owner[j] < 0 and _overlap(hull, boxes[j]) > SAME_CELL:
                    owner[j] = i
                    hull = (*map(min, hull[:2], boxes[j][:2]), *map(max, hull[2:], boxes[j][2:]))
    return owner


@F.pandas_udf(ArrayType(LongType()))
def _owners(pages: pd.Series) -> pd.Series:
    return pages.map(lambda boxes: [int(boxes[i]["box"]) for i in grown([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes])])


def merged_cells(cells: DataFrame) -> DataFrame:
    """(page, cell, n, corners): cells (page, box, corners) that are one, by the first's number, with the box around them."""
    pages = _by_page(cells, "box", "x0", "y0", "x1", "y1")
    rows = pages.select("page", F.explode(F.arrays_zip("boxes", _owners("boxes").alias("cell"))).alias("r")).select("page", "r.cell", "r.boxes.*")
    return rows.groupBy("page", "cell").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: The type of a box, for tables made by hand.
BOX = StructType().add("page", LongType()).add("box", LongType()).add("x0", LongType()).add("y0", LongType()).add("x1", LongType()).add("y1", LongType())
