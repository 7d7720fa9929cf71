"""Boxes inside boxes: interlinear notes that belong together, blocks within blocks, and the figures of a page.

Notes and blocks are worked on page by page, as in :mod:`.layout`; the rest are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .layout import _by_page

# What a note is widened by, as a share of its short side, and how far a block may stand out of another.
WIDEN, MARGIN = 0.1, 50


def note_groups(boxes: np.ndarray) -> list[int]:
    """For each note (n, 4), in order, the place of the first note of its group.

    Notes are widened across their direction. A note that is still free opens a group and takes every free note that shares
    some area with it; what those notes touch in turn is not taken.
    """
    b = boxes.astype(float)
    size = b[:, 2:] - b[:, :2]
    tall = size[:, 0] < size[:, 1]
    pad = np.where(tall[:, None], [1.0, 0.0], [0.0, 1.0]) * size.min(1, initial=np.inf)[:, None] * WIDEN / 2
    low, high = b[:, :2] - pad, b[:, 2:] + pad
    group = np.full(len(b), -1)
    for i in range(len(b)):
        if group[i] < 0:
            shared = (np.minimum(high[i], high) > np.maximum(low[i], low)).all(1)
            group[shared & (group < 0)] = i
            group[i] = i
    return group.tolist()


@F.pandas_udf(ArrayType(LongType()))
def _note(pages: pd.Series) -> pd.Series:
    return pages.map(lambda boxes: [int(boxes[i]["box"]) for i in note_groups(np.array([[b["x0"], b["y0"], b["x1"], b["y1"]] for b in boxes], float))])


def notes(lines: DataFrame) -> DataFrame:
    """The note lines (page, box, corners, rank), in order of ``box``, with ``note``, the first box of their group."""
    pages = _by_page(lines, "box", "x0", "y0", "x1", "y1", "rank")
    return pages.select("page", F.explode(F.arrays_zip("boxes", _note("boxes").alias("note"))).alias("r")).select("page", "r.note", "r.boxes.*")


def note_blocks(grouped: DataFrame) -> DataFrame:
    """(page, note, n, corners, rank): a group's box around all of its lines, and the median of their ranks."""
    return grouped.groupBy("page", "note").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median("rank").alias("rank"))


def with_notes(lines: DataFrame, grouped: DataFrame) -> DataFrame:
    """(page, box, rank): lines and notes in one order again, where the notes of a group follow each other at the group's place.

    At equal ranks a line comes before a group; groups follow their first box.
    """
    at = note_blocks(grouped).select("page", "note", F.col("rank").alias("place"))
    inside = grouped.join(at, ["page", "note"]).select("page", F.col("place").cast("double").alias("place"), F.col("note").cast("long").alias("note"), F.col("rank").cast("double").alias("own"), "box")
    outside = lines.select("page", F.col("rank").cast("double").alias("place"), F.lit(None).cast("long").alias("note"), F.lit(0.0).alias("own"), "box")
    pages = outside.unionByName(inside).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("note", F.lit(-1)).alias("note"), "own", "box"))).alias("boxes"))
    return pages.select("page", F.posexplode("boxes").alias("rank", "b")).select("page", "b.box", "rank")


def nest(boxes: list[tuple], lines: list[int], margin: float = MARGIN) -> list[tuple[int | None, str]]:
    """For each block, in order, the block that it ends in (None: it stays by itself) and how: ``top``, ``child`` or ``merged``.

    A block goes to the first other block still standing that holds its four corners, ``margin`` allowed around it. A block
    with lines or children hands them over and is gone (merged); one without any becomes a child. A block left with nothing
    but children swallows them (merged).
    """
    n = len(boxes)
    standing, kids, filled = [True] * n, [[] for _ in range(n)], [k > 0 for k in lines]
    state: list[tuple[int | None, str]] = [(None, "top")] * n

    def holds(p: tuple, c: tuple) -> bool:
        off = [np.hypot(max(p[0] - x, 0, x - p[2]), max(p[1] - y, 0, y - p[3])) for x in (c[0], c[2]) for y in (c[1], c[3])]
        return max(off) <= margin

    for c in range(n):
        p = next((p for p in range(n) if p != c and standing[p] and holds(boxes[p], boxes[c])), None) if standing[c] else None
        if p is None:
            continue
        standing[c] = False
        if filled[c] or kids[c]:
            filled[p] |= filled[c]
            kids[p] += kids[c]
            state[c] = (p, "merged")
        else:
            kids[p].append(c)
            state[c] = (p, "child")
    for p in range(n):
        if standing[p] and not filled[p]:
            for c in kids[p]:
                state[c] = (p, "merged")

    def end(i: int) -> int | None:
        up = state[i][0]
        while up is not None and state[up][0] is not None:
            up = state[up][0]
        return up

    return [(end(i), state[i][1]) for i in range(n)]


_NESTED = StructType().add("parent", LongType()).add("role", StringType())


@F.pandas_udf(ArrayType(_NESTED))
def _nested(pages: pd.Series) -> pd.Series:
    def page(boxes):
        found = nest([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in boxes], [b["n_lines"] for b in boxes])
        return [{"parent": None if p is None else int(boxes[p]["box"]), "role": role} for p, role in found]

    return pages.map(page)


def nested_blocks(blocks: DataFrame) -> DataFrame:
    """(page, box, parent, role) of blocks (page, box, corners, n_lines): see :func:`nest`. (page, box) must be unique."""
    pages = _by_page(blocks, "box", "x0", "y0", "x1", "y1", "n_lines")
    return pages.select("page", F.explode(F.arrays_zip("boxes", _nested("boxes").alias("to"))).alias("r")).select("page", "r.boxes.box", "r.to.parent", "r.to.role")


def detections(boxes: DataFrame, width: str, height: str, least: float = 0.25, side: float = 5) -> DataFrame:
    """Boxes of a confidence above ``least``, held within the page, without those whose sides are both below ``side``."""
    hold = lambda c, limit: F.greatest(F.lit(0), F.least(F.col(c), F.col(limit)))
    sure = boxes.where(F.col("conf") > least).withColumns({"x0": hold("x0", width), "x1": hold("x1", width), "y0": hold("y0", height), "y1": hold("y1", height)})
    return sure.where((F.col("x1") - F.col("x0") >= side) | (F.col("y1") - F.col("y0") >= side))


def page_stats(lines: DataFrame) -> DataFrame:
    """Per page: lines, tall ones among them, whether those are the majority, and the median sides."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    stats = lines.groupBy("page").agg(F.count("*").alias("n_lines"), F.count_if(w < h).alias("n_vertical"), F.median(w).alias("median_width"), F.median(h).alias("median_height"))
    return stats.withColumn("vertical", F.col("n_lines") < 2 * F.col("n_vertical"))


def dataset_summary(boxes: DataFrame, bins: int = 10) -> DataFrame:
    """(measure, bin, n) over boxes (page, corners): widths, heights, their ratios and boxes per page in ``bins`` equal bins from the
    least to the largest value. Boxes without a width have no ratio. Bins without values are absent."""
    w, h = (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")
    sides = boxes.select(F.explode(F.create_map(F.lit("width"), w, F.lit("height"), h, F.lit("aspect"), F.when(w != 0, h / w))).alias("measure", "v"))
    values = sides.unionByName(boxes.groupBy("page").agg(F.count("*").cast("double").alias("v")).select(F.lit("per_page").alias("measure"), "v")).where("v is not null")
    span = values.groupBy("measure").agg(F.min("v").alias("low"), F.max("v").alias("high"))  # four rows at most
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) * bins / (F.col("high") - F.col("low"))))).otherwise(0)
    return values.join(F.broadcast(span), "measure").groupBy("measure", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
