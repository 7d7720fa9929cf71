"""Upright runs in columns of text: short numbers and the like that stand level inside a vertical line.

What is printed is given by boxes of ink. A line's boxes make bands along its height, and each band's boxes a profile
along its width; a low band whose profile falls into several parts is a run that is to be read level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least width of a line, gap and height of a band, shares of a band's height that are looked at and read
# around it with their least sizes, parts of a profile, height over the line's width, and share of the profile's top.
MIN_WIDTH, MIN_GAP = 30, 5
LOOK, LOOK_LEAST, READ, READ_LEAST = 0.1, 2, 0.5, 5
MIN_PARTS, MAX_RATIO, INK = 2, 0.75, 0.10


def _clipped(lines: DataFrame, ink: DataFrame) -> DataFrame:
    cut = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c), F.col(most)))
    rows = ink.join(lines.where("height > width"), "line").select("line", "width", "height", *(cut(f"{c}{k}", m).alias(f"{c}{k}") for c, m in (("x", "width"), ("y", "height")) for k in (0, 1)))
    return rows.where("x0 < x1 and y0 < y1")


def bands(lines: DataFrame, ink: DataFrame) -> DataFrame:
    """(line, width, height, band, b0, b1, boxes): ink boxes (line, x0, y0, x1, y1; ends not included) of vertical lines (line, width,
    height), merged along the height where less than ``MIN_GAP`` lies between them; bands count from 0. ``boxes`` are all of the
    line. They are one array, so that nothing but it is sorted and kept; a line is bounded by its paper."""
    rows = _clipped(lines, ink)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("y0", "y1")}
    held = rows.groupBy("line", "width", "height").agg(F.array_sort(F.collect_list(F.struct("y0", "y1", "x0", "x1"))).alias("boxes"))

    def step(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["b0"].alias("b0"), F.greatest(last["b1"], b["y1"]).alias("b1"))
        apart = last.isNull() | (b["y0"] - last["b1"] >= MIN_GAP)
        return F.when(apart, F.concat(out, F.array(F.struct(b["y0"].alias("b0"), b["y1"].alias("b1"))))).otherwise(F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer)))

    merged = F.aggregate("boxes", F.array().cast(f"array<struct<b0:{kinds['y0']},b1:{kinds['y1']}>>"), step)
    return held.select("*", F.posexplode(merged).alias("band", "b")).select("line", "width", "height", F.col("band").cast("bigint").alias("band"), "b.b0", "b.b1", "boxes")


def _margin(share: float, least: int) -> Column:
    return F.greatest(F.lit(least), F.floor((F.col("b1") - F.col("b0")) * share))


def _parts(ends: Column) -> Column:
    """Runs above the share ``INK`` of its top of the profile whose steps (x, d) are given by place: one pass for the top, one for the runs."""
    begun = lambda *more: F.struct(F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("ink"), *more)
    moved = lambda s, e: ~s["x"].eqNullSafe(e["x"])

    def rise(s: Column, e: Column) -> Column:
        return F.struct(e["x"].alias("x"), (s["ink"] + e["d"]).alias("ink"), F.when(moved(s, e), F.greatest(s["top"], s["ink"])).otherwise(s["top"]).alias("top"))

    top = F.aggregate(ends, begun(F.lit(0.0).alias("top")), rise, lambda s: F.greatest(s["top"], s["ink"]))

    def run(s: Column, e: Column) -> Column:
        now = F.when(moved(s, e), s["ink"] > s["least"]).otherwise(s["dark"])
        begins = (moved(s, e) & (s["ink"] > s["least"]) & ~s["dark"]).cast("bigint")
        return F.struct(e["x"].alias("x"), (s["ink"] + e["d"]).alias("ink"), s["least"].alias("least"), now.alias("dark"), (s["n"] + begins).alias("n"))

    # Behind the last end there is no ink, so no run begins there.
    return F.aggregate(ends, begun((top * INK).alias("least"), F.lit(False).alias("dark"), F.lit(0).cast("bigint").alias("n")), run, lambda s: s["n"])


def upright_runs(lines: DataFrame, ink: DataFrame) -> DataFrame:
    """(line, band, b0, b1, parts, upright) for every band of a vertical line.

    The profile of a band is the ink above each place of the width within the band and a tenth around it; boxes must not
    overlap. ``parts`` counts its runs above a tenth of its top. Sums come of a sweep over the ends of boxes. Lines that
    are not higher than wide have no bands.
    """
    own = bands(lines, ink).withColumn("m", _margin(LOOK, LOOK_LEAST))
    own = own.select("*", F.greatest(F.lit(0), F.col("b0") - F.col("m")).alias("from"), F.least("height", F.col("b1") + F.col("m")).alias("to"))
    seen = F.filter(F.transform("boxes", lambda b: F.struct(b["x0"].cast("double").alias("x0"), b["x1"].cast("double").alias("x1"), (F.least(b["y1"], F.col("to")) - F.greatest(b["y0"], F.col("from"))).cast("double").alias("tall"))), lambda b: b["tall"] > 0)
    ends = F.array_sort(F.flatten(F.transform(seen, lambda b: F.array(F.struct(b["x0"].alias("x"), b["tall"].alias("d")), F.struct(b["x1"].alias("x"), (-b["tall"]).alias("d"))))))
    own = own.select("line", "band", "width", "b0", "b1", ends.alias("ends")).select("line", "band", "width", "b0", "b1", _parts(F.col("ends")).alias("parts"))
    tall = F.col("b1") - F.col("b0")
    upright = (F.col("width") >= MIN_WIDTH) & (tall >= MIN_GAP) & (F.col("parts") >= MIN_PARTS) & (tall <= F.col("width") * MAX_RATIO)
    return own.select("line", "band", "b0", "b1", "parts", upright.alias("upright"))


def reading_parts(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """(line, part, from, to, upright): how each line with an upright run is cut for reading, from the top.

    Upright bands stand alone, with half of their height around them; other bands up to the next upright one are one part,
    which reaches to the upright ones beside it.
    """
    by = Window.partitionBy("line").orderBy("band")
    rows = runs.join(lines.select("line", "height"), "line")
    rows = rows.withColumn("some", F.max("upright").over(Window.partitionBy("line"))).where("some")
    rows = rows.withColumns({"above": F.lag("upright").over(by), "above_to": F.lag("b1").over(by), "below": F.lead("upright").over(by), "below_from": F.lead("b0").over(by)})
    begins = F.col("upright") | F.coalesce("above", F.lit(True))
    rows = rows.withColumn("part", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("m", _margin(READ, READ_LEAST))
    start = F.when(F.col("upright"), F.greatest(F.lit(0), F.col("b0") - F.col("m"))).when(F.col("above"), F.col("above_to")).otherwise(F.col("b0"))
    stop = F.when(F.col("upright"), F.least("height", F.col("b1") + F.col("m"))).when(F.col("below"), F.col("below_from")).otherwise(F.col("b1"))
    return rows.groupBy("line", "part").agg(F.min(start).alias("from"), F.max(stop).alias("to"), F.first("upright").alias("upright"))


def better(whole: Column, parts: Column) -> Column:
    """The text of the parts where it is longer than that of the line read as a whole."""
    return F.when(F.length(parts) > F.length(whole), parts).otherwise(whole)
