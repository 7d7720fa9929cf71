"""Lines in polygons by an index of tiles, and the distance to a polygon's sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import OWNERS
from .runs import in_polygon

#: Side of a tile, in the unit of the corners.
TILE = 256


def _sides(points: Column) -> Column:
    n = F.size(points)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(points, k).alias("a"), F.get(points, (k + 1) % n).alias("b")))


def _axis(name: str) -> Column:
    return F.transform("points", lambda p: p[name])


def signed_distance(x: Column, y: Column, points: Column) -> Column:
    """How far a point is from the nearest side of a polygon (array of x, y): positive inside, negative outside, 0 on a side that
    is level or upright. Null without points."""

    def away(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        size = dx * dx + dy * dy
        t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.nullif(size, F.lit(0.0)))))
        return F.hypot(x - s["a"]["x"] - t * dx, y - s["a"]["y"] - t * dy)

    place = in_polygon(x, y, points)
    nearest = F.array_min(F.transform(_sides(points), away))
    return F.when(F.size(points) > 0, F.when(place == 0, 0.0).otherwise(nearest * place))


def tiles(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """``blocks`` (page, block, kind, points) cut into tiles: (page, block, kind, points, tx, ty, whole).

    A tile stands for a text block if a side's box meets it, or else if it lies in the polygon as a whole (``whole``), so that
    nothing need be tested there; for other kinds every tile of the box around the points does. Blocks without points have none.
    """
    at = lambda c: F.floor(c / tile)
    ends = {f"{name}_{c}": f(_axis(c)) for name, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"}
    boxed = blocks.where(F.size("points") > 0).withColumns(ends)
    for c in "xy":
        boxed = boxed.withColumn(f"t{c}", F.explode(F.sequence(at(F.col(f"min_{c}")), at(F.col(f"max_{c}")))))
    meets = lambda s, c: (at(F.least(s["a"][c], s["b"][c])) <= F.col(f"t{c}")) & (at(F.greatest(s["a"][c], s["b"][c])) >= F.col(f"t{c}"))
    edge = F.exists(_sides(F.col("points")), lambda s: meets(s, "x") & meets(s, "y"))
    middle = [(F.col(f"t{c}") + 0.5) * tile for c in "xy"]
    whole = (F.col("kind") == "text") & ~edge & (in_polygon(*middle, F.col("points")) >= 0)
    return boxed.withColumn("whole", whole).where((F.col("kind") != "text") | edge | F.col("whole")).drop(*ends)


def owners(lines: DataFrame, blocks: DataFrame, least: float = 0.1, tile: int = TILE) -> DataFrame:
    """(page, box, kind, block): the block (page, block, kind, points) that owns each line (page, box, score, corners).

    A text block owns the lines whose centre (rounded down) is in its polygon or on a level or upright side, an advert or table
    those with the centre in the box around its points. Text blocks come before adverts before tables, and the first of a
    kind wins; a line without any is ``independent``. Lines of a score below ``least`` are left out. Lines meet blocks by page
    and tile, not by page alone. (page, box) must be unique.
    """
    rank = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(OWNERS)))
    ranked = tiles(blocks.where(F.col("kind").isin(*OWNERS)), tile).withColumn("rank", rank)
    centre = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("double")
    seen = lines.where(F.coalesce("score", F.lit(1.0)) >= least).select("page", "box", centre("x0", "x1").alias("x"), centre("y0", "y1").alias("y"))
    seen = seen.withColumns({f"t{c}": F.floor(F.col(c) / tile) for c in "xy"})
    held = seen.alias("l").join(ranked.withColumnsRenamed({"page": "p", "tx": "bx", "ty": "by"}).alias("b"), (F.col("l.page") == F.col("p")) & (F.col("tx") == F.col("bx")) & (F.col("ty") == F.col("by")), "left")
    around = F.lit(True)
    for c in "xy":
        around &= F.col(c).between(F.array_min(_axis(c)), F.array_max(_axis(c)))
    inside = F.when(F.col("kind") == "text", F.col("whole") | (in_polygon(F.col("x"), F.col("y"), F.col("points")) >= 0)).otherwise(around)
    first = held.groupBy("page", "box").agg(F.min(F.when(inside, F.struct("rank", "block", "kind"))).alias("o"))
    return first.select("page", "box", F.coalesce("o.kind", F.lit("independent")).alias("kind"), F.col("o.block").alias("block"))
