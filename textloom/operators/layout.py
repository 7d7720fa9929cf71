"""Page layout: duplicate lines, and the order in which boxes are read.

Each operator groups by page and works on one page's boxes at a time; a page is bounded by its paper, not by the input.
Boxes are (page, box, x0, y0, x1, y1).
"""

from __future__ import annotations

from functools import cmp_to_key
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Boxes of a page up to which pages are ranked together, and cells between their stops at a time; both give the same ranks as one page by itself.
TOGETHER, CELLS = 32, 200_000


def normalized_boxes(boxes: DataFrame, width: str, height: str) -> DataFrame:
    """Corners in thousandths of the page, held within 0 to 999."""
    scale = lambda c, side: F.least(F.lit(999), F.greatest(F.lit(0), F.floor(F.col(c) * 1000 / F.col(side)))).cast("int")
    return boxes.withColumns({"x0": scale("x0", width), "x1": scale("x1", width), "y0": scale("y0", height), "y1": scale("y1", height)})


def lines_in_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, box, block): each line with the blocks that hold its centre, edges included. Joined by page."""
    x, y = F.floor((F.col("l.x0") + F.col("l.x1")) / 2), F.floor((F.col("l.y0") + F.col("l.y1")) / 2)
    inside = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.y0"), F.col("b.y1"))
    return lines.alias("l").join(blocks.alias("b"), (F.col("l.page") == F.col("b.page")) & inside).select("l.page", "l.box", F.col("b.box").alias("block"))


def _by_page(boxes: DataFrame, *columns: str) -> DataFrame:
    """(page, boxes): each page's boxes as one array. The page is the only shuffle; its partitions are as many as the session
    sets, not fewer for a small input, for the work on a page is far more than its bytes suggest."""
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = boxes.select("page", F.struct(*columns).alias("b")).repartition(parts, "page")
    return rows.groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("boxes"))


def dup_lines(lines: DataFrame, limit: float = 0.8) -> DataFrame:
    """(page, box, x0, y0, x1, y1, conf): lines, in order of ``box`` (ties: of the corners), without those that cover the one kept before them by more
    than ``limit``: the surer one stays, the earlier one of equals."""
    columns = ("box", "x0", "y0", "x1", "y1", "conf")
    pages = _by_page(lines, *columns)
    kind = pages.schema["boxes"].dataType.simpleString()

    def share(a, b):
        side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        area = lambda t: (t["x1"] - t["x0"]) * (t["y1"] - t["y0"])
        least = F.least(area(a), area(b))
        return F.when(least > 0, side("x0", "x1") * side("y0", "y1") / least).otherwise(0.0)

    def step(kept, b):
        last = F.try_element_at(kept, F.lit(-1))
        apart = last.isNull() | (share(last, b) <= limit)
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(b))
        return F.when(apart, F.concat(kept, F.array(b))).when(last["conf"] < b["conf"], swapped).otherwise(kept)

    folded = F.aggregate("boxes", F.array().cast(kind), step)
    return pages.select("page", F.explode(folded).alias("b")).select("page", "b.*")


def _quietest(profile: np.ndarray) -> tuple[int, int, float]:
    """First longest run at the profile's minimum, and its score: 0 for empty space, -1 for none, a lone cell its own value."""
    if len(profile) == 1:
        return 0, 1, float(profile[0])
    low, high = profile.min(), profile.max()
    edges = np.flatnonzero(np.diff(np.r_[False, profile == low, False]))
    k = np.argmax(edges[1::2] - edges[::2])
    return int(edges[2 * k]), int(edges[2 * k + 1]), -low / high if high else 0.0


def _cut(region, sums):
    """Up to three regions of one; none if it is to be left whole."""
    x0, y0, x1, y1 = region
    across = np.diff(sums[y1, x0 : x1 + 1] - sums[y0, x0 : x1 + 1])
    down = np.diff(sums[y0 : y1 + 1, x1] - sums[y0 : y1 + 1, x0])
    (xa, xb, xs), (ya, yb, ys) = _quietest(across), _quietest(down)
    if xs > ys or (xs == ys and xb - xa >= yb - ya):
        stops = [x0, x0 + xa, x0 + xb, x1]
        parts = [(a, y0, b, y1) for a, b in zip(stops, stops[1:]) if a < b]
    else:
        stops = [y0, y0 + ya, y0 + yb, y1]
        parts = [(x0, a, x1, b) for a, b in zip(stops, stops[1:]) if a < b]
    return parts if len(parts) > 1 else []


def _on_grid(boxes: np.ndarray) -> np.ndarray:
    """Boxes (..., n, 4) of one page or of several with as many boxes each, in cells of the page's grid."""
    b = boxes.astype(float)
    b[..., 2:] = np.maximum(b[..., :2], b[..., 2:])
    low = b[..., :2].min(-2, keepdims=True)
    span = np.maximum(b[..., 2:].max(-2, keepdims=True) - low, 1)
    grid = 100 * np.sqrt(b.shape[-2]) * span / span.min(-1, keepdims=True)
    twice = lambda x: np.concatenate([x, x], -1)
    return np.maximum((b - twice(low)) * twice(grid) // twice(span), 0).astype(int)


def xy_order(boxes: np.ndarray) -> np.ndarray:
    """Rank of each box (n, 4) by recursive cuts along the emptiest bands.

    Profiles come from one table of sums over the grid. Every box goes to the leaf that it overlaps best; within a leaf boxes
    run from right to left, then down; the parts of a region that was cut from side to side run from right to left where more than
    half of its boxes are tall.
    """
    n = len(boxes)
    if n == 0:
        return np.zeros(0, int)
    g = _on_grid(boxes)
    filled = np.zeros((g[:, 3].max() + 1, g[:, 2].max() + 1), np.int32)
    for x0, y0, x1, y1 in g:
        filled[y0:y1, x0:x1] = 1
    sums = np.zeros((filled.shape[0] + 1, filled.shape[1] + 1), np.int64)
    sums[1:, 1:] = filled.cumsum(0).cumsum(1)

    regions, kids, todo = [(0, 0, filled.shape[1], filled.shape[0])], [[]], [0]
    while todo:
        i = todo.pop()
        for part in _cut(regions[i], sums):
            kids[i].append(len(regions))
            todo.append(len(regions))
            regions.append(part)
            kids.append([])

    def walk(turn=lambda i: False):
        stack, out = [0], []
        while stack:
            i = stack.pop()
            if not kids[i]:
                out.append(i)
            stack.extend(kids[i] if turn(i) else reversed(kids[i]))
        return out

    leaves = walk()
    r = np.array([regions[i] for i in leaves])
    held: dict[int, list[int]] = {}
    for k, (x0, y0, x1, y1) in enumerate(g):
        common = np.maximum(0, np.minimum(x1, r[:, 2]) - np.maximum(x0, r[:, 0]) + 1) * np.maximum(0, np.minimum(y1, r[:, 3]) - np.maximum(y0, r[:, 1]) + 1)
        ours, theirs = (x1 - r[:, 0] + 1) * (y1 - r[:, 1] + 1), (r[:, 2] - x0 + 1) * (r[:, 3] - y0 + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = common / (ours + theirs - common)
        held.setdefault(leaves[int(np.nanargmax(share))], []).append(k)

    tall = (g[:, 2] - g[:, 0]) < (g[:, 3] - g[:, 1])
    count, upright = np.zeros(len(regions), int), np.zeros(len(regions), int)
    for i, ks in held.items():
        count[i], upright[i] = len(ks), tall[ks].sum()
    for i in range(len(regions) - 1, -1, -1):  # parts come after the region they are cut from
        count[i] += sum(count[j] for j in kids[i])
        upright[i] += sum(upright[j] for j in kids[i])
    sideways = lambda i: all(regions[j][1::2] == regions[i][1::2] for j in kids[i])
    order = [k for i in walk(lambda i: sideways(i) and count[i] < 2 * upright[i]) for k in sorted(held.get(i, []), key=lambda k: (-g[k, 0], g[k, 1]))]
    if len(order) != n:
        raise RuntimeError(f"{n} boxes became {len(order)}")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    return rank


class _Level(NamedTuple):
    """Regions as numbers of stops, the regions of the level before that they are parts of, how they are cut, and whether."""

    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    up: np.ndarray
    sideways: np.ndarray
    cut: np.ndarray


def _stops(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places, from 0 to one behind the last, at which boxes of each page begin or end (filled up with the last one), and which of them is the last."""
    some = np.sort(np.concatenate([np.zeros((len(ends), 1), int), ends, ends.max(1, keepdims=True) + 1], 1), 1)
    at = np.concatenate([np.zeros((len(ends), 1), int), np.cumsum(np.diff(some) > 0, 1)], 1)
    out = np.repeat(some[:, -1:], some.shape[1], 1)
    np.put_along_axis(out, at, some, 1)
    return out, at[:, -1]


def _all_quietest(profiles: np.ndarray, begin: np.ndarray, end: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_quietest`` of the part from begin to end of each profile, whose values hold from stop to stop: first and last stop of the run, its length and score."""
    k, every = np.arange(profiles.shape[1]), np.arange(len(profiles))
    inside = (k >= begin[:, None]) & (k < end[:, None])
    low, high = np.where(inside, profiles, np.iinfo(np.int64).max).min(1), np.where(inside, profiles, -1).max(1)
    quiet = np.zeros((len(profiles), len(k) + 2), np.int8)
    quiet[:, 1:-1] = inside & (profiles == low[:, None])
    edges = np.diff(quiet, axis=1)
    (row, first), last = np.nonzero(edges > 0), np.nonzero(edges < 0)[1]
    length = stops[row, last] - stops[row, first]
    longest = np.maximum.reduceat(length, np.searchsorted(row, every))
    found = np.flatnonzero(length == longest[row])
    own = found[np.searchsorted(row[found], every)]
    score = np.where(stops[every, end] - stops[every, begin] == 1, low, np.where(high > 0, -low / np.maximum(high, 1), 0.0))
    return first[own], last[own], longest, score


def xy_orders(boxes: np.ndarray) -> np.ndarray:
    """``xy_order`` of several pages with as many boxes each (pages, n, 4): regions of all pages are cut level by level.

    Between two ends of boxes a profile keeps its value, so profiles have a value for each stop instead of each cell.
    """
    g = _on_grid(boxes)
    pages, n, _ = g.shape
    (xs, wide), (ys, high) = _stops(g[:, :, ::2].reshape(pages, -1)), _stops(g[:, :, 1::2].reshape(pages, -1))
    k = np.arange(xs.shape[1] - 1)
    filled = np.zeros((pages, len(k), len(k)), bool)
    for x0, y0, x1, y1 in np.moveaxis(g, 1, 0).transpose(0, 2, 1)[..., None]:
        filled |= ((ys[:, :-1] >= y0) & (ys[:, :-1] < y1))[:, :, None] & ((xs[:, :-1] >= x0) & (xs[:, :-1] < x1))[:, None, :]
    down, across = np.zeros((pages, len(k), len(k) + 1), np.int64), np.zeros((pages, len(k) + 1, len(k)), np.int64)
    np.cumsum(filled * np.diff(xs)[:, None, :], 2, out=down[:, :, 1:])
    np.cumsum(filled * np.diff(ys)[:, :, None], 1, out=across[:, 1:])

    zero = np.zeros(pages, int)
    page, x0, y0, x1, y1, up = np.arange(pages), zero, zero, wide, high, zero
    levels = []
    while len(page):
        xa, xb, xn, xv = _all_quietest(across[page, y1] - across[page, y0], x0, x1, xs[page])
        ya, yb, yn, yv = _all_quietest(down[page, :, x1] - down[page, :, x0], y0, y1, ys[page])
        sideways = (xv > yv) | ((xv == yv) & (xn >= yn))
        stops = np.where(sideways, [x0, xa, xb, x1], [y0, ya, yb, y1]).T
        parts = stops[:, :-1] < stops[:, 1:]
        cut = parts.sum(1) > 1
        levels.append(_Level(page, x0, y0, x1, y1, up, sideways, cut))
        up, part = np.nonzero(parts & cut[:, None])
        begin, end, level = stops[up, part], stops[up, part + 1], sideways[up]
        page, x0, y0, x1, y1 = page[up], np.where(level, begin, x0[up]), np.where(level, y0[up], begin), np.where(level, end, x1[up]), np.where(level, y1[up], end)

    def summed(own: list[np.ndarray]) -> list[np.ndarray]:
        """Each region's own value and those of all of its parts."""
        out = own[-1:]
        for i in range(len(levels) - 2, -1, -1):
            out.insert(0, own[i] + np.bincount(levels[i + 1].up, out[0], len(own[i])).astype(int))
        return out

    leaves = summed([(~x.cut).astype(int) for x in levels])

    def places(turned: list[np.ndarray]) -> np.ndarray:
        """The place of each leaf, level by level, among those of its page; parts of regions that are turned run backwards."""
        first, out = np.zeros(pages, int), []
        for i, x in enumerate(levels):
            if i:
                ends, all_ = np.cumsum(leaves[i]), leaves[i - 1][x.up]
                before = ends - leaves[i]
                before -= before[np.searchsorted(x.up, x.up)]
                first = first[x.up] + np.where(turned[i - 1][x.up], all_ - before - leaves[i], before)
            out.append(first[~x.cut])
        return np.concatenate(out)

    page, x0, y0, x1, y1 = (np.concatenate([x[c][~x.cut] for x in levels]) for c in range(5))
    by = np.lexsort((places([np.zeros(len(x.cut), bool) for x in levels]), page))
    page, x0, y0, x1, y1 = page[by], xs[page, x0][by], ys[page, y0][by], xs[page, x1][by], ys[page, y1][by]
    at, every = np.searchsorted(page, np.arange(pages)), np.arange(pages)
    held = np.empty((pages, n), int)
    for j in range(n):
        a0, b0, a1, b1 = g[page, j].T
        common = np.maximum(0, np.minimum(a1, x1) - np.maximum(a0, x0) + 1) * np.maximum(0, np.minimum(b1, y1) - np.maximum(b0, y0) + 1)
        ours, theirs = (a1 - x0 + 1) * (b1 - y0 + 1), (x1 - a0 + 1) * (y1 - b0 + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = common / (ours + theirs - common)
        share[np.isnan(share)] = -np.inf
        best = np.flatnonzero(share == np.maximum.reduceat(share, at)[page])
        held[:, j] = by[best[np.searchsorted(page[best], every)]]

    def counted(leaf: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(x.cut), int) for x in levels]
        for own, x, c in zip(out, levels, np.split(np.bincount(leaf, minlength=len(by)), np.cumsum([np.count_nonzero(~x.cut) for x in levels])[:-1]), strict=True):
            own[~x.cut] = c
        return summed(out)

    count, upright = counted(held.ravel()), counted(held[g[..., 2] - g[..., 0] < g[..., 3] - g[..., 1]])
    place = places([x.cut & x.sideways & (c < 2 * u) for x, c, u in zip(levels, count, upright, strict=True)])[held]
    order = np.lexsort((g[..., 1].ravel(), -g[..., 0].ravel(), place.ravel(), np.repeat(every, n)))
    ranks = np.empty(pages * n, int)
    ranks[order] = np.arange(pages * n) % n
    return ranks.reshape(pages, n)


@F.arrow_udf(ArrayType(IntegerType()))
def _ranks(pages: pa.Array) -> pa.Array:
    """Pages of up to ``TOGETHER`` boxes go through ``xy_orders``, those with as many boxes at once; larger ones and those with a missing corner by themselves."""
    flat, sizes = pages.flatten(), pages.value_lengths().to_numpy(zero_copy_only=False)
    corners = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], 1)
    ends = np.cumsum(sizes)
    out = np.empty(len(corners), np.int32)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = (ends - sizes)[sizes == n, None] + np.arange(n)
        odd = np.isnan(corners[at]).any((1, 2)) | (n > TOGETHER)
        for own in at[odd]:
            out[own] = xy_order(corners[own])
        at = at[~odd]
        some = max(1, CELLS // (2 * n + 2) ** 2)
        for i in range(0, len(at), some):
            out[at[i : i + some]] = xy_orders(corners[at[i : i + some]])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def layout_order(boxes: DataFrame) -> DataFrame:
    """(page, box, rank): the place of every box in its page's reading order."""
    ranked = _by_page(boxes, "box", "x0", "y0", "x1", "y1").select("page", F.explode(F.arrays_zip("boxes", _ranks("boxes").alias("rank"))).alias("r"))
    return ranked.select("page", "r.boxes.box", "r.rank")


def ordered_pages(lines: DataFrame, joint: str = "\n") -> DataFrame:
    """(page, n, text): each page's lines (page, box, corners, text) put in reading order and joined, and how many they are; a null
    text is empty. One shuffle, by page; a page whose lines change in number ends the job."""
    pages = _by_page(lines, "box", "x0", "y0", "x1", "y1", "text").withColumn("ranks", _ranks("boxes"))
    placed = F.array_sort(F.transform("boxes", lambda b, i: F.struct(F.get("ranks", i).alias("rank"), F.coalesce(b["text"], F.lit("")).alias("text"))))
    whole = F.when(F.size("ranks") == F.size("boxes"), placed).otherwise(F.raise_error(F.lit("lines were lost")))
    return pages.select("page", F.size("boxes").alias("n"), F.array_join(F.transform(whole, lambda x: x["text"]), joint).alias("text"))


def sort_lines(boxes: list[tuple], vertical: bool) -> list[int]:
    """Indexes of lines (x and y of the centre, width, height) in order: columns from the right, or rows from the top, where places that differ
    by no more than 0.3 of the median thickness count as one column or row."""
    if not boxes:
        return []
    margin = 0.3 * float(np.median([b[2] if vertical else b[3] for b in boxes]))

    def compare(i, j):
        (ax, ay, *_), (bx, by, *_) = boxes[i], boxes[j]
        lead, rest = (bx - ax, ay - by) if vertical else (ay - by, ax - bx)
        return lead if abs(lead) > margin else rest

    return sorted(range(len(boxes)), key=cmp_to_key(compare))


def smooth_path(order: list[float], begin: list[tuple], end: list[tuple], diagonal: float) -> list[int]:
    """The lightest path from the first to the last block that visits all, by steps of one or two places.

    Such a path can only step on, or go two on, one back and two on; so the weight from each place to the end follows from
    the places after it. From 20 blocks on there are steps of one only.
    """
    n = len(order)
    if n < 4 or n >= 20:
        return list(range(n))
    spread = max(order) - min(order)

    def weight(i, j):
        apart = abs(order[i] - order[j]) / spread if spread else 0.0
        return float(np.hypot(begin[j][0] - end[i][0], begin[j][1] - end[i][1])) / diagonal + apart

    best, jump = [0.0] * n, [False] * n
    for i in range(n - 2, -1, -1):
        best[i] = weight(i, i + 1) + best[i + 1]
        if i + 3 < n:
            other = weight(i, i + 2) + weight(i + 2, i + 1) + weight(i + 1, i + 3) + best[i + 3]
            if other < best[i]:
                best[i], jump[i] = other, True
    out, i = [0], 0
    while i < n - 1:
        out += [i + 2, i + 1, i + 3] if jump[i] else [i + 1]
        i = out[-1]
    return out


def block_order(lines: DataFrame) -> DataFrame:
    """(page, block, rank) of lines (page, block, box, x0 to y1, rank): blocks by the upper median of their lines' ranks, then smoothed."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    def page(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["block", "rank"], kind="stable")
        items = []
        for block, g in f.groupby("block", sort=False):
            first, last = g.iloc[0], g.iloc[-1]
            items.append((float(g["rank"].iloc[len(g) // 2]), ((first.x0 + first.x1) / 2, first.y0), ((last.x0 + last.x1) / 2, last.y1), block))
        items.sort(key=lambda t: (t[0], t[3]))
        diagonal = float(np.hypot(f["x1"].max(), f["y1"].max())) or 1.0
        path = smooth_path([t[0] for t in items], [t[1] for t in items], [t[2] for t in items], diagonal)
        return pd.DataFrame({"page": f["page"].iloc[0], "block": [items[i][3] for i in path], "rank": range(len(path))})

    return lines.groupBy("page").applyInPandas(page, f"page {kinds['page']}, block {kinds['block']}, rank int")
