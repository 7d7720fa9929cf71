"""Tables out of cells: texts by overlap, and a table as HTML and Markdown."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .cells import IN_CELL
from .layout import _by_page


def overlapping_texts(texts: DataFrame, cells: DataFrame, least: float = IN_CELL) -> DataFrame:
    """(page, cell, content): each cell's texts, from the top, then from the left; cells without any are empty.

    A text (page, box, text, corners) is in every cell (page, cell, corners) with which it shares more than ``least`` of the
    smaller area. Joined by page.
    """
    t, c = (lambda n: F.col(f"t.{n}")), (lambda n: F.col(f"c.{n}"))
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(t(hi), c(hi)) - F.greatest(t(lo), c(lo)))
    area = lambda b: (b("x1") - b("x0")) * (b("y1") - b("y0"))
    smaller = F.least(area(t), area(c))
    held = texts.alias("t").join(cells.alias("c"), (t("page") == c("page")) & (smaller > 0) & (side("x0", "x1") * side("y0", "y1") > smaller * least))
    content = held.groupBy("c.page", "c.cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.y0", "t.x0", "t.box", "t.text"))), lambda r: r["text"]), "").alias("content"))
    return cells.select("page", "cell").join(content, ["page", "cell"], "left").select("page", "cell", F.coalesce("content", F.lit("")).alias("content"))


def grid(cells: list[tuple]) -> list[list[int]]:
    """Rows of numbers of the cells (row0, row1, col0, col1) that fill each place; -1 where none does.

    Row and column numbers are closed up, the last row and column included; of cells on one place the later one has it.
    """
    spans = [(*sorted((r0, r1)), *sorted((c0, c1))) for r0, r1, c0, c1 in cells]
    rows = {v: i for i, v in enumerate(sorted({v for s in spans for v in s[:2]}))}
    cols = {v: i for i, v in enumerate(sorted({v for s in spans for v in s[2:]}))}
    out = [[-1] * len(cols) for _ in rows]
    for k, (r0, r1, c0, c1) in enumerate(spans):
        for r in range(rows[r0], rows[r1] + 1):
            out[r][cols[c0] : cols[c1] + 1] = [k] * (cols[c1] - cols[c0] + 1)
    return out


def decoded(tokens: DataFrame) -> DataFrame:
    """(page, box, row0, row1, col0, col1, text): cells of the tables whose structure the tokens (page, at, token, rowspan, colspan, text) tell.

    A token ``row`` begins a row, ``cell`` fills the first free places of it from the left: ``colspan`` columns in that and the
    following ``rowspan`` - 1 rows, of which those below are taken from then on. Spans that are null or below 1 count as 1; a
    cell before any row begins row 0; other tokens say nothing. ``box`` numbers a page's cells from 0, ends are
    included. Where a wide cell meets a taken place behind its first, both have it. One fold over a page's tokens, whose state
    is the first free row of each column.
    """
    span = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1))).cast("int")
    own = tokens.where(F.col("token").isin("row", "cell")).select("page", F.struct("at", "token", span("rowspan").alias("down"), span("colspan").alias("wide"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    pages = own.groupBy("page").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    cell = "struct<row0:int,row1:int,col0:int,col1:int,text:string>"
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("col"), F.array().cast("array<int>").alias("free"), F.array().cast(f"array<{cell}>").alias("out"))

    def placed(s: Column, t: Column, first: Column) -> Column:
        row, last = F.greatest(s["row"], F.lit(0)), first + t["wide"] - 1
        below = row + t["down"]
        free = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["free"]) - 1, last)), lambda c: F.when(c.between(first, last), F.greatest(below, F.coalesce(F.get(s["free"], c), F.lit(0)))).otherwise(F.coalesce(F.get(s["free"], c), F.lit(0))))
        made = F.struct(row.alias("row0"), (below - 1).alias("row1"), first.alias("col0"), last.alias("col1"), t["text"].alias("text"))
        return F.struct(row.alias("row"), (last + 1).alias("col"), free.alias("free"), F.concat(s["out"], F.array(made)).alias("out"))

    def step(s: Column, t: Column) -> Column:
        row, places = F.greatest(s["row"], F.lit(0)), F.sequence(F.lit(0), F.size(s["free"]))
        first = F.coalesce(F.get(F.filter(places, lambda c: (c >= s["col"]) & (F.coalesce(F.get(s["free"], c), F.lit(0)) <= row)), F.lit(0)), F.greatest(s["col"], F.size(s["free"])))
        # As the value of a lambda the place is looked for once a cell, not once for each column and field.
        filled = F.get(F.transform(F.array(first), lambda f: placed(s, t, f)), F.lit(0))
        begun = F.struct((s["row"] + 1).alias("row"), F.lit(0).alias("col"), s["free"].alias("free"), s["out"].alias("out"))
        return F.when(t["token"] == "row", begun).otherwise(filled)

    cells = pages.select("page", F.posexplode(F.aggregate("ts", start, step)["out"]).alias("box", "c"))
    return cells.select("page", F.col("box").cast("long").alias("box"), "c.*")


def _ordered(cells: list[tuple]) -> list[tuple]:
    return sorted(cells, key=lambda c: (min(c[0], c[1]), min(c[2], c[3])))


def to_html(cells: list[tuple]) -> str:
    """A table of cells (row0, row1, col0, col1, text); a cell is written where it is met first. ``&``, ``<`` and ``>`` are escaped."""
    cells = _ordered(cells)
    places, written, out = grid([c[:4] for c in cells]), set(), []
    for r, row in enumerate(places):
        out.append("<tr>")
        for c, k in enumerate(row):
            if k < 0:
                out.append("<td></td>")
            elif k not in written:
                written.add(k)
                wide = next((i for i, x in enumerate(row[c:]) if x != k), len(row) - c)
                deep = next((i for i, x in enumerate(places[r:]) if x[c] != k), len(places) - r)
                span = "" if (wide, deep) == (1, 1) else f' colspan="{wide}" rowspan="{deep}"'
                out.append(f"<td{span}>{html.escape(cells[k][4] or '', quote=False)}</td>")
        out.append("</tr>")
    return '<table border="1">' + "".join(out) + "</table>"


def to_markdown(cells: list[tuple]) -> str:
    """The same table with numbers as its head; a cell's text stands in every place that it fills. ``|`` is escaped, line ends become spaces."""
    cells = _ordered(cells)
    places = grid([c[:4] for c in cells])
    if not places:
        return ""
    text = lambda k: "" if k < 0 else (cells[k][4] or "").replace("|", "\\|").replace("\n", " ")
    line = lambda parts: "| " + " | ".join(parts) + " |"
    head = range(len(places[0]))
    return "\n".join([line(map(str, head)), "|" + "---|" * len(head), *(line(map(text, row)) for row in places)])


@F.pandas_udf(StructType().add("html", "string").add("markdown", "string"))
def _rendered(tables: pd.Series) -> pd.DataFrame:
    rows = [[(c["row0"], c["row1"], c["col0"], c["col1"], c["text"]) for c in t] for t in tables]
    return pd.DataFrame({"html": [to_html(r) for r in rows], "markdown": [to_markdown(r) for r in rows]})


def rendered(cells: DataFrame) -> DataFrame:
    """(page, html, markdown) of the cells (page, box, row0, row1, col0, col1, text) of one table a page."""
    return _by_page(cells, "box", "row0", "row1", "col0", "col1", "text").select("page", _rendered("boxes").alias("r")).select("page", "r.*")
