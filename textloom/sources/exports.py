"""Pages with their boxes as datasets and documents: annotation tables, encoded text, split pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.events import sequenced

# The name space of encoded text, and the parts of a document around its pages and lines.
TEI = "http://www.tei-c.org/ns/1.0"
HEAD = f'<?xml version="1.0" encoding="utf-8"?>\n<TEI xmlns="{TEI}"><teiHeader><fileDesc><titleStmt><title/></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><p/></sourceDesc></fileDesc></teiHeader><facsimile>'


def annotation_tables(pages: DataFrame, boxes: DataFrame, fx: float = 1.0, fy: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of pages (page, file_name, width, height) and boxes (page, box, corners, category_id).

    Both are numbered from 0 without gaps, images by page, annotations by page and box; measures are scaled by ``fx`` and ``fy``.
    Boxes of pages that are not among ``pages`` are left out. ``page`` must be a whole number.
    """
    numbered = sequenced(pages, "page", start=-1).withColumnRenamed("seq", "id")
    images = numbered.select("id", "file_name", (F.col("width") * fx).cast("int").alias("width"), (F.col("height") * fy).cast("int").alias("height"))
    x, y, w, h = F.col("x0") * fx, F.col("y0") * fy, (F.col("x1") - F.col("x0")) * fx, (F.col("y1") - F.col("y0")) * fy
    held = boxes.join(numbered.select("page", F.col("id").alias("image_id")), "page")
    ids = sequenced(held, "image_id", start=-1, then=("box",)).withColumnRenamed("seq", "id")
    annotations = ids.select("id", "image_id", "category_id", F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"), F.array(F.array(x, y, x + w, y, x + w, y + h, x, y + h)).alias("segmentation"))
    return images, annotations


def write_annotations(pages: DataFrame, boxes: DataFrame, path: str, **scale: float) -> None:
    """Images and annotations as JSON lines, one folder each: no single file has to hold the whole set."""
    for name, table in zip(("images", "annotations"), annotation_tables(pages, boxes, **scale), strict=True):
        table.write.mode("overwrite").json(f"{path}/{name}")


def _escaped(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def _attributes(**columns: Column) -> Column:
    return F.concat(*(x for n, c in columns.items() for x in (F.lit(f' {n.replace("__", ":")}="'), _escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit('"'))))


def encoded_text(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, xml): documents of pages (doc, page, name, path, width, height) and lines (doc, page, box, corners, text), a zone and a
    line break for each line and a page break for each page, in order. ``page`` and ``box`` must be whole numbers."""
    zone = F.format_string("L%04d_%03d", "page", "box")
    mark = F.concat(F.lit("<zone"), _attributes(xml__id=zone, ulx=F.col("x0"), uly=F.col("y0"), lrx=F.col("x1"), lry=F.col("y1")), F.lit("/>"))
    text = F.concat(F.lit("<lb"), _attributes(n=F.col("box"), facs=F.concat(F.lit("#"), zone)), F.lit("/>"), _escaped(F.coalesce("text", F.lit(""))))
    joined = lambda c, field: F.array_join(F.transform(F.array_sort(c), lambda r: r[field]), "")
    ranked = pages.select("doc", "page", "name", "path", "width", "height")
    by_page = lines.select("doc", "page", F.struct("box", mark.alias("zone"), text.alias("line")).alias("l")).groupBy("doc", "page").agg(F.collect_list("l").alias("ls"))
    both = ranked.join(by_page, ["doc", "page"], "left").withColumn("ls", F.coalesce("ls", F.array().cast(by_page.schema["ls"].dataType)))
    px = lambda c: F.concat(F.col(c).cast("string"), F.lit("px"))
    surface = F.concat(F.lit("<surface><graphic"), _attributes(url=F.replace("path", F.lit(" "), F.lit("%20")), width=px("width"), height=px("height")), F.lit("/>"), joined("ls", "zone"), F.lit("</surface>"))
    body = F.concat(F.lit("<pb"), _attributes(n=F.col("name"), facs=F.concat(F.lit("#"), "name")), F.lit("/>"), joined("ls", "line"))
    whole = both.groupBy("doc").agg(F.collect_list(F.struct("page", surface.alias("surface"), body.alias("body"))).alias("ps"))
    return whole.select("doc", F.concat(F.lit(HEAD), joined("ps", "surface"), F.lit("</facsimile><text><body><p>"), joined("ps", "body"), F.lit("</p></body></text></TEI>")).alias("xml"))


def split_pages(pages: DataFrame, ratio: float = 0.9, seed: int = 0) -> DataFrame:
    """Pages with ``train``: true for about ``ratio`` of them, by a hash of the page, so that a page stays where it is when others come."""
    return pages.withColumn("train", F.pmod(F.xxhash64(F.col("page"), F.lit(seed)), F.lit(1_000_000)) < F.lit(int(ratio * 1_000_000)))


def wrapped(pages: DataFrame, key: str, xml: str, order: str, root: str = "OCRDATASET") -> DataFrame:
    """(key, xml): the page elements of each key, in order, in one root element."""
    parts = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, xml))).alias("p"))
    return parts.select(key, F.concat(F.lit(f"<{root}>\n"), F.array_join(F.transform("p", lambda r: r[xml]), "\n"), F.lit(f"\n</{root}>")).alias("xml"))
