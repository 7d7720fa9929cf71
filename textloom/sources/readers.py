"""Files as tables: text in unknown encodings, JSON and XML strings, glossaries, event logs, chunk files, layouts."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import strip

# Encodings in the order in which they are tried, kinds of files, names of glossary columns.
ENCODINGS = ("utf-8", "utf-8-sig", "shift_jis", "euc_jp", "cp932")
FILE_ENCODINGS = ("utf-8", "utf-32", "shift_jis", "euc_jp", "iso2022_jp", "gb18030")
KINDS = ("txt", "json", "xml")
GLOSSARY = ("source", "target", "type", "origin", "note")
#: Texts that are decoded one by one at a time, where one of them is not UTF-8.
SLICE = 64
EVENT = "seq bigint, ts double, type string, stage string, chunk bigint, detail string"


def decoded(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """By the first encoding that takes all bytes; else as UTF-8 with replacement characters. A byte order mark stays."""
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _decoded(raw: pa.Array, encodings: tuple[str, ...]) -> pa.Array:
    """``decoded`` of each value. What is UTF-8 as it stands is not copied; only slices with other texts become objects."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        if len(raw) > SLICE:
            return pa.concat_arrays([_decoded(raw.slice(k, SLICE), encodings) for k in range(0, len(raw), SLICE)])
        return pa.array([None if b is None else decoded(b, encodings) for b in raw.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def decode_text(raw: pa.Array) -> pa.Array:
    return _decoded(raw, ENCODINGS)


@F.arrow_udf(StringType())
def decode_file(raw: pa.Array) -> pa.Array:
    """Files of any origin, which come in more encodings than the texts of a run."""
    return _decoded(raw, FILE_ENCODINGS)


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        if value.strip():
            yield value.strip()
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from _strings(value[k])
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


@F.pandas_udf(ArrayType(StringType()))
def json_strings(texts: pd.Series) -> pd.Series:
    """All strings in a JSON text, trimmed, without empty ones, objects by their sorted keys; null if it is not JSON."""

    def one(text):
        try:
            return list(_strings(json.loads(text)))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def xml_text(texts: pd.Series) -> pd.Series:
    """Text of an XML document, one line for each piece that an end tag closes; null if it is not well formed."""

    def one(text):
        try:
            parser = ET.XMLPullParser(("start", "end"))
            parser.feed(text)
            parser.close()
        except (TypeError, ET.ParseError):
            return None
        lines, piece = [], ""
        for what, e in parser.read_events():
            if what == "start":
                piece += (e.text or "").strip()
            else:
                if piece:
                    lines.append(piece)
                piece = (e.tail or "").strip()
        return "\n".join(lines)

    return texts.map(one)


@F.pandas_udf(StringType())
def docx_text(files: pd.Series) -> pd.Series:
    """Text of a DOCX file, one line for each paragraph, tabs and breaks kept; null if it is none."""
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}

    def one(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open("word/document.xml") as f:
                root = ET.parse(f).getroot()
        except (TypeError, KeyError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ET.ParseError):
            return None
        tag = lambda e: e.tag.rpartition("}")[2]
        line = lambda p: "".join((e.text or "") if tag(e) == "t" else marks.get(tag(e), "") for r in p.iter() if tag(r) == "r" for e in r)
        return "\n".join(line(p) for p in root.iter() if tag(p) == "p")

    return files.map(one)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of all text, JSON, XML and DOCX files below a folder; other kinds have no text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = files.select("path", kind.alias("kind"), F.when(kind.isin(*KINDS), decode_file("content")).alias("raw"), docx_text(F.when(kind == "docx", F.col("content"))).alias("docx"))
    blocks = F.array_join(json_strings("raw"), "\n\n")
    return text.select("path", "kind", F.when(F.col("kind") == "json", blocks).when(F.col("kind") == "xml", xml_text("raw")).when(F.col("kind") == "docx", F.col("docx")).otherwise(F.col("raw")).alias("text"))


# What the first or the second column of a header row is named.
HEADER_SOURCE = ("日语", "日文", "原文", "source", "japanese", "ja")
HEADER_TARGET = ("中文", "译名", "译文", "target", "chinese", "zh")


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Terms of CSV files with two or five columns; a file's first row is left out if it names the columns, and rows without source or target are."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in GLOSSARY)).option("header", "false").option("multiLine", "true").option("escape", '"').csv(path)
    clean = rows.select(*(strip(F.replace(F.col(c), F.lit("\ufeff"), F.lit(""))).alias(c) for c in GLOSSARY), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"))
    firsts = clean.groupBy(F.col("_file").alias("_of")).agg(F.min("_row").alias("_first"))
    header = (F.col("_row") == F.col("_first")) & (F.coalesce(F.lower("source"), F.lit("")).isin(*HEADER_SOURCE) | F.coalesce(F.lower("target"), F.lit("")).isin(*HEADER_TARGET))
    return clean.join(firsts, F.col("_file") == F.col("_of")).where(F.coalesce("source", F.lit("")) != "").where(F.coalesce("target", F.lit("")) != "").where(~header).select(*GLOSSARY)


def read_glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """Terms of JSON files, either a list or an object with ``terms``."""
    term = "struct<source:string,target:string,type:string,origin:string,note:string,aliases:array<string>,reading:string,gender:string>"
    raw = spark.read.text(path, wholetext=True)
    top = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    listed = F.when(F.startswith(top, F.lit("[")), F.from_json(top, f"array<{term}>")).otherwise(F.from_json(top, f"struct<terms:array<{term}>>")["terms"])
    rows = raw.select(F.explode(listed).alias("t")).select("t.*")
    return rows.where((F.coalesce(strip(F.col("source")), F.lit("")) != "") & (F.coalesce(strip(F.col("target")), F.lit("")) != ""))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An event log, one JSON object a line; other lines are skipped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("seq is not null")


def read_chunks(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """(chunk, text): whole files with the first number of their name; those whose name matches ``exclude`` are left out."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    files = spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))
    if exclude:
        files = files.where(~F.col("name").rlike(exclude))
    return files.select(F.try_to_number(F.regexp_extract("name", r"(\d+)", 1), F.lit("999999999999")).cast("bigint").alias("chunk"), "text").where("chunk is not null")


LAYOUT = "key string, page int, block int, box int, kind string, x0 double, y0 double, x1 double, y1 double, conf double, text string"


def _boxes(key: str, xml: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml)
    except (TypeError, ET.ParseError):
        return
    tag = lambda e: e.tag.rpartition("}")[2]

    def number(e, name):
        try:
            return float(e.get(name, ""))
        except ValueError:
            return None

    for p, page in enumerate(e for e in root.iter() if tag(e) == "PAGE"):
        block, box = -1, 0
        stack = [(e, None) for e in reversed(page)]
        while stack:
            e, inside = stack.pop()
            if tag(e) == "TEXTBLOCK":
                block += 1
                inside = block
            elif tag(e) == "LINE":
                x, y, w, h = (number(e, n) for n in ("X", "Y", "WIDTH", "HEIGHT"))
                if None not in (x, y, w, h):
                    yield key, p, inside, box, e.get("TYPE"), x, y, x + w, y + h, number(e, "CONF"), e.get("STRING")
                    box += 1
            stack.extend((c, inside) for c in reversed(e))


def layout_boxes(files: DataFrame, key: str, xml: str) -> DataFrame:
    """Lines of layout documents with their page, block (null outside any) and corners; broken documents have none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LAYOUT.split(", ")]
        for f in frames:
            out = pd.DataFrame([b for k, x in zip(f["k"], f["x"]) for b in _boxes(k, x)], columns=names)
            yield out.astype({"block": "Int32"})

    return files.select(F.col(key).cast("string").alias("k"), F.col(xml).alias("x")).mapInPandas(parse, LAYOUT)


def _page_elements(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(key, page): each element of this name in XML files, as a document by itself. A file is cut behind the elements' end tags while it is read,
    so large ones are read in parts and no file is one string. ``key`` joins the file and the page's IMAGENAME with ``#``. Files are
    UTF-8 and their names have no prefixes; what stands behind the last element is none."""
    ends = spark.read.option("lineSep", f"</{element}>").text(path).select(F.input_file_name().alias("file"), F.regexp_extract("value", rf"(?s)<{element}[\s>/].*$", 0).alias("page"))
    name = F.regexp_extract("page", rf"<{element}[^>]*?\bIMAGENAME\s*=\s*[\"']([^\"']*)", 1)
    return ends.where("page <> ''").select(F.concat_ws("#", "file", name).alias("key"), F.concat(F.lit("<PAGES>"), "page", F.lit(f"</{element}></PAGES>")).alias("page"))


def _with_names(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"file": F.substring_index("key", "#", 1), "name": F.regexp_extract("key", "#(.*)$", 1)})


def read_layout_pages(spark: SparkSession, path: str, element: str = "PAGE") -> DataFrame:
    """The boxes of ``layout_boxes`` for each page of layout files of any size, with their ``file`` and page's ``name``."""
    return _with_names(layout_boxes(_page_elements(spark, path, element), "key", "page"))


def read_annotated_pages(spark: SparkSession, path: str, element: str = "PAGE") -> DataFrame:
    """The boxes of ``annotated_boxes`` for each page of annotated files of any size, with their ``file`` and page's ``name``."""
    return _with_names(annotated_boxes(_page_elements(spark, path, element), "key", "page"))


def recognized_boxes(files: DataFrame, key: str, json: str) -> DataFrame:
    """(key, box, x0, y0, x1, y1, text): the lines of recognition results with the corners around their points, whole numbers,
    numbered by y0, then x0. Lines without points or text are left out; broken results have none."""
    line = "struct<boundingBox:array<array<double>>,text:string>"
    rows = files.select(key, F.posexplode(F.flatten(F.filter(F.from_json(F.col(json), f"struct<contents:array<array<{line}>>>")["contents"], lambda b: b.isNotNull()))).alias("_n", "_l"))
    rows = rows.where("_l.text is not null and size(_l.boundingBox) > 0")
    end = lambda f, i: f(F.transform("_l.boundingBox", lambda p: p[i])).cast("bigint")
    flat = rows.select(key, "_n", end(F.array_min, 0).alias("x0"), end(F.array_min, 1).alias("y0"), end(F.array_max, 0).alias("x1"), end(F.array_max, 1).alias("y1"), F.col("_l.text").alias("text"))
    pages = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "_n", "x1", "y1", "text"))).alias("_b"))
    return pages.select(key, F.posexplode("_b").alias("box", "b")).select(key, "box", "b.x0", "b.y0", "b.x1", "b.y1", "b.text")


def line_centres(boxes: DataFrame) -> DataFrame:
    """Boxes with the middle of each, rounded down; those with a missing corner are left out."""
    return boxes.dropna(subset=["x0", "y0", "x1", "y1"]).withColumns({"x": F.floor((F.col("x0") + F.col("x1")) / 2), "y": F.floor((F.col("y0") + F.col("y1")) / 2)})


def typed_pairs(c: Column) -> Column:
    """Column: ``k=v`` items of a list as an array of (key, kind, value), the kind the first of int, float, bool and string that
    fits. Items without ``=`` are left out."""
    key, value = (lambda x: F.substring_index(x, "=", 1)), (lambda x: F.substring(x, F.locate("=", x) + 1, 2**31 - 1))
    kind = lambda v: F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(v.try_cast("double").isNotNull(), "float").when(F.lower(v).isin("true", "false"), "bool").otherwise("string")
    held = F.filter(c, lambda x: F.contains(x, F.lit("=")))
    return F.transform(held, lambda x: F.struct(key(x).alias("key"), kind(value(x)).alias("kind"), value(x).alias("value")))


ANNOTATED = "key string, page int, image string, item int, kind string, type string, x0 double, y0 double, x1 double, y1 double, points array<double>, chars array<struct<kind:string,value:string,x0:double,y0:double,x1:double,y1:double>>"
# The type of a block that is an advert, and those that the shapes of text blocks get, in adverts and elsewhere.
ADVERT, SHAPES = "広告", {True: "広告本文ブロック", False: "本文ブロック"}


def _annotated(key: str, xml: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml)
    except (TypeError, ET.ParseError):
        return
    tag = lambda e: e.tag.rpartition("}")[2]

    def corners(e) -> tuple | None:
        try:
            x, y, w, h = (float(e.get(n, "")) for n in ("X", "Y", "WIDTH", "HEIGHT"))
        except ValueError:
            return None
        return x, y, x + w, y + h

    def line(e) -> tuple | None:
        box = corners(e)
        inside = [("char" if tag(c) == "CHAR" else "inline", c.get("MOJI" if tag(c) == "CHAR" else "TYPE"), b) for c in e if (b := corners(c))]
        return box and ("line", e.get("TYPE", ""), box, None, [(k, v, *b) for k, v, b in inside])

    def shape(e, advert: bool) -> tuple | None:
        try:
            points = [float(x) for x in next(p.get("POINTS") for p in e if p.get("POINTS")).split(",")]
        except (StopIteration, ValueError):
            return None
        if len(points) % 2:
            return None
        return "text_block", SHAPES[advert], (min(points[::2]), min(points[1::2]), max(points[::2]), max(points[1::2])), points, None

    def items(page) -> Iterator[tuple | None]:
        for e in page:
            if e.get("ERROR") is not None:
                continue
            blocks = [(e, False)] if tag(e) == "TEXTBLOCK" else []
            if tag(e) == "LINE":
                yield line(e)
            elif tag(e) == "BLOCK":
                box = corners(e)
                yield box and ("block", e.get("TYPE"), box, None, None)
                if e.get("TYPE") == ADVERT:
                    blocks = [(b, True) for b in e if tag(b) == "TEXTBLOCK"]
            for block, advert in blocks:
                for c in block:
                    if tag(c) in ("SHAPE", "LINE"):
                        yield shape(c, advert) if tag(c) == "SHAPE" else line(c)

    for p, page in enumerate(root):
        for i, (kind, type_, box, points, chars) in enumerate(x for x in items(page) if x):
            yield key, p, page.get("IMAGENAME"), i, kind, type_, *box, points, chars


def annotated_boxes(files: DataFrame, key: str, xml: str) -> DataFrame:
    """Blocks, lines and text blocks of annotated pages in order, lines with their characters and inline marks, text blocks with
    their outline and the corners around it. Elements marked as errors, and those without numbers for corners or an even number
    of them for an outline, are left out; broken documents have none."""
    kinds = dict(c.split(" ", 1) for c in ANNOTATED.split(", "))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [b for k, x in zip(f["k"], f["x"]) for b in _annotated(k, x)]
            out = pd.DataFrame(rows, columns=list(kinds))
            out["chars"] = [None if c is None else [dict(zip(("kind", "value", "x0", "y0", "x1", "y1"), t)) for t in c] for c in out["chars"]]
            yield out.astype({"points": object, "chars": object})  # a frame without rows has no types of its own

    return files.select(F.col(key).cast("string").alias("k"), F.col(xml).alias("x")).mapInPandas(parse, ANNOTATED)


def annotated_counts(boxes: DataFrame) -> DataFrame:
    """(kind, type, n) over annotated boxes."""
    return boxes.groupBy("kind", "type").agg(F.count("*").alias("n"))
