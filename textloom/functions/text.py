"""Column builders for text: stripping, paragraphs, sentences, headings and extractors."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that end a sentence, headings and placeholders.
TERMINAL = "。．.！？!?…）)」』】"
HEADING = (
    r"^(第[一二三四五六七八九十\p{Nd}]+[章節回部]|[0-9]+\.[\s　]*「|[０-９]+\.|[一二三四五六七八九十百]+、"
    r"|はじめに|まえがき|あとがき|おわりに|目次|参考文献|付録|结语|前言[\s　]*$)"
)
HEADING_MAX = 60
PLACEHOLDERS = {"brace": r"\{[^{}\n]{0,40}\}", "printf": r"%[-+ #0]?\p{Nd}*(?:\.\p{Nd}+)?[sdifgxXeEc]", "tag": r"<[A-Za-z/][^<>\n]{0,40}>"}
KANA = r"[぀-ヿ]"
KATAKANA_RUN = r"[ァ-ヺー]{3,}"
HALF_WIDTH = r"[,.!?;:]"
WIDE_DIGITS = "０１２３４５６７８９"


@functools.cache
def compatible_digits() -> str:
    """A pattern of the characters whose compatibility form has digits, besides the full-width ones, from the Unicode tables of Python, as ranges."""
    runs: list[list[int]] = []
    for k in range(0x80, 0x110000):
        c = chr(k)
        if 0xD800 <= k < 0xE000 or c in WIDE_DIGITS or (form := unicodedata.normalize("NFKC", c)) == c or not any(x.isdecimal() for x in form):
            continue
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def paragraphs(c: Column, separator: str = r"(?U)\n\s*\n") -> Column:
    """Stripped, non-empty paragraphs."""
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Pieces that end after each terminal character; a paragraph without any is one sentence."""
    parts = F.filter(F.transform(F.split(c, f"(?<=[{TERMINAL}])"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def is_heading(c: Column, pattern: str = HEADING) -> Column:
    s = strip(c)
    return F.length(s).between(1, HEADING_MAX) & s.rlike(pattern)


def ends_open(c: Column) -> Column:
    """Whether the last character does not end a sentence."""
    return ~F.right(c, F.lit(1)).isin(*TERMINAL)


def _compatible(c: pd.Series) -> pd.Series:
    return c.str.normalize("NFKC")


def numbers(c: Column) -> Column:
    """Runs of digits of the text's compatibility form (NFKC); only texts with such forms, full-width digits aside, leave the JVM."""
    odd = F.when(c.rlike(compatible_digits()), c)
    return F.regexp_extract_all(F.coalesce(F.pandas_udf(_compatible, StringType())(odd), F.translate(c, WIDE_DIGITS, "0123456789")), F.lit(r"(\p{Nd}+)"), 1)


def first_line_with(c: Column, needle: Column, longest: int = 60) -> Column:
    """(line, excerpt): the number, from 0, of the first line that holds ``needle``, and its text, cut to ``longest`` characters; null without one."""
    numbered = F.transform(F.split(c, "\n"), lambda x, i: F.struct(i.alias("line"), strip(x).alias("t"), F.contains(x, needle).alias("has")))
    first = F.try_element_at(F.filter(numbered, lambda r: r["has"]), F.lit(1))
    cut = F.when(F.length(first["t"]) <= longest, first["t"]).otherwise(F.concat(F.left(first["t"], F.lit(longest - 3)), F.lit("…")))
    return F.when(first.isNotNull(), F.struct(first["line"].alias("line"), cut.alias("excerpt")))


def _dated(epoch: Column, form: str) -> Column:
    """The engine puts a plus before years of more than four digits, which is no part of a text or a name."""
    return F.ltrim(F.date_format(F.timestamp_seconds(epoch), form), F.lit("+"))


def time_text(epoch: Column) -> Column:
    """Seconds since 1970 as date and time of the session's zone; null stays null."""
    return _dated(epoch, "yyyy-MM-dd HH:mm:ss")


def archive_stamp(epoch: Column) -> Column:
    """The same as digits alone, for names of folders, which then sort by time up to the year 9999."""
    return _dated(epoch, "yyyyMMddHHmmss")
