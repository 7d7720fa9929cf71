"""Checks of source and target segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HALF_WIDTH, KANA, KATAKANA_RUN, PLACEHOLDERS, numbers, paragraphs, strip

RATIO_MIN, RATIO_MAX = 0.55, 1.70


def pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, src, zh): each user turn with the assistant's next turn, null where there is none."""
    src = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    zh = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("zh"))
    return src.join(zh, ["conv_id", "turn"], "left")


def align_issues(p: DataFrame, low: float = RATIO_MIN, high: float = RATIO_MAX) -> DataFrame:
    """Issues (kind, severity, delta, ratio) of every pair: missing or empty target, paragraphs that differ, length out of ratio."""
    n_src, n_zh = F.size(paragraphs(F.col("src"), r"\n")), F.size(paragraphs(F.col("zh"), r"\n"))
    delta = n_zh - n_src
    ratio = F.length(strip("zh")) / F.length(strip("src"))
    hard = (F.abs(delta) >= 2) | (F.abs(delta) / n_src >= 0.15)
    issue = lambda kind, severity, d=None, r=None: F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), (F.lit(None).cast("int") if d is None else d).alias("delta"), (F.lit(None).cast("double") if r is None else F.bround(r, 4)).alias("ratio"))
    full = F.col("zh").isNotNull() & (strip("zh") != "")
    found = F.array(
        F.when(F.col("zh").isNull(), issue("missing_file", F.lit("error"))),
        F.when(strip("zh") == "", issue("empty_translation", F.lit("error"))),
        F.when(full & (delta != 0), issue("paragraph_mismatch", F.when(hard, "error").otherwise("warn"), d=delta)),
        F.when(full & ((ratio < low) | (ratio > high)), issue("length_ratio", F.lit("warn"), r=ratio)),
    )
    return p.select("conv_id", "turn", F.explode(F.array_compact(found)).alias("i")).select("conv_id", "turn", "i.*")


def align_summary(p: DataFrame) -> DataFrame:
    return align_issues(p).groupBy("kind", "severity").agg(F.count("*").alias("n"), F.countDistinct("conv_id", "turn").alias("n_chunks"))


def error_chunks(p: DataFrame) -> DataFrame:
    """(conv_id, turn) of the pairs with an error, in order."""
    return align_issues(p).where("severity = 'error'").select("conv_id", "turn").distinct().orderBy("conv_id", "turn")


def number_missing(p: DataFrame) -> DataFrame:
    """Numbers of the source that its target lacks, as a difference of multisets."""
    side = lambda c: p.where(F.col("zh").isNotNull()).select("conv_id", "turn", F.explode(numbers(F.col(c))).alias("number")).groupBy("conv_id", "turn", "number").agg(F.count("*").alias("n"))
    both = side("src").join(side("zh").withColumnRenamed("n", "m"), ["conv_id", "turn", "number"], "left")
    return both.select("conv_id", "turn", "number", (F.col("n") - F.coalesce("m", F.lit(0))).alias("missing")).where("missing > 0")


def placeholder_diff(p: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.union, (p.where(F.col("zh").isNotNull()).select("conv_id", "turn", F.lit(k).alias("class"), F.regexp_count("src", F.lit(r)).alias("n_src"), F.regexp_count("zh", F.lit(r)).alias("n_zh")) for k, r in PLACEHOLDERS.items()))
    return rows.where("n_src <> n_zh")


def residue_scan(docs: DataFrame, letters: str = "[äöüß]") -> DataFrame:
    """Lines with characters that a text should not have: how many, and which, at most 20."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    found = lines.withColumn("chars", F.regexp_extract_all("t", F.lit(f"({letters})"), 1)).where(F.size("chars") > 0)
    return found.select("doc_id", "line", F.size("chars").alias("n_chars"), F.array_join(F.slice(F.array_sort(F.array_distinct("chars")), 1, 20), "").alias("found"))


def katakana_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """(token, n): runs of three katakana or more that are there at least ``least`` times."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({KATAKANA_RUN})"), 1)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def punct_scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.regexp_count("text", F.lit(HALF_WIDTH)).alias("n_half_width"), F.regexp_count("text", F.lit("[「」『』]")).alias("n_brackets"))


def qa_summary(p: DataFrame, residue: str = KANA) -> DataFrame:
    """Issues of each kind, zero where there are none; lines of a target with ``residue`` are one each. One pass counts all kinds but numbers, which are compared as multisets."""
    full = F.col("zh").isNotNull() & (strip("zh") != "")
    places = reduce(lambda a, b: a + b, ((F.regexp_count("src", F.lit(x)) != F.regexp_count("zh", F.lit(x))).cast("int") for x in PLACEHOLDERS.values()))
    apart = F.size(paragraphs(F.col("src"), r"\n")) != F.size(paragraphs(F.col("zh"), r"\n"))
    counts = p.agg(
        F.count_if(~full).alias("empty"), F.coalesce(F.sum(F.when(full, places)), F.lit(0)).alias("placeholder"), F.count_if(full & (F.regexp_count("zh", F.lit(HALF_WIDTH)) > 0)).alias("punctuation"),
        F.count_if(full & apart).alias("paragraph"), F.coalesce(F.sum(F.when(full, F.size(F.filter(F.split("zh", "\n"), lambda t: F.rlike(t, F.lit(residue)))))), F.lit(0)).alias("residue"),
    )
    one_pass = counts.unpivot([], ["empty", "placeholder", "punctuation", "paragraph", "residue"], "kind", "n")
    numbers_ = number_missing(p.where(full)).select("conv_id", "turn").distinct().agg(F.count("*").alias("n")).select(F.lit("number").alias("kind"), "n")
    return one_pass.union(numbers_)
