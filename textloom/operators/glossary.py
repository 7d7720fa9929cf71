"""Terminology: hits in texts, ordered merge with conflicts, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .events import sequenced

TOKEN = r"[a-z0-9_]+"


def ascii_terms(texts: DataFrame, least: int = 8) -> DataFrame:
    """(source): distinct lower-case ASCII tokens of at least ``least`` characters."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TOKEN})"), 1)).alias("source")).where(F.length("source") >= least).distinct()


def term_occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, source, n): hits of single-token ASCII terms between word boundaries.

    Such a term stands between boundaries exactly where it is a token, so the match is an equi-join on counted tokens
    instead of a test of every term against every text.
    """
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), F.lit(f"({TOKEN})"), 1)).alias("source"))
    return tokens.join(terms, "source", "left_semi").groupBy("doc_id", "source").agg(F.count("*").alias("n"))


def hits_topk(hits: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` terms of a document with the most hits, ties in order of the term, and whether there were more."""
    by = Window.partitionBy("doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "source"))).withColumn("truncated", F.count("*").over(by) > k)
    return ranked.where(F.col("rank") <= k)


def backfill(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(F.sum("n").alias("hits"), F.min("doc_id").alias("first_doc"))


def merge(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """What each candidate (source, target, arrival) does to a glossary of locked ``seeds`` (source, target).

    The first arrival of a new source fixes its target, so the ordered fold has a closed form: candidates of a seeded
    source are unchanged or rejected, of any other inserted, unchanged or in conflict. First arrivals are a minimum, which
    is taken before the shuffle, so a source that most candidates have is never sorted in one task. Candidates without
    source or target fix nothing; white space around either is no part of it. Arrivals must be unique.
    """
    candidates = candidates.withColumns({"source": strip(F.col("source")), "target": strip(F.col("target"))})
    blank = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "")
    firsts = candidates.where(~blank).groupBy("source").agg(F.min_by("target", "arrival").alias("first"), F.min("arrival").alias("_at"))
    rows = candidates.join(seeds.withColumnRenamed("target", "locked"), "source", "left").join(firsts, "source", "left")
    action = (
        F.when(blank, "invalid").when(F.col("locked") == F.col("target"), "unchanged").when(F.col("locked").isNotNull(), "rejected_by_lock")
        .when(F.col("arrival") == F.col("_at"), "inserted").when(F.col("target") == F.col("first"), "unchanged").otherwise("conflict")
    )
    return rows.select("arrival", "source", "target", F.coalesce("locked", "first").alias("kept"), action.alias("action"))


def conflicts(merged: DataFrame) -> DataFrame:
    """Conflicts by source, with gap-free ids of their own in order of arrival; open ones come of unlocked terms."""
    logged = merged.where("action in ('conflict', 'rejected_by_lock')")
    return sequenced(logged, "arrival", by="source").select("source", F.col("seq").cast("int").alias("nth"), "arrival", F.col("kept").alias("existing_target"), F.col("target").alias("proposed_target"), (F.col("action") == "rejected_by_lock").alias("resolved"))


def stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


def latest_conflict(logged: DataFrame) -> DataFrame:
    """The open conflict of each source that came last."""
    return logged.where("not resolved").groupBy("source").agg(F.max_by("proposed_target", "arrival").alias("proposed_target"), F.max("arrival").alias("arrival"), F.count("*").alias("open"))


def frequent_runs(docs: DataFrame, known: DataFrame, pattern: str = r"[a-zäöüß]{9,}", least: int = 3, top: int = 20) -> DataFrame:
    """Frequent runs of a character class that are no known term: at least ``least`` times, the ``top`` first."""
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return runs.join(known.select(F.col("source").alias("token")), "token", "left_anti").orderBy(F.desc("n"), "token").limit(top)


def search(terms: DataFrame, needle: str, kind: str | None = None, only_conflicts: bool = False) -> DataFrame:
    """Terms (source, target, note, type, status) with ``needle`` in source, target or note, whatever the case; of one type or in conflict if so asked."""
    found = terms
    if needle.strip():
        low = F.lower(F.lit(needle.strip()))
        found = terms.where(F.coalesce(F.contains(F.lower("source"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("target"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("note"), low), F.lit(False)))
    found = found.where(F.col("type") == kind) if kind else found
    return found.where(F.col("status") == "conflict") if only_conflicts else found
