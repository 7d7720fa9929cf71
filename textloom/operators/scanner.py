"""The scan of translated segments: one row for each issue, numbered, of every kind."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.lineage import cut
from ..functions.punctuation import strip_fenced
from ..functions.text import HALF_WIDTH, KANA, KATAKANA_RUN, PLACEHOLDERS, first_line_with, numbers, paragraphs, strip
from . import lifecycle, matching
from .events import sequenced

# Kinds in the order of their issues within a segment, severities from the worst on, and the brackets that should be gone.
KINDS = ("empty", "residue", "terminology", "placeholder", "number", "punctuation", "paragraph", "suggestion")
SEVERITIES = ("error", "warn", "info")
BRACKETS = "[「」『』]"
# Of how many occurrences on a run of katakana may be a term, and how many are named.
SUGGEST_LEAST, SUGGEST_MOST = 3, 20
FOUND = "kind string, severity string, part bigint, detail string, line bigint, n bigint, found string, excerpt string"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def unfenced(c: str) -> Column:
    """The text with fenced lines blank; only texts that have a fence leave the JVM."""
    fenced = F.contains(F.col(c), F.lit("```")) | F.contains(F.col(c), F.lit("~~~"))
    return F.coalesce(strip_fenced(F.when(fenced, F.col(c))), F.col(c))


def _issue(kind: str, severity: str, part=0, detail=None, line=None, n=None, found=None, excerpt=None) -> Column:
    given = {"kind": kind, "severity": severity, "part": part, "detail": detail, "line": line, "n": n, "found": found, "excerpt": excerpt}
    types = dict(c.split() for c in FOUND.split(", "))
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast(types[k]).alias(k) for k, v in given.items()))


def _listed(c: Column, pattern: str, most: int, joint: str) -> Column:
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1))), 1, most), joint)


def _cut(c: Column) -> Column:
    return F.when(F.length(c) <= 60, c).otherwise(F.concat(F.left(c, F.lit(57)), F.lit("…")))


def text_issues(pairs: DataFrame, keys: list[str], residue: str = KANA, separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """The issues of each pair (keys, src, zh) that a look at both its texts shows, without a shuffle."""
    full = F.col("zh").isNotNull() & (strip(F.col("zh")) != "")
    both = pairs.where("src is not null").withColumns({"_src": unfenced("src"), "_zh": unfenced("zh")})
    lines = F.transform(F.split("_zh", "\n"), lambda t, i: F.struct(i.alias("i"), strip(t).alias("t"), F.regexp_extract_all(t, F.lit(f"({residue})"), 1).alias("c")))
    left = F.transform(
        F.filter(lines, lambda r: F.size(r["c"]) > 0),
        lambda r: _issue("residue", "error", part=r["i"], line=r["i"] + 1, n=F.size(r["c"]), found=F.array_join(F.slice(F.array_sort(F.array_distinct(r["c"])), 1, 20), ""), excerpt=_cut(r["t"])),
    )
    count = lambda c, p: F.regexp_count(F.col(c), F.lit(p))
    places = [F.when(count("_src", p) != count("_zh", p), _issue("placeholder", "error", part=i, detail=k, n=count("_zh", p) - count("_src", p), found=_listed(F.col("_src"), p, 5, ", "))) for i, (k, p) in enumerate(PLACEHOLDERS.items())]
    marks = [
        F.when(count("_zh", p) > 0, _issue("punctuation", severity, part=i, n=count("_zh", p), found=_listed(F.col("_zh"), p, 20, "")))
        for i, (p, severity) in enumerate(((BRACKETS, "warn"), (HALF_WIDTH, "info")))
    ]
    delta = F.size(paragraphs(F.col("zh"), separator)) - F.size(paragraphs(F.col("src"), separator))
    seen = F.concat(left, F.array_compact(F.array(*places, *marks, F.when(delta != 0, _issue("paragraph", "warn", n=delta)))))
    found = F.when(full, seen).otherwise(F.array(_issue("empty", "error", detail=F.when(F.col("zh").isNull(), "missing").otherwise("blank"))))
    return both.select(*keys, F.explode(found).alias("i")).select(*keys, "i.*")


def number_issues(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of the source that the target has fewer times: how many, and the first eight in order of the source.

    The target answers a number's first occurrences, so it is those after its count in the target that are missing.
    """
    full = pairs.where(F.col("zh").isNotNull() & (strip(F.col("zh")) != ""))
    nth = F.row_number().over(Window.partitionBy(*keys, "number").orderBy("pos"))
    src = full.select(*keys, F.posexplode(numbers(unfenced("src"))).alias("pos", "number")).withColumn("nth", nth)
    zh = full.select(*keys, F.explode(numbers(unfenced("zh"))).alias("number")).groupBy(*keys, "number").agg(F.count("*").alias("m"))
    missing = src.join(zh, [*keys, "number"], "left").where(F.col("nth") > F.coalesce("m", F.lit(0)))
    listed = missing.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("ns"))
    first = F.array_join(F.transform(F.slice("ns", 1, 8), lambda r: r["number"]), ", ")
    return listed.select(*keys, _issue("number", "warn", n=F.size("ns"), found=first).alias("i")).select(*keys, "i.*")


def term_issues(pairs: DataFrame, keys: list[str], terms: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Terms (source, target, type, aliases) that the source has more often than the target has their target.

    ``detail`` is the source, ``n`` how many are missing, ``found`` what may stand in their place: of the conflict log
    (source, arrival, proposed_target) the first proposal that the text has, else the source itself. Pairs without a
    target text are left to ``empty``.
    """
    full = pairs.where(F.col("zh").isNotNull() & (strip(F.col("zh")) != "")).withColumn("key", F.to_json(F.struct(*keys))).withColumn("_zh", F.col("zh"))
    bare = full.select("key", unfenced("src").alias("src"), unfenced("zh").alias("zh"))
    seen = matching.term_counts(bare, "key", "src", matching.keyed(terms)).join(terms.select("source", "target"), "source")
    targets = terms.select(F.col("target").alias("source")).distinct().withColumn("keys", F.array("source"))
    used = matching.term_counts(bare, "key", "zh", targets).withColumnsRenamed({"source": "target", "n": "m"})
    missed = seen.join(used, ["key", "target"], "left").withColumn("missing", F.col("n") - F.coalesce("m", F.lit(0))).where("missing > 0")
    texts = missed.join(full.select("key", *keys, F.col("_zh").alias("zh")), "key")
    log = logged if logged is not None else terms.limit(0).select("source", F.lit(0).cast("bigint").alias("arrival"), F.col("target").alias("proposed_target"))
    guessed = texts.join(lifecycle.wrong_renderings(texts.select("key", "source", "zh"), log), ["key", "source"])
    at = first_line_with(F.col("zh"), F.when(F.col("found") != "", F.col("found")).otherwise(F.col("source")))
    return guessed.select(*keys, _issue("terminology", "error", detail=F.col("source"), line=at["line"] + 1, n=F.col("missing"), found=F.col("found"), excerpt=at["excerpt"]).alias("i")).select(*keys, "i.*")


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else matching.normalized(t))


def suggestions(pairs: DataFrame, terms: DataFrame, pattern: str = KATAKANA_RUN, least: int = SUGGEST_LEAST, most: int = SUGGEST_MOST) -> DataFrame:
    """(position, source, n): runs of katakana that the sources have ``least`` times or more outside fences and that are no key
    of a term, the ``most`` frequent, equal ones in order; positions begin at 1."""
    runs = pairs.select(F.explode(F.regexp_extract_all(unfenced("src"), F.lit(f"({pattern})"), 1)).alias("source")).groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    known = matching.keyed(terms).select(F.explode("keys").alias("key")).where("key <> ''").select(_normalized("key").alias("key")).distinct()
    open_ = runs.join(known, _normalized("source") == F.col("key"), "left_anti")
    best = open_.orderBy(F.desc("n"), "source").limit(most)
    return best.select(F.row_number().over(Window.orderBy(F.desc("n"), "source")).alias("position"), "source", "n")


def qa_issues(pairs: DataFrame, keys: list[str], terms: DataFrame | None = None, logged: DataFrame | None = None, residue: str = KANA, separator: str = r"(?U)\n\s*\n", policy: str = "B", runs: str = KATAKANA_RUN) -> DataFrame:
    """All issues of the pairs with ``id``, from 1 without gaps: by ``keys``, the first of which must be a whole number, then by
    kind and place. Fenced lines are looked at only for their paragraphs. Pairs without a source are left out. Under policy A,
    where only the user adds terms, suggestions of terms come last, without keys."""
    parts = [text_issues(pairs, keys, residue, separator), number_issues(pairs, keys)] + ([term_issues(pairs, keys, terms, logged)] if terms is not None else [])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = cut(reduce(DataFrame.unionByName, parts).withColumn("_rank", rank))  # numbering reads them twice
    out = sequenced(rows, keys[0], then=(*keys[1:], "_rank", "part", "detail")).withColumnRenamed("seq", "id").select("id", *keys, *(c for c in _NAMES if c != "part"))
    if policy != "A" or terms is None:
        return out
    more = suggestions(pairs.where("src is not null"), terms, runs).withColumn("i", _issue("suggestion", "info", detail=F.col("source"), n=F.col("n")))
    kinds = {f.name: f.dataType for f in out.schema}
    return out.unionByName(more.select((F.col("position") + rows.count()).cast(kinds["id"]).alias("id"), *(F.lit(None).cast(kinds[k]).alias(k) for k in keys), *(F.col(f"i.{c}").alias(c) for c in _NAMES if c != "part")))


def qa_counts(issues: DataFrame) -> DataFrame:
    """(level, name, n) of issues by kind and by severity, zero where there are none."""
    names = issues.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(n).alias("name")) for level, ns in (("kind", KINDS), ("severity", SEVERITIES)) for n in ns))).alias("k")).select("k.*")
    found = issues.select(F.explode(F.array(F.struct(F.lit("kind").alias("level"), F.col("kind").alias("name")), F.struct(F.lit("severity").alias("level"), F.col("severity").alias("name")))).alias("k")).groupBy("k.level", "k.name").agg(F.count("*").alias("n"))
    return names.join(F.broadcast(found), ["level", "name"], "left").select("level", "name", F.coalesce("n", F.lit(0)).alias("n"))  # ten rows at most


def issue_order(issues: DataFrame, chunk: str) -> DataFrame:
    """Issues with the worst first, then by chunk (none: 0) and number."""
    worst = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return issues.orderBy(worst, F.coalesce(chunk, F.lit(0)), "id")
