"""The glossary's write path: candidates against terms under a policy, the log of conflicts, decisions, rows for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .events import sequenced

# Types of terms, the one of terms without any and the one of unknown types; origins and states.
TYPES = ("人物", "地名", "组织", "术语", "招式", "物品", "称谓", "敬称", "口癖", "固定表达", "其他")
DEFAULT_TYPE, OTHER_TYPE = "术语", "其他"
ORIGINS, STATES = ("user", "auto"), ("ok", "conflict")
NO_CHUNK = 1 << 30
CANDIDATE = ("source", "target", "reading", "type", "gender", "aliases", "note", "origin", "locked", "chunk")


def normal_type(c: Column) -> Column:
    """The type without white space around it; unknown ones are one, a missing one is the default."""
    s = F.coalesce(strip(c), F.lit(""))
    return F.when(s == "", DEFAULT_TYPE).when(s.isin(*TYPES), s).otherwise(OTHER_TYPE)


def normal_origin(c: Column) -> Column:
    return F.when(c.isin(*ORIGINS), c).otherwise("auto")


def normal_state(c: Column) -> Column:
    return F.when(c.isin(*STATES), c).otherwise("ok")


def clean_aliases(aliases: Column, source: Column) -> Column:
    """Distinct, sorted, stripped, without blanks and the source."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(aliases, none), lambda x: F.coalesce(strip(x), F.lit(""))), lambda x: (x != "") & (x != source))))


def _judged(terms: DataFrame, candidates: DataFrame, policy: str) -> DataFrame:
    """Candidates with stripped keys, the target that the store keeps (``_base``) and ``outcome``."""
    text = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    keyed = candidates.withColumns({"source": text("source"), "target": text("target")})
    valid = (F.col("source") != "") & (F.col("target") != "")
    firsts = keyed.where(valid).groupBy("source").agg(F.min_by("target", "arrival").alias("_first"), F.min("arrival").alias("_at"), F.min_by("locked", "arrival").alias("_lock"), F.min_by("origin", "arrival").alias("_from"))
    had = terms.select(F.col("source").alias("_s"), F.col("target").alias("_had"), F.coalesce("locked", F.lit(False)).alias("_locked"))
    rows = keyed.join(had, F.col("source") == F.col("_s"), "left").join(firsts.withColumnRenamed("source", "_f"), F.col("source") == F.col("_f"), "left")
    known = F.col("_s").isNotNull()
    locked = F.when(known, F.col("_locked")).otherwise((normal_origin(F.col("_from")) == "user") | F.coalesce("_lock", F.lit(False)))
    base = F.coalesce("_had", "_first")
    outcome = (
        F.when(~valid, "invalid").when(F.lit(policy == "D"), "rejected_by_policy").when(F.lit(policy == "A") & ~known, "rejected_by_policy")
        .when(~known & (F.col("arrival") == F.col("_at")), "inserted").when(F.col("target") == base, "unchanged").when(locked, "rejected_by_lock").otherwise("conflict")
    )
    return rows.withColumns({"_base": base, "outcome": outcome}).drop("_s", "_f", "_had", "_locked", "_first", "_at", "_lock", "_from")


def upsert_outcomes(terms: DataFrame, candidates: DataFrame, policy: str = "B") -> DataFrame:
    """(arrival, source, target, outcome) of each candidate, as if they came one by one in order of ``arrival``, which must be unique.

    A target once there never changes, so what a candidate does follows from the store's target of its source, or else
    from the first candidate's. Policy A inserts nothing, D takes nothing at all.
    """
    return _judged(terms, candidates, policy).select("arrival", "source", "target", "outcome")


def upserted(terms: DataFrame, candidates: DataFrame, policy: str = "B") -> DataFrame:
    """``terms`` (source, target, reading, type, gender, aliases, note, origin, locked, status, first_chunk) after all ``candidates``
    (arrival, source, target, reading, type, gender, aliases, note, origin, locked, chunk).

    Candidates with the store's target add their aliases and, in order of arrival, fill in reading, gender, note and a type
    that is still the default one; any other target makes an unlocked term a conflict. The first chunk of a source stays.
    All of it is minima and sets by source, summed before the shuffle.
    """
    judged = _judged(terms, candidates, policy)
    same, text = F.col("outcome").isin("inserted", "unchanged"), lambda c: F.coalesce(F.col(c), F.lit(""))
    least = lambda value, given: F.min_by(F.when(given, value), F.when(given, F.col("arrival")))
    inserted = F.col("outcome") == "inserted"
    kind = F.when(inserted, normal_type(F.col("type"))).otherwise(F.when(text("type") == "", DEFAULT_TYPE).otherwise(normal_type(F.col("type"))))
    takes = judged.where("outcome in ('inserted', 'unchanged', 'conflict')").groupBy(F.col("source").alias("_s")).agg(
        F.bool_or(inserted).alias("_new"), F.bool_or(same).alias("_same"), F.bool_or(F.col("outcome") == "conflict").alias("_conflict"), F.first("_base").alias("_target"),
        *(least(F.col(c), same & (text(c) != "")).alias(f"_{c}") for c in ("reading", "gender", "note")),
        least(kind, same & (kind != DEFAULT_TYPE)).alias("_type"), least(F.struct("origin", F.coalesce("locked", F.lit(False)).alias("locked"), "chunk"), inserted).alias("_made"),
    )
    # one row for each source and alias before they are listed, so a source with many candidates gathers only different ones
    named = judged.where(same).select(F.col("source").alias("_n"), F.explode("aliases").alias("_a")).distinct().groupBy("_n").agg(F.collect_list("_a").alias("_aliases"))
    takes = takes.join(named, F.col("_s") == F.col("_n"), "left")
    both = terms.join(takes, F.col("source") == F.col("_s"), "full")
    new, source = F.coalesce("_new", F.lit(False)), F.coalesce("source", "_s")
    fill = lambda c: F.coalesce(F.when(text(c) != "", F.col(c)), F.col(f"_{c}"), F.lit("")).alias(c)
    none = F.array().cast("array<string>")
    rows = both.where("source is not null or _new").select(
        source.alias("source"), F.coalesce("target", "_target").alias("target"), fill("reading"),
        F.when(new, F.coalesce("_type", F.lit(DEFAULT_TYPE))).when(F.col("type") == DEFAULT_TYPE, F.coalesce("_type", "type")).otherwise(F.col("type")).alias("type"), fill("gender"),
        F.when(F.coalesce("_same", F.lit(False)), clean_aliases(F.concat(F.coalesce("aliases", none), F.coalesce("_aliases", none)), source)).otherwise(F.coalesce("aliases", none)).alias("aliases"),
        fill("note"), F.when(new, normal_origin(F.col("_made.origin"))).otherwise(F.col("origin")).alias("origin"),
        F.when(new, (normal_origin(F.col("_made.origin")) == "user") | F.col("_made.locked")).otherwise(F.col("locked")).alias("locked"),
        F.when(F.coalesce("_conflict", F.lit(False)), "conflict").when(new, "ok").otherwise(F.col("status")).alias("status"),
        F.when(new, F.col("_made.chunk")).otherwise(F.col("first_chunk")).alias("first_chunk"),
    )
    return rows


def upsert_log(terms: DataFrame, candidates: DataFrame, policy: str = "B", start: int = 0) -> DataFrame:
    """(id, source, existing_target, proposed_target, chunk, phase, resolved, resolution, arrival): conflicts in order of arrival, from ``start`` + 1."""
    rows = _judged(terms, candidates, policy).where("outcome in ('conflict', 'rejected_by_lock')")
    by_lock = F.col("outcome") == "rejected_by_lock"
    return sequenced(rows, "arrival", start).select(F.col("seq").alias("id"), "source", F.col("_base").alias("existing_target"), F.col("target").alias("proposed_target"), "chunk", "phase", by_lock.alias("resolved"), F.when(by_lock, "rejected_by_lock").otherwise("").alias("resolution"), "arrival")


def choices(picks: DataFrame, terms: DataFrame, logged: DataFrame) -> DataFrame:
    """(source, target) of picks (source, target, take, conflict_id): a target that is named, the term's own (``existing``), or a
    proposed one: of the conflict with that id, if it is of this source, else of the last open one. Picks without any are left out."""
    last = logged.where("not resolved").groupBy(F.col("source").alias("_l")).agg(F.max_by("proposed_target", F.struct("arrival", "id")).alias("_last"))
    one = logged.select(F.col("id").alias("_i"), F.col("source").alias("_is"), F.col("proposed_target").alias("_one"))
    own = terms.select(F.col("source").alias("_t"), F.col("target").alias("_own"))
    rows = picks.join(own, F.col("source") == F.col("_t")).join(last, F.col("source") == F.col("_l"), "left").join(one, (F.col("conflict_id") == F.col("_i")) & (F.col("source") == F.col("_is")), "left")
    named = F.when(F.coalesce("target", F.lit("")) != "", F.col("target"))
    proposed = F.when(F.col("conflict_id").isNull(), F.col("_last")).otherwise(F.col("_one"))
    return rows.select("source", F.when(named.isNotNull(), named).when(F.col("take") == "existing", F.col("_own")).when(F.col("take") == "proposed", proposed).alias("target")).where("target is not null")


def prompt_rows(hits: DataFrame, most: int = 400, by: str = "doc_id") -> DataFrame:
    """The terms (with locked, hits, first_chunk and the seven fields) that a prompt of each ``by`` gets, ``position`` by type and source.

    Of more than ``most`` (0: of any number all stay) the locked ones come first, then those with most hits, those seen in an
    earlier chunk, and those first by type and source; ``truncated`` says that some are left out.
    """
    own = Window.partitionBy(by)
    order = [~F.coalesce("locked", F.lit(False)), F.desc("hits"), F.coalesce("first_chunk", F.lit(NO_CHUNK)), "type", "source"]
    ranked = hits.withColumns({"_rank": F.row_number().over(own.orderBy(*order)), "truncated": (F.count("*").over(own) > most) & F.lit(most > 0)})
    kept = ranked.where((F.col("_rank") <= most) | F.lit(most == 0)).withColumn("position", F.row_number().over(own.orderBy("type", "source")))
    return kept.select(by, "position", "source", "target", "type", "locked", "aliases", "note", "status", "truncated")


def store_stats(terms: DataFrame, logged: DataFrame) -> DataFrame:
    """(level, name, n): terms, locked ones, automatic ones, open conflicts; terms by type and by status."""
    totals = terms.agg(F.count("*").alias("terms"), F.count_if("locked").alias("locked"), F.count_if(F.col("origin") == "auto").alias("auto"))
    totals = totals.unpivot([], ["terms", "locked", "auto"], "name", "n").select(F.lit("total").alias("level"), "name", "n")
    open_ = logged.agg(F.count_if(~F.col("resolved")).alias("n")).select(F.lit("total").alias("level"), F.lit("open_conflicts").alias("name"), "n")
    by = lambda c: terms.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(f"by_{c}").alias("level"), "name", "n")
    return totals.union(open_).union(by("type")).union(by("status"))
