"""Decisions on conflicts, and what a run still owes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(logged: DataFrame, choices: DataFrame) -> DataFrame:
    """The conflict log with every open conflict of a chosen source (source, target) closed by it."""
    picked = choices.select(F.col("source").alias("_s"), F.col("target").alias("resolution"))
    both = logged.join(picked, F.col("source") == F.col("_s"), "left")
    return both.withColumns({"resolution": F.when(~F.col("resolved"), F.col("resolution")), "resolved": F.col("resolved") | F.col("_s").isNotNull()}).drop("_s")


def decided(terms: DataFrame, choices: DataFrame, lock: bool = False) -> DataFrame:
    """Terms (source, target, locked, status) with the chosen targets, in order again and, if so asked, locked."""
    picked = choices.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
    both, hit = terms.join(picked, F.col("source") == F.col("_s"), "left"), F.col("_s").isNotNull()
    return both.withColumns({"target": F.coalesce("_t", "target"), "status": F.when(hit, "ok").otherwise(F.col("status")), "locked": F.col("locked") | (hit & F.lit(lock))}).drop("_s", "_t")


def new_conflicts(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    return after.join(before.select(key), key, "left_anti")


def wrong_renderings(missed: DataFrame, logged: DataFrame) -> DataFrame:
    """What stands in a text in place of a term's target: of texts (key, source, src_in_text, zh), the first proposed target
    in the log that the text has, else the source if the text has it, else nothing."""
    tried = missed.join(logged.select("source", "arrival", "proposed_target"), "source", "left")
    first = F.min(F.when(F.contains("zh", "proposed_target"), F.struct("arrival", "proposed_target")))
    found = tried.groupBy("key", "source").agg(first.alias("f"), F.first("zh").alias("zh"))
    return found.select("key", "source", F.coalesce("f.proposed_target", F.when(F.contains("zh", "source"), F.col("source")), F.lit("")).alias("found"))


def owed_artifacts(runs: DataFrame) -> DataFrame:
    """Runs (planned, finished, skipped, files: arrays of stages) with the stages that were planned and finished, not skipped,
    and left no file, and whether there are none."""
    due = F.array_except(F.array_intersect("planned", "finished"), F.coalesce("skipped", F.array().cast("array<string>")))
    owed = F.array_sort(F.array_except(due, F.coalesce("files", F.array().cast("array<string>"))))
    return runs.withColumn("owed", owed).withColumn("passed", F.size("owed") == 0)


def resume_reasons(runs: DataFrame, version: int = 1) -> DataFrame:
    """Runs with why each may not be resumed, the first that holds, empty if none does, and ``resumable``.

    Columns: enable_resume, schema_version, input_sha256 and params_sha256 as stored, now_input and now_params as they are, finished.
    A missing value differs from any other; a missing ``finished`` is not finished, a missing ``enable_resume`` is true.
    """
    same = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    reason = (
        F.when(~F.coalesce("enable_resume", F.lit(True)), "resume_disabled")
        .when(~same("schema_version", F.lit(version)), "schema_mismatch")
        .when(~same("input_sha256", F.col("now_input")), "input_changed")
        .when(~same("params_sha256", F.col("now_params")), "params_changed")
        .when(F.coalesce("finished", F.lit(False)), "finished")
        .otherwise("")
    )
    return runs.withColumn("reason", reason).withColumn("resumable", F.col("reason") == "")


def total_chunks(runs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, total): the first number above zero of structure, config and status (columns ``in_structure``, ``in_config``, ``in_status``),
    else how many chunks (key, chunk) there are from 1 on without a gap."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("chunk"))
    run = found.where("chunk >= 1").select(key, "chunk").distinct().withColumn("_n", nth).where("chunk = _n").groupBy(key).agg(F.count("*").alias("_n"))
    known = [F.when(F.col(c) > 0, F.col(c)) for c in ("in_structure", "in_config", "in_status")]
    return runs.join(run, key, "left").select(key, F.coalesce(*known, "_n", F.lit(0)).cast("bigint").alias("total"))


def policies(runs: DataFrame) -> DataFrame:
    """Runs (has_user, auto) with their policy, A to D, and what it allows."""
    user, auto = F.coalesce("has_user", F.lit(False)), F.coalesce("auto", F.lit(False))
    policy = F.when(user & ~auto, "A").when(user, "B").when(auto, "C").otherwise("D")
    return runs.withColumns({"policy": policy, "inserts": auto, "seeds": user, "maintains": user | auto, "suggests": user & ~auto})


def adopted(terms: DataFrame, found: DataFrame) -> DataFrame:
    """The user's terms (source, target, origin, locked, status) with found terms (source, target, arrival) taken over as locked user terms.

    A found term is new, or replaces one of the same target or one that is not locked. What was taken over is locked, so the
    first found term of a source decides its target. Sources of ``terms`` must be unique.
    """
    first = found.groupBy("source").agg(F.min_by("target", "arrival").alias("_t"))
    both = terms.join(first, "source", "full")
    takes = F.col("_t").isNotNull() & (F.col("target").isNull() | (F.col("target") == F.col("_t")) | ~F.coalesce("locked", F.lit(False)))
    pick = lambda c, new: F.when(takes, new).otherwise(F.col(c)).alias(c)
    return both.select("source", pick("target", F.col("_t")), pick("origin", F.lit("user")), pick("locked", F.lit(True)), pick("status", F.lit("ok")))


def folder_differences(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(path, problem) between a folder's files (path, sha256) and its copy's: ``missing``, ``changed`` or, only in the copy, ``orphan``."""
    a, b = source.select("path", F.col("sha256").alias("a"), F.lit(True).alias("in_a")), copy.select("path", F.col("sha256").alias("b"), F.lit(True).alias("in_b"))
    problem = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "orphan").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def compliance(order: DataFrame, owed: DataFrame, wanted: DataFrame, pending: DataFrame) -> DataFrame:
    """(check, passed) of a run: the order of events (status), owed artifacts (passed) and chunks still pending; without any
    wanted chunk the last one fails. ``all`` is their conjunction."""
    checks = order.agg((F.count_if(F.col("status") != "ok") == 0).alias("p")).select(F.lit("pre_extract_order").alias("check"), "p")
    checks = checks.union(owed.agg((F.count_if(~F.col("passed")) == 0).alias("p")).select(F.lit("stage_artifacts"), "p"))
    left = pending.agg(F.count("*").alias("_left"))
    whole = wanted.agg(F.count("*").alias("_n")).join(left, F.lit(True)).select(F.lit("chunk_complete"), ((F.col("_n") > 0) & (F.col("_left") == 0)).alias("p"))
    checks = checks.union(whole)
    return checks.withColumnRenamed("p", "passed").union(checks.agg(F.bool_and("p").alias("passed")).select(F.lit("all"), "passed"))


def marked(chunks: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, status) after marks (key, status, seq): the last mark of a chunk wins, chunks that were not there come in."""
    last = marks.groupBy(key).agg(F.max_by("status", "seq").alias("_s"))
    return chunks.select(key, "status").join(last, key, "full").select(key, F.coalesce("_s", "status").alias("status"))


def estimated_chunks(chars: Column, target: int) -> Column:
    """How many chunks of ``target`` characters a text will make; at least one."""
    return F.greatest(F.lit(1), F.ceil(chars / target)).cast("bigint")


def stale(updated: Column, now: Column, limit: int = 300) -> Column:
    """Whether the last sign of life lies more than ``limit`` seconds back; a run without any is not stale."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(updated) > limit, F.lit(False))


def progress_line(total: Column, done: Column, failed: Column) -> Column:
    """Progress as one line of a list; failed chunks are named only where there are some."""
    share = F.when(total > 0, F.floor(done * 100 / total)).otherwise(0)
    rest = F.when(failed > 0, F.concat(F.lit(", "), failed.cast("string"), F.lit(" failed"))).otherwise("")
    return F.concat(F.lit("- "), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), share.cast("string"), F.lit("%)"), rest)


def status_document(run: Column) -> Column:
    """A run's state (struct of stage_index, stage_total, stage_name, total, done, failed, skipped, terms, locked, open_conflicts,
    issues, misaligned, compliant, message) as Markdown; missing numbers are 0, other missing values are empty."""
    n = lambda c: F.coalesce(run[c], F.lit(0)).cast("string")
    s = lambda c: F.coalesce(run[c].cast("string"), F.lit(""))
    return F.concat(
        F.lit("### Stage "), (F.coalesce(run["stage_index"], F.lit(0)) + 1).cast("string"), F.lit("/"), n("stage_total"), F.lit(" · "), s("stage_name"),
        F.lit("\n\n- chunks: "), n("done"), F.lit("/"), n("total"), F.lit(" ("), n("failed"), F.lit(" failed, "), n("skipped"), F.lit(" skipped)"),
        F.lit("\n- terms: "), n("terms"), F.lit(" ("), n("locked"), F.lit(" locked), open conflicts: "), n("open_conflicts"),
        F.lit("\n- issues: "), n("issues"), F.lit(", misaligned: "), n("misaligned"), F.lit("\n- compliant: "), s("compliant"), F.lit("\n- "), s("message"), F.lit("\n"),
    )


# The policies, the one of stores without a known one, and the newest layout of a store that is understood.
POLICIES, OTHER_POLICY, VERSION = ("A", "B", "C", "D"), "C", 1


def guarded(stores: DataFrame, version: int = VERSION) -> DataFrame:
    """Stores (schema_version, policy) with the policy that holds, C for an unknown or missing one, and whether each is
    ``refused``: its layout is newer than ``version``. A missing or unreadable version is taken for the present one."""
    number = F.col("schema_version").cast("string").try_cast("bigint")
    return stores.withColumns({"policy": F.when(F.col("policy").isin(*POLICIES), F.col("policy")).otherwise(OTHER_POLICY), "refused": F.coalesce(number > version, F.lit(False))})


def admitted(stores: DataFrame, version: int = VERSION) -> DataFrame:
    """The same, but a refused store ends the job, so that no old program writes over a newer layout."""
    seen = guarded(stores, version)
    stop = F.raise_error(F.concat(F.lit("schema_version "), F.col("schema_version").cast("string"), F.lit(f" is newer than {version}")))
    return seen.withColumn("policy", F.when(F.col("refused"), stop).otherwise(F.col("policy"))).drop("refused")
