"""Event log: sequence numbers, order of events, pending work, use and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def happens_before(events: DataFrame, first: str, then: str, key: str, seq: str) -> DataFrame:
    """Per key that has ``then``: whether its first ``first`` came before its first ``then``."""
    least = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col(seq)))
    seen = events.groupBy(key).agg(least(first).alias("first_seq"), least(then).alias("then_seq")).where("then_seq is not null")
    return seen.select(key, "first_seq", "then_seq", F.when(F.col("first_seq").isNull(), "missing").when(F.col("first_seq") >= F.col("then_seq"), "out_of_order").otherwise("ok").alias("status"))


def sequenced(events: DataFrame, order: str, start: int = 0, width: int = 10_000, then: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """Gap-free ``seq`` in order of the whole number ``order``, at equal ones of the columns ``then``, for all rows or for each value of ``by``.

    Rows are numbered within ranges of ``width`` values, and each range adds what lies before it. Ranges are summed in groups of
    ``width`` first, so of all rows, or of one hot value of ``by``, only one count per group, that is one for each ``width`` squared
    values, meets in a single task.
    """
    ranged = events.withColumns({"_key": F.lit(0) if by is None else F.col(by), "_range": F.floor(F.col(order) / width)})
    counts = ranged.groupBy("_key", "_range").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_range") / width))
    groups = counts.groupBy("_key", "_group").agg(F.sum("_n").alias("_all"))
    above = groups.select(F.col("_key").alias("_gk"), F.col("_group").alias("_g"), (F.sum("_all").over(Window.partitionBy("_key").orderBy("_group")) - F.col("_all")).alias("_above"))
    within = F.sum("_n").over(Window.partitionBy("_key", "_group").orderBy("_range")) - F.col("_n")
    same = F.col("_key").eqNullSafe(F.col("_gk")) & (F.col("_group") == F.col("_g"))
    before = counts.join(above, same).select(F.col("_key").alias("_rk"), F.col("_range").alias("_r"), (within + F.col("_above")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(order, *then))
    joined = ranged.withColumn("_own", own).join(before, F.col("_key").eqNullSafe(F.col("_rk")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("seq", (F.col("_own") + F.col("_before") + start).cast("bigint")).drop("_key", "_range", "_own", "_rk", "_r", "_before")


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def status_counters(rows: DataFrame, status: str, done: str, failed: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col(status) == s)
    return rows.agg(F.count("*").alias("total"), is_(done).alias("done"), is_(failed).alias("failed"), (F.count("*") - is_(done) - is_(failed)).alias("pending"))


def usage_facts(events: DataFrame) -> DataFrame:
    """(tier, stage, tokens, hit): the event's type, a bucket of its property, whole value; a stage may be missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(F.col("event_type").alias("tier"), F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 4).cast("string"))).alias("stage"), F.floor("value").cast("bigint").alias("tokens"), (k % 2 == 0).alias("hit"))


def usage_rollup(facts: DataFrame) -> DataFrame:
    """Calls, tokens and hit rate by tier, by stage (calls without one are left out there), and in all, in one pass."""
    rate = F.coalesce(F.bround(F.sum(F.when(F.col("hit"), F.col("tokens")).otherwise(0)) / F.when(F.sum("tokens") != 0, F.sum("tokens")), 4), F.lit(0.0))
    sums = facts.groupingSets([[F.col("tier")], [F.col("stage")], []], F.col("tier"), F.col("stage")).agg(F.grouping_id().alias("set"), F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), rate.alias("hit_rate"))
    level = F.when(F.col("set") == 1, "tier").when(F.col("set") == 2, "stage").otherwise("total")
    # Without any call there is still a total.
    none = facts.groupBy().agg(F.count("*").alias("calls")).where("calls = 0").select(F.lit("total"), F.lit("all"), "calls", F.lit(None).cast("bigint"), F.lit(0.0))
    return sums.where("set <> 2 or stage is not null").select(level.alias("level"), F.when(F.col("set") == 3, "all").otherwise(F.coalesce("tier", "stage")).alias("name"), "calls", "tokens", "hit_rate").where("level <> 'total' or calls > 0").union(none)


def usage_cost(facts: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Cost by tier from (price of hits, price of misses) a million tokens; null for a tier without a price."""
    table = facts.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(h).alias("p_hit"), F.lit(m).alias("p_miss")) for t, (h, m) in prices.items()))).alias("p")).select("p.*")
    sums = facts.groupBy("tier").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("tokens"))), F.lit(0)).alias("hit_tokens"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("tokens"))), F.lit(0)).alias("miss_tokens"))
    return sums.join(table, "tier", "left").select("tier", "hit_tokens", "miss_tokens", F.bround((F.col("hit_tokens") * F.col("p_hit") + F.col("miss_tokens") * F.col("p_miss")) / 1e6, 6).alias("cost"))


def cascade_route(lines: DataFrame) -> DataFrame:
    """Which of three models a line goes to by its predicted length, and whether it is split in halves."""
    n = F.length("para")
    return lines.select("doc_id", "para_idx", n.alias("predicted"), F.when(n < 25, 30).when(n < 45, 50).otherwise(100).alias("model"), (n >= 98).alias("halved"))


def usage_samples(calls: DataFrame, flat: str = "deepseek") -> DataFrame:
    """Calls (provider, usage as JSON) with prompt, completion, total, hit and miss tokens.

    Totals that are missing or zero are the sum of both sides. A ``flat`` provider says hits and misses itself; for any other
    misses follow from the cached tokens and are zero, like the hits, without them. A null or broken usage
    is left out; a field that is missing or not a number counts as zero.
    """
    number = lambda path: F.coalesce(F.get_json_object("usage", path).try_cast("bigint"), F.lit(0))
    cached = F.get_json_object("usage", "$.prompt_tokens_details.cached_tokens")
    prompt, completion, total = number("$.prompt_tokens"), number("$.completion_tokens"), number("$.total_tokens")
    is_flat, hit = F.coalesce(F.col("provider") == flat, F.lit(False)), F.coalesce(cached.try_cast("bigint"), F.lit(0))
    return calls.where(F.get_json_object("usage", "$").isNotNull() & F.startswith(F.ltrim("usage"), F.lit("{"))).withColumns({
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "total_tokens": F.when(total != 0, total).otherwise(prompt + completion),
        "hit_tokens": F.greatest(F.lit(0), F.when(is_flat, number("$.prompt_cache_hit_tokens")).otherwise(hit)),
        "miss_tokens": F.greatest(F.lit(0), F.when(is_flat, number("$.prompt_cache_miss_tokens")).when(cached.isNull(), 0).otherwise(F.greatest(F.lit(0), prompt - hit))),
    })
