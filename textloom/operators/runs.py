"""State of runs: which chunks count, what their events say, samples of a document, and settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

# Stages in order, and how a tier that is missing is replaced.
STAGES = ("S0", "S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8")
TIERS = {"fast": ("fast", "cheap", "strong"), "cheap": ("cheap", "strong"), "strong": ("strong",)}
# From how many characters on a reader's text is too long for it.
TOO_LONG = {30: 25, 50: 45, 100: 98}
# Parameters of the three presets.
PRESETS = {
    "fast": {"prescan": False, "style": False, "pre_extract": "off", "first_n": 10, "max_chars": 6000},
    "standard": {"prescan": True, "style": True, "pre_extract": "always", "first_n": 10, "max_chars": 4000},
    "fine": {"prescan": True, "style": True, "pre_extract": "always", "first_n": 20, "max_chars": 3000},
}


def with_preset(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the parameters of the preset that column ``name`` names; null where there is no such preset."""
    first = next(iter(PRESETS.values()))
    pick = lambda key: F.coalesce(*(F.when(F.col(name) == preset, F.lit(values[key])) for preset, values in PRESETS.items()))
    return rows.withColumns({key: pick(key) for key in first})


def valid_events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events of these types whose ``chunk`` and ``seq`` (strings as read) are whole numbers, as numbers."""
    whole = lambda c: F.when(F.col(c).cast("string").rlike(r"^-?[0-9]+$"), F.col(c).cast("string").try_cast("bigint"))
    return events.where(F.col("event_type").isin(*kinds)).withColumns({"chunk": whole("chunk"), "seq": whole("seq")}).where("chunk is not null and seq is not null")


def required_chunks(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """(run, chunk) that must have been extracted before: the finished ones among a run's total; settings (run, mode, first_n, total): ``off`` asks for none, ``firstNChunks`` for the first."""
    rows = chunks.join(settings, "run").where((F.col("status") == "done") & F.col("chunk").between(1, F.col("total")) & (F.col("mode") != "off"))
    return rows.where((F.col("mode") != "firstNChunks") | (F.col("chunk") <= F.col("first_n"))).select("run", "chunk")


def extract_order(required: DataFrame, events: DataFrame, first: str = "glossary_pre_extract", then: str = "chunk_translated") -> DataFrame:
    """(run, chunk, first_seq, then_seq, status) of the required chunks: ``missing`` without either event, ``out_of_order`` unless the first ``first`` came before the first ``then``."""
    least = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("seq")))
    seen = events.groupBy("run", "chunk").agg(least(first).alias("first_seq"), least(then).alias("then_seq"))
    status = F.when(F.col("first_seq").isNull() | F.col("then_seq").isNull(), "missing").when(F.col("first_seq") >= F.col("then_seq"), "out_of_order").otherwise("ok")
    return required.join(seen, ["run", "chunk"], "left").select("run", "chunk", "first_seq", "then_seq", status.alias("status"))


def stage_of(data: Column, stage: Column) -> Column:
    """The stage that an event's data (JSON) names, else its own."""
    inner = F.get_json_object(data, "$.stage")
    return F.coalesce(F.when(inner != "", inner), stage)


def stage_events(events: DataFrame) -> DataFrame:
    """(run, finished, skipped): the stages that a run's events (run, event_type, stage, data) tell of, sorted."""
    rows = events.select("run", "event_type", stage_of(F.col("data"), F.col("stage")).alias("stage")).where("stage is not null")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("event_type") == kind, F.col("stage"))))
    return rows.groupBy("run").agg(of("stage_finished").alias("finished"), of("stage_skipped").alias("skipped"))


def stage_index(c: Column) -> Column:
    """The place of a stage from 0 on; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), c), F.lit(0).cast("bigint")) - 1


def skipped_chunks(statuses: DataFrame) -> DataFrame:
    """(run, chunk) marked as skipped (key, status); keys that are no whole numbers are left out."""
    return statuses.where("status = 'skipped'").select("run", F.expr("try_cast(trim(key) as bigint)").alias("chunk")).where("chunk is not null").distinct()


def without_skipped(chunks: DataFrame, statuses: DataFrame) -> DataFrame:
    return chunks.join(skipped_chunks(statuses), ["run", "chunk"], "left_anti")


def chunk_ids(structure: DataFrame, files: DataFrame) -> DataFrame:
    """(run, chunk): those of a run's structure if it has any, else those of its files' names ``chunk_<n>.txt``."""
    told = structure.where("chunk is not null").select("run", "chunk").distinct()
    named = files.select("run", F.regexp_extract("name", r"^chunk_([0-9]+)\.txt$", 1).alias("n")).where("n <> ''").select("run", F.col("n").cast("bigint").alias("chunk"))
    return told.union(named.join(told.select("run").distinct(), "run", "left_anti"))


def char_totals(merged: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, chars): of the merged text (run, text) where there is one, else of all chunks (run, text)."""
    whole = merged.select("run", F.length("text").cast("bigint").alias("_w"))
    return chunks.groupBy("run").agg(F.sum(F.length("text")).alias("_c")).join(whole, "run", "full").select("run", F.coalesce("_w", "_c", F.lit(0)).alias("chars"))


def position_label(chunk: Column, first: Column, last: Column) -> Column:
    return F.when(chunk == first, "first").when(chunk == last, "last").otherwise("middle")


def sample_pack(samples: DataFrame, limit: int = 3000) -> DataFrame:
    """(doc_id, pack): a sample of chunks (doc_id, chunk, n_chunks, first, last, text) as one Markdown text.

    At most as many chunks of a document come in as were sampled, so the text of a group is bounded by the sample.
    """
    label = position_label(F.col("chunk"), F.col("first"), F.col("last"))
    part = F.concat(F.lit("## "), F.col("chunk").cast("string"), F.lit(" · "), label, F.lit("\n\n"), F.left("text", F.lit(limit)))
    rows = samples.groupBy("doc_id").agg(F.max("n_chunks").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", part.alias("part")))).alias("parts"))
    ids = F.array_join(F.transform("parts", lambda p: p["chunk"].cast("string")), ", ")
    head = F.concat(F.lit("# samples\n\n- chunks: "), F.col("n").cast("string"), F.lit("\n- sampled: "), ids, F.lit(f"\n- characters at most: {limit}\n\n"))
    return rows.select("doc_id", F.concat(head, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n"), F.lit("\n")).alias("pack"))


def recognised_texts(pages: DataFrame, lines: str = "\n", joint: str = "\n\n") -> DataFrame:
    """(doc, text, xml, json) of recognised lines (doc, page, line, text): lines one a line, pages apart; a page's elements in one set; contents as JSON."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    element = F.concat(F.lit('<LINE STRING="'), escaped, F.lit('"/>'))
    own = pages.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text", element.alias("element")))).alias("ls"))
    own = own.select("doc", "page", F.array_join(F.transform("ls", lambda x: x["text"]), lines).alias("text"), F.concat(F.lit("<PAGE>"), F.array_join(F.transform("ls", lambda x: x["element"]), ""), F.lit("</PAGE>")).alias("xml"), F.transform("ls", lambda x: x["text"]).alias("contents"))
    docs = own.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text", "xml", "contents"))).alias("ps"))
    each = lambda c: F.transform("ps", lambda p: p[c])
    return docs.select("doc", F.array_join(each("text"), joint).alias("text"), F.concat(F.lit("<OCRDATASET>\n"), F.array_join(each("xml"), "\n"), F.lit("\n</OCRDATASET>")).alias("xml"), F.to_json(F.struct(each("contents").alias("contents"), F.size("ps").alias("page_count"))).alias("json"))


def tier_of(tiers: Column, tier: str) -> Column:
    """The setting of a tier in a map; a missing one is that of the next cheaper one, in the end of the strong one."""
    return F.coalesce(*(F.try_element_at(tiers, F.lit(t)) for t in TIERS.get(tier, (tier, "strong"))))


def merged_settings(base: dict, override: dict) -> dict:
    """``override`` laid over ``base``, mappings inside them likewise."""
    return base | {k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """1 inside a polygon (array of x, y), -1 outside, 0 on a side that is level or upright; sides count where a ray to the right meets them."""
    n = F.size(points)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(points, k).alias("a"), F.get(points, (k + 1) % n).alias("b")))
    between = lambda v, p, q: v.between(F.least(p, q), F.greatest(p, q))
    level = lambda s: (s["a"]["y"] == s["b"]["y"]) & (y == s["a"]["y"]) & between(x, s["a"]["x"], s["b"]["x"])
    upright = lambda s: (s["a"]["x"] == s["b"]["x"]) & (x == s["a"]["x"]) & between(y, s["a"]["y"], s["b"]["y"])
    spans = lambda s: (F.least(s["a"]["y"], s["b"]["y"]) < y) & (y <= F.greatest(s["a"]["y"], s["b"]["y"]))
    meets = lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0))
    crossed = F.size(F.filter(sides, lambda s: spans(s) & (x <= meets(s))))
    return F.when(n < 1, -1).when(F.exists(sides, lambda s: level(s) | upright(s)), 0).when(crossed % 2 == 1, 1).otherwise(-1)


def cascade(lines: DataFrame, read: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(page, line, text, model): lines (page, line, predicted, width, height and what readers look at) through three readers.

    ``read`` has a function for 30, 50 and 100: it gets rows with ``half`` (0: the whole line, 1 and 2: its halves) and adds
    ``text``. A class of 3 starts with the small reader, of 2 with the middle one, all others and unknown ones with the large
    one; what turns out to have at least ``TOO_LONG`` characters goes on to the next. Of the large reader's long results wide
    lines are read again as two halves, whose texts are joined (model 200). A reader gets just the lines that reach it: each
    stage's texts are written down once, without what the reader looked at, and the next stage's lines are joined from them.
    A null text counts as empty; (page, line) must be unique.
    """
    key, said = ["page", "line"], F.length(F.coalesce("text", F.lit("")))

    def ask(rows: DataFrame, model: int) -> DataFrame:
        got = read[model](rows)
        return cut(got.select(*key, "half", "width", "height", F.coalesce("text", F.lit("")).alias("text")))

    def on(got: DataFrame, long: Column) -> DataFrame:
        return lines.join(got.where(long).select(*key), key, "left_semi")

    whole = lines.withColumn("half", F.lit(0))
    first = F.when(F.col("predicted") == 3, 30).when(F.col("predicted") == 2, 50).otherwise(100)
    small = ask(whole.where(first == 30), 30)
    middle = ask(whole.where(first == 50).unionByName(on(small, said >= TOO_LONG[30]).withColumn("half", F.lit(0))), 50)
    large = ask(whole.where(first == 100).unionByName(on(middle, said >= TOO_LONG[50]).withColumn("half", F.lit(0))), 100)
    split = (said >= TOO_LONG[100]) & F.coalesce(F.col("height") < F.col("width"), F.lit(False))
    halves = ask(on(large, split).withColumn("half", F.explode(F.array(F.lit(1), F.lit(2)))), 100)
    joined = halves.groupBy(*key).agg(F.concat(F.max(F.when(F.col("half") == 1, F.col("text"))), F.max(F.when(F.col("half") == 2, F.col("text")))).alias("text"))
    done = [(small.where(said < TOO_LONG[30]), 30), (middle.where(said < TOO_LONG[50]), 50), (large.where(~split), 100), (joined, 200)]
    return reduce(DataFrame.union, (rows.select(*key, "text", F.lit(model).alias("model")) for rows, model in done))
