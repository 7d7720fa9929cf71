"""Further queries, with the SQL that they are checked against: excerpts, rules, plans, pairing, boxes, repair and decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import punctuation
from ..functions.text import paragraphs
from ..operators import cells, events, glossary, imports, layout, matching, quality
from ..sources import readers
from . import registry as r
from .registry import table

Query = Callable[[SparkSession, str], DataFrame]
EXCERPT = 600
#: Rules in order: (role, turn); None fits anything.
RULES = (("assistant", 1), ("user", 0), (None, 3), ("user", None), (None, None))


def excerpt(docs: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """Leading paragraphs of a document within ``limit`` characters, joints counted; the first is never cut."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def take(s, p):
        fits = (F.size(s["out"]) == 0) | (s["used"] + F.length(p) <= limit)
        return F.struct((s["used"] + F.length(p) + 2).alias("used"), F.when(fits, F.concat(s["out"], F.array(p))).otherwise(s["out"]).alias("out"))

    folded = F.aggregate(paragraphs(F.col("text"), r"\n"), start, take)
    return docs.select("doc_id", F.array_join(folded["out"], "\n\n").alias("excerpt"))


def rule_match(turns: DataFrame, rules=RULES) -> DataFrame:
    """The first rule that fits each turn, and null if none does; the rules are part of the expression."""
    fits = lambda role, turn: (F.lit(True) if role is None else F.col("role") == role) & (F.lit(True) if turn is None else F.col("turn") == turn)
    return turns.select("conv_id", "turn", F.coalesce(*(F.when(fits(*r), i) for i, r in enumerate(rules))).alias("rule"))


def stage_plan(jobs: DataFrame, key: str, n: str, sampled: int = 60, sample: int = 30) -> DataFrame:
    """Path, kind of prescan and number of samples of a job of ``n`` chunks."""
    simple = F.col(n).between(1, 2)
    scan = F.when(simple, "off").when(F.col(n) > sampled, "sampled").otherwise("full")
    stages = F.concat_ws(",", F.lit("S0"), F.lit("S1"), F.when(~simple, "S2"), F.lit("S4"), F.when(F.col(n) != 1, "S5"), F.lit("S6"), F.lit("S8"))
    count = F.when(simple, 0).when(F.col(n) > sampled, sample).otherwise(F.col(n)).cast("bigint")
    return jobs.select(key, F.when(simple, "simple").otherwise("full").alias("path_mode"), scan.alias("prescan"), count.alias("n_samples"), stages.alias("stages"))


def bilingual(pairs: DataFrame) -> DataFrame:
    """Paragraphs of both sides by position, null where a side has no more."""
    both = F.arrays_zip(F.coalesce(paragraphs(F.col("src"), r"\n"), F.array().cast("array<string>")).alias("src"), F.coalesce(paragraphs(F.col("zh"), r"\n"), F.array().cast("array<string>")).alias("zh"))
    return pairs.select("conv_id", "turn", F.posexplode(both).alias("para", "p")).select("conv_id", "turn", "para", "p.src", "p.zh")


def longest_low_run(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The longest run of each key's least value in order."""
    by = Window.partitionBy(key)
    marked = rows.select(key, order, (F.col(value) == F.min(value).over(by)).alias("low"), F.row_number().over(by.orderBy(order)).alias("i")).where("low")
    islands = marked.withColumn("island", F.col("i") - F.row_number().over(by.orderBy("i")))
    return islands.groupBy(key, "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def timings(rows: DataFrame, key: str, value: str) -> DataFrame:
    cut = lambda c: F.bround(c, 4)
    return rows.groupBy(key).agg(F.count("*").alias("n"), cut(F.sum(value)).alias("total"), cut(F.avg(value)).alias("mean"), cut(F.median(value)).alias("median"))


def page_text(pages: DataFrame) -> DataFrame:
    """All text of a page, tags taken out and white space made one space."""
    bare = F.regexp_replace("html", r"<[^>]*>", " ")
    return pages.select("page_id", F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " ")).alias("text"))


def _boxes(lines: DataFrame, size: int) -> DataFrame:
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") * 37 % 1000
    return lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), x.alias("x0"), y.alias("y0"), (x + size + F.col("l_linenumber") * 10).alias("x1"), (y + size).alias("y1"))


def _line_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return layout.lines_in_blocks(_boxes(lines.where("l_linenumber > 2"), 20), _boxes(lines.where("l_linenumber <= 2"), 400))


def _dup_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return layout.dup_lines(_boxes(lines, 800).withColumn("conf", (F.col("x0") % 100 / 100).cast("double")))


def _papers(orders: DataFrame, least: int, size: int, name: str = "box") -> DataFrame:
    """Boxes made of a customer's orders: those whose key leaves 0 over three (``least`` 0), the others (1), or all (-1)."""
    x, y, k = F.col("o_orderkey") * 7 % 1000, F.col("o_orderkey") * 13 % 1000, F.col("o_orderkey")
    return orders.where((k % 3 == 0) if least == 0 else (k % 3 > 0) if least > 0 else F.lit(True)).select(F.col("o_custkey").alias("page"), k.alias(name), x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"), "o_orderpriority", "o_orderstatus")


def _owners(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "ad").otherwise("table")
    return cells.line_owners(_papers(orders, 1, 20).withColumn("score", F.col("box") % 10 / 10), _papers(orders, 0, 400, "block").withColumn("kind", kind))


def _cell_texts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return cells.cell_texts(_papers(orders, 1, 20).withColumnRenamed("o_orderpriority", "text"), _papers(orders, 0, 400, "cell"))


def _import(spark: SparkSession, d: str, overwrite: bool) -> DataFrame:
    part = table(spark, d, "part")
    had = part.where("p_size = 50").groupBy(F.col("p_name").alias("source")).agg(F.max_by("p_brand", "p_partkey").alias("target"))
    return imports.import_outcomes(had, part.where("p_size <> 50").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("arrival")), overwrite)


def _usage_merge(spark: SparkSession, d: str) -> DataFrame:
    """Use of two runs: events of even and of odd numbers."""
    e = table(spark, d, "events")
    part = lambda k: events.usage_rollup(events.usage_facts(e.where(F.col("event_id") % 2 == k)))
    return imports.usage_merge(part(0), part(1))


def _gates(spark: SparkSession, d: str) -> DataFrame:
    return imports.gates(quality.align_issues(quality.pairs(table(spark, d, "conversations"))), _term_rate(spark, d), glossary.conflicts(r._merged(spark, d)))


def _term_rate(spark: SparkSession, d: str) -> DataFrame:
    terms = glossary.ascii_terms(table(spark, d, "benchmark")).select("source", F.col("source").alias("target"), F.lit("").alias("type"), F.lit(None).cast("array<string>").alias("aliases"))
    pairs = quality.pairs(table(spark, d, "conversations")).withColumn("pair", F.concat_ws(":", "conv_id", "turn"))
    return matching.term_rate(pairs, "pair", terms)


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark tokens through the automaton that terms of any script take."""
    terms = glossary.ascii_terms(table(spark, d, "benchmark")).withColumn("keys", F.array("source"))
    return matching.term_counts(table(spark, d, "documents"), "doc_id", "text", terms)


def _broken(c: str):
    """JSON without the quotes of its names and with a comma too many."""
    return F.regexp_replace(F.replace(F.col(c), F.lit('"'), F.lit("")), r"\}$", ",}")


def queries() -> dict[str, Query]:
    return {
        "excerpt": lambda s, d: excerpt(table(s, d, "documents")),
        "chat_rule_match": lambda s, d: rule_match(table(s, d, "conversations")),
        "stage_plan": lambda s, d: stage_plan(table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n"),
        "bilingual_pairs": lambda s, d: bilingual(quality.pairs(table(s, d, "conversations"))),
        "longest_low_run": lambda s, d: longest_low_run(table(s, d, "events").withColumn("bucket", F.get_json_object("props", "$.k").cast("int") % 3), "user_id", "event_id", "bucket"),
        "timing_summary": lambda s, d: timings(table(s, d, "events"), "event_type", "value"),
        "last_events": lambda s, d: table(s, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(500),
        "page_text": lambda s, d: page_text(table(s, d, "pages")),
        "line_block_join": _line_blocks,
        "dup_lines": _dup_lines,
        "layout_order": lambda s, d: layout.layout_order(_boxes(table(s, d, "lineitem"), 50)),
        "line_owners": _owners,
        "cell_texts": _cell_texts,
        "merged_cells": lambda s, d: cells.merged_cells(_papers(table(s, d, "orders"), -1, 300)),
        "glossary_import": lambda s, d: _import(s, d, False),
        "glossary_overwrite": lambda s, d: _import(s, d, True),
        "usage_merge": _usage_merge,
        "gates": _gates,
        "term_rate": _term_rate,
        "term_counts_any_script": _scripts,
        "conflict_filter": lambda s, d: glossary.conflicts(r._merged(s, d)).where("not resolved").select("source", "nth", "existing_target", "proposed_target"),
        "export_projection": lambda s, d: r._merged(s, d).where("action = 'inserted'").select("source", "target", F.lit("auto").alias("origin")),
        "json_repair": lambda s, d: table(s, d, "events").select("event_id", punctuation.repair_json(_broken("props")).alias("r")).select("event_id", "r.*"),
        "json_strings": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(readers.json_strings(F.to_json(F.struct("lang", "source", "text"))), "|").alias("found")),
        "decode_text": lambda s, d: table(s, d, "documents").select("doc_id", readers.decode_text(F.encode("text", "UTF-8")).alias("text")),
        "fence_strip": lambda s, d: table(s, d, "documents").select("doc_id", punctuation.strip_fenced(F.concat(F.lit("~~~\nx\n```\n~~~\n"), "text")).alias("text")),
        "punct_normalize": lambda s, d: table(s, d, "documents").select("doc_id", punctuation.normalize_punctuation("text").alias("r")).select("doc_id", "r.*"),
        "bracket_residue": lambda s, d: table(s, d, "documents").select("doc_id", punctuation.bracket_counts(F.concat(F.lit("「`『』` "), "text")).alias("r")).select("doc_id", "r.*"),
    }


_PAPER = "SELECT o_custkey AS page, o_orderkey AS {1}, o_orderkey * 7 % 1000 AS x0, o_orderkey * 13 % 1000 AS y0, o_orderkey * 7 % 1000 + {0} AS x1, o_orderkey * 13 % 1000 + {0} AS y1, o_orderpriority AS text, CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'ad' ELSE 'table' END AS kind FROM orders WHERE o_orderkey % 3 {2} 0"
_IN = "l.page = b.page AND {0} BETWEEN b.x0 AND b.x1 AND {1} BETWEEN b.y0 AND b.y1"
_IMPORT = """had AS (SELECT p_name AS source, arg_max(p_brand, p_partkey) AS had FROM part WHERE p_size = 50 GROUP BY p_name),
i AS (SELECT p_partkey AS arrival, p_name AS source, p_brand AS target, had, first(p_brand) OVER v AS f, row_number() OVER v AS rank FROM part LEFT JOIN had ON p_name = source WHERE p_size <> 50 WINDOW v AS (PARTITION BY p_name ORDER BY p_partkey))"""
_BOX = "SELECT l_orderkey AS page, l_linenumber AS box, l_partkey % 1000 AS x0, l_suppkey * 37 % 1000 AS y0, l_partkey % 1000 + {0} + l_linenumber * 10 AS x1, l_suppkey * 37 % 1000 + {0} AS y1 FROM lineitem"


def oracle_sql() -> dict[str, str]:
    ps = f"list_filter(list_transform(string_split({{}}, chr(10)), lambda x: {r._STRIP.format('x')}), lambda x: x <> '')"
    out = {
        "excerpt": f"WITH {r._PARAS}, c AS (SELECT *, coalesce(sum(length(para) + 2) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p) SELECT d.doc_id, coalesce(excerpt, '') AS excerpt FROM d LEFT JOIN (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY para_idx) AS excerpt FROM c WHERE para_idx = 0 OR used + length(para) <= {EXCERPT} GROUP BY doc_id) USING (doc_id)",
        "chat_rule_match": "SELECT conv_id, turn, (CASE WHEN role = 'assistant' AND turn = 1 THEN 0 WHEN role = 'user' AND turn = 0 THEN 1 WHEN turn = 3 THEN 2 WHEN role = 'user' THEN 3 ELSE 4 END)::INTEGER AS rule FROM conversations",
        "stage_plan": "SELECT conv_id, CASE WHEN n <= 2 THEN 'simple' ELSE 'full' END AS path_mode, CASE WHEN n <= 2 THEN 'off' WHEN n > 60 THEN 'sampled' ELSE 'full' END AS prescan, (CASE WHEN n <= 2 THEN 0 WHEN n > 60 THEN 30 ELSE n END)::BIGINT AS n_samples, CASE WHEN n = 1 THEN 'S0,S1,S4,S6,S8' WHEN n = 2 THEN 'S0,S1,S4,S5,S6,S8' ELSE 'S0,S1,S2,S4,S5,S6,S8' END AS stages FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)",
        "bilingual_pairs": f"WITH {r._PAIRS}, a AS (SELECT conv_id, turn, coalesce({ps.format('src')}, []) AS a, coalesce({ps.format('zh')}, []) AS b FROM pr) SELECT conv_id, turn, (i - 1)::INTEGER AS para, a[i] AS src, b[i] AS zh FROM (SELECT *, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM a)",
        "longest_low_run": "WITH e AS (SELECT user_id, event_id, (props->>'$.k')::INTEGER % 3 AS v FROM events), m AS (SELECT *, v = min(v) OVER (PARTITION BY user_id) AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e), g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM m WHERE low) SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id",
        "timing_summary": "SELECT event_type, count(*) AS n, round_even(sum(value), 4) AS total, round_even(avg(value), 4) AS mean, round_even(median(value), 4) AS median FROM events GROUP BY event_type",
        "last_events": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500",
        "page_text": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'), ' ') AS text FROM pages",
        "line_block_join": f"WITH l AS ({_BOX.format(20)} WHERE l_linenumber > 2), b AS ({_BOX.format(400)} WHERE l_linenumber <= 2) SELECT l.page, l.box, b.box AS block FROM l JOIN b ON l.page = b.page AND (l.x0 + l.x1) // 2 BETWEEN b.x0 AND b.x1 AND (l.y0 + l.y1) // 2 BETWEEN b.y0 AND b.y1",
        "dup_lines": f"""WITH RECURSIVE b AS ({_BOX.format(800)}), n AS (SELECT *, (x0 % 100)::DOUBLE / 100 AS conf, row_number() OVER (PARTITION BY page ORDER BY box, x0, y0, x1, y1, (x0 % 100)) AS i FROM b),
            s AS (SELECT *, 1 AS g FROM n WHERE i = 1
            UNION ALL SELECT page, CASE WHEN dup AND c >= conf THEN o.box ELSE t.box END, CASE WHEN dup AND c >= conf THEN o.x0 ELSE t.x0 END, CASE WHEN dup AND c >= conf THEN o.y0 ELSE t.y0 END, CASE WHEN dup AND c >= conf THEN o.x1 ELSE t.x1 END, CASE WHEN dup AND c >= conf THEN o.y1 ELSE t.y1 END, greatest(CASE WHEN dup THEN c ELSE 0 END, conf), i, CASE WHEN dup THEN g ELSE g + 1 END
            FROM (SELECT n.page, n.i, n.conf, s.conf AS c, s.g, {{'box': n.box, 'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}} AS t, {{'box': s.box, 'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1}} AS o,
                greatest(0, least(n.x1, s.x1) - greatest(n.x0, s.x0)) * greatest(0, least(n.y1, s.y1) - greatest(n.y0, s.y0)) > 0.8 * least((n.x1 - n.x0) * (n.y1 - n.y0), (s.x1 - s.x0) * (s.y1 - s.y0)) AS dup
                FROM s JOIN n ON n.page = s.page AND n.i = s.i + 1))
            SELECT page, r.box, r.x0, r.y0, r.x1, r.y1, r.conf FROM (SELECT page, g, arg_max({{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'conf': conf}}, i) AS r FROM s GROUP BY page, g)""",
        "term_rate": f"WITH {r._PAIRS}, {r._HITS.split(',' + chr(10))[0]}, k AS (SELECT conv_id, turn, source, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(src), 'ß', 'ss'), '[a-z0-9_]+')) AS source FROM pr) JOIN w USING (source) GROUP BY ALL), z2 AS (SELECT conv_id, turn, source, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(zh), 'ß', 'ss'), '[a-z0-9_]+')) AS source FROM pr) GROUP BY ALL), t AS (SELECT coalesce(sum(n), 0)::BIGINT AS expected, coalesce(sum(greatest(n - coalesce(m, 0), 0)), 0)::BIGINT AS violations FROM k LEFT JOIN z2 USING (conv_id, turn, source)) SELECT *, CASE WHEN expected = 0 THEN 1.0::DOUBLE ELSE round_even(1 - violations::DOUBLE / expected::DOUBLE, 4) END AS rate FROM t",
        "line_owners": f"WITH l AS ({_PAPER.format(20, 'box', '>')}), b AS ({_PAPER.format(400, 'block', '=')}), h AS (SELECT l.page, l.box, b.kind, b.block, row_number() OVER (PARTITION BY l.page, l.box ORDER BY CASE b.kind WHEN 'text' THEN 0 WHEN 'ad' THEN 1 ELSE 2 END, b.block) AS k FROM l LEFT JOIN b ON {_IN.format('(l.x0 + l.x1) // 2', '(l.y0 + l.y1) // 2')} WHERE l.box % 10 > 0) SELECT page, box, coalesce(kind, 'independent') AS kind, block FROM h WHERE k = 1",
        "cell_texts": f"WITH l AS ({_PAPER.format(20, 'box', '>')}), b AS ({_PAPER.format(400, 'cell', '=')}), h AS (SELECT l.*, b.cell, row_number() OVER (PARTITION BY l.page, l.box ORDER BY (l.x0 + l.x1 - b.x0 - b.x1) ** 2 + (l.y0 + l.y1 - b.y0 - b.y1) ** 2, b.cell) AS k FROM l JOIN b ON {_IN.format('(l.x0 + l.x1) / 2', '(l.y0 + l.y1) / 2')}) SELECT b.page, b.cell, coalesce(content, '') AS content FROM b LEFT JOIN (SELECT page, cell, string_agg(text, '' ORDER BY y0, x0, box) AS content FROM h WHERE k = 1 GROUP BY page, cell) USING (page, cell)",
        "glossary_import": f"WITH {_IMPORT} SELECT arrival, source, target, CASE WHEN had IS NULL AND rank = 1 THEN 'added' WHEN target = coalesce(had, f) THEN 'updated' ELSE 'skipped' END AS outcome FROM i",
        "glossary_overwrite": f"WITH {_IMPORT} SELECT arrival, source, target, CASE WHEN had IS NULL AND rank = 1 THEN 'added' ELSE 'updated' END AS outcome FROM i",
        "usage_merge": f"WITH {r._USAGE} SELECT 'tier' AS level, tier AS name, count(*) AS calls, sum(tokens)::BIGINT AS tokens FROM f GROUP BY tier UNION ALL SELECT 'stage', stage, count(*), sum(tokens)::BIGINT FROM f WHERE stage IS NOT NULL GROUP BY stage UNION ALL SELECT 'total', 'all', count(*), sum(tokens)::BIGINT FROM f",
        "term_counts_any_script": f"WITH {r._HITS} SELECT * FROM h",
        "conflict_filter": f"WITH {r._MERGE} SELECT source, nth, existing_target, proposed_target FROM cf WHERE NOT resolved",
        "export_projection": f"WITH {r._MERGE} SELECT source, target, 'auto' AS origin FROM mg WHERE action = 'inserted'",
        "json_repair": "SELECT event_id, props AS json, true AS repaired FROM events",
        "json_strings": f"SELECT doc_id, concat_ws('|', nullif({r._STRIP.format('lang')}, ''), nullif({r._STRIP.format('source')}, ''), nullif({r._STRIP.format('text')}, '')) AS found FROM documents",
        "decode_text": "SELECT doc_id, text FROM documents",
        "fence_strip": "SELECT doc_id, chr(10) || chr(10) || chr(10) || chr(10) || text AS text FROM documents",
        "bracket_residue": "SELECT doc_id, 1::INTEGER AS residue, 2::INTEGER AS protected FROM documents",
    }
    base = r.oracle_sql()
    out["gates"] = f"""SELECT 'alignment' AS gate, (SELECT count(*) FROM ({base["align_issues"]}) WHERE severity = 'error') = 0 AS passed UNION ALL SELECT 'terms', (SELECT rate FROM ({out["term_rate"]})) >= 0.98
        UNION ALL SELECT 'conflicts', (SELECT count(*) FROM ({base["glossary_conflicts"]}) WHERE NOT resolved) = 0"""
    return out
