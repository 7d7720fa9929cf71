"""Queries over staged readers, polygons, grids, table structure, upright runs, canonical JSON and the glossary's state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, json_hash
from ..functions.lineage import scratch_path
from ..functions.text import archive_stamp, time_text
from ..operators import chunking, classes, glossary, grids, lifecycle, matching, metered, polygons, quality, runs, scanner, tables, upright
from ..streaming import terms
from . import registry as r
from .records import _ISSUES, LEFT
from .registry import _PARAS, Query, table
from .runs import _B, _terms, as_candidates

#: What a reader sees of a line, in characters.
SIGHT = {30: 30, 50: 50, 100: 100}


def _paragraph_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("para")
    return chunking.paragraph_explode(table(spark, d, "documents")).select(F.col("doc_id").alias("page"), F.col("para_idx").alias("line"), ((F.col("para_idx") + F.col("doc_id")) % 4).alias("predicted"), n.alias("width"), (F.col("doc_id") % 200).alias("height"), "para")


def _reader(sight: int):
    """A reader that sees so many characters of a line, or of a half of it."""
    half = F.ceil(F.length("para") / 2).cast("int")
    part = F.when(F.col("half") == 0, F.col("para")).when(F.col("half") == 1, F.substring("para", F.lit(1), half)).otherwise(F.substring("para", half + 1, F.length("para")))
    return lambda rows: rows.withColumn("text", F.substring(part, 1, sight))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    return runs.cascade(_paragraph_lines(spark, d), {k: _reader(n) for k, n in SIGHT.items()})


def _bent(x: str, y: str):
    """A polygon like an L: 400 wide and high, its arms 150 thick."""
    return F.array(*(F.struct((F.col(x) + a).cast("double").alias("x"), (F.col(y) + b).cast("double").alias("y")) for a, b in ((0, 0), (400, 0), (400, 150), (150, 150), (150, 400), (0, 400))))


def _polygon_owners(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    papers = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), k.alias("k"), (k * 7 % 1000).alias("x0"), (k * 13 % 1000).alias("y0"), "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "ad").otherwise("table")
    blocks = papers.where("k % 3 = 0").select("page", F.col("k").alias("block"), kind.alias("kind"), _bent("x0", "y0").alias("points"))
    lines = papers.where("k % 3 > 0").select("page", F.col("k").alias("box"), "x0", "y0", (F.col("x0") + 20).alias("x1"), (F.col("y0") + 10).alias("y1"), (F.col("k") % 10 / 10).alias("score"))
    return polygons.owners(lines, blocks, tile=100)


def _distances(spark: SparkSession, d: str) -> DataFrame:
    square = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((20.0, 30.0), (80.0, 30.0), (80.0, 70.0), (20.0, 70.0))))
    x, y = (F.col("l_partkey") * 7 % 100).cast("double"), (F.col("l_suppkey") * 13 % 100).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(polygons.signed_distance(x, y, square), 6).alias("distance"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("page"), F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_orderkey") % 40).alias("x"), (F.col("l_quantity") / 50).cast("double").alias("score"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """An order as a table: odd rows begin with a cell that spans the row below too, then a cell of two columns; even rows have two cells."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("a"), "l_returnflag", "l_linestatus")
    line = line.groupBy("page", "n").agg(F.min("a").alias("a"), F.min("l_returnflag").alias("b"), F.min("l_linestatus").alias("c"))
    line = line.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("n")))
    odd = F.col("n") % 2 == 1
    cell = lambda i, down, wide, text: F.struct((F.col("n") * 10 + i).alias("at"), F.lit("cell").alias("token"), F.lit(down).alias("rowspan"), F.lit(wide).alias("colspan"), text.alias("text"))
    row = F.struct((F.col("n") * 10).alias("at"), F.lit("row").alias("token"), F.lit(None).cast("int").alias("rowspan"), F.lit(None).cast("int").alias("colspan"), F.lit("").alias("text"))
    each = F.when(odd, F.array(row, cell(1, 2, 1, F.col("a")), cell(2, 1, 2, F.col("b")))).otherwise(F.array(row, cell(1, 1, 1, F.col("b")), cell(2, 0, 1, F.col("c"))))
    return line.select("page", F.explode(each).alias("t")).select("page", "t.*")


def _ink(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as vertical lines, their items as strokes one below the other: two beside each other for those that were returned or accepted."""
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 3 * 20 + 25).alias("width"), F.lit(400).alias("height"))
    item = table(spark, d, "lineitem")
    top = F.col("l_linenumber") * 50 + F.col("l_partkey") % 7
    stroke = lambda a, b: F.struct(F.lit(a).alias("x0"), top.alias("y0"), F.lit(b).alias("x1"), (top + 20 + F.col("l_suppkey") % 30).alias("y1"))
    pair = F.col("l_returnflag").isin("A", "R")
    return lines, item.select(F.col("l_orderkey").alias("line"), F.explode(F.when(pair, F.array(stroke(2, 10), stroke(14, 22))).otherwise(F.array(stroke(2, 22)))).alias("s")).select("line", "s.*").distinct()


def _upright(spark: SparkSession, d: str) -> DataFrame:
    lines, ink = _ink(spark, d)
    return upright.upright_runs(lines, ink).withColumnsRenamed({"b0": "top", "b1": "bottom"})


def _props(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    nested = F.concat(F.lit('{ "z" : '), F.col("props"), F.lit(', "a": ['), k, F.lit('.0, '), k, F.lit(', {"é": "'), F.col("event_type"), F.lit('", "b": null}]}'))
    return table(spark, d, "events").select("event_id", canonical_json(nested).alias("form"), json_hash(nested).alias("hash"))


#: What the given turns have instead of runs of katakana.
RUN = "[a-zA-Z]{4,}"


def _kept_terms(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark tokens as terms that stay as they are."""
    return glossary.ascii_terms(table(spark, d, "benchmark")).select("source", F.col("source").alias("target"), F.lit("").alias("type"), F.lit(None).cast("array<string>").alias("aliases"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return matching.term_spans(table(spark, d, "documents"), "doc_id", "text", glossary.ascii_terms(table(spark, d, "benchmark")).withColumn("keys", F.array("source")))


def _metered(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls, written in two runs, one of them twice; their figures as they were kept."""
    v, path = F.floor("value").cast("bigint"), scratch_path(spark, "calls")
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("stage"), F.when(F.col("user_id") % 3 == 0, "fast").otherwise("strong").alias("tier"), v.alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), (v + F.col("event_id") % 50).alias("total_tokens"), F.floor(v / 3).alias("cache_hit_tokens"), (v - F.floor(v / 3)).alias("cache_miss_tokens"))
    for run, part in (("a", calls.where("stage = 'view'")), ("b", calls.where("stage <> 'view' or stage is null")), ("b", calls.where("stage <> 'view' or stage is null"))):
        metered.write_calls(part, path, run, {"tier": ("fast", "strong"), "stage": ("view", "click", "purchase")}, lambda df: df.repartition("stage").sortWithinPartitions("event_id"))
    return metered.usage(spark, path)


def _classes(spark: SparkSession, d: str) -> DataFrame:
    """Items as boxes that name their class by number, name or label, counted by class."""
    k = F.col("l_partkey")
    listed = F.array(*(F.lit(x) for i, names in enumerate(classes.BOXES, 1) for x in (str(i), *names)), F.lit("?"))
    rows = classes.named(table(spark, d, "lineitem").select(F.element_at(listed, (k % F.size(listed) + 1).cast("int")).alias("given")), "given")
    kind = F.when(classes.is_line(F.col("class_name")), "line").when(classes.is_other_block(F.col("class_name")), "block")
    return rows.groupBy("class_id", "class_name", "class_label", kind.alias("kind")).agg(F.count("*").alias("n"))


def _guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    stores = table(spark, d, "orders").select(k, F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit(None), F.lit("x")), (k % 4 + 1).cast("int")).alias("schema_version"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("D"), F.lit("E"), F.lit(None)), (k % 5 + 1).cast("int")).alias("policy"))
    return lifecycle.guarded(stores).select("o_orderkey", "policy", "refused")


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Times of orders, days apart, and the names of folders that they make."""
    epoch = (F.col("o_orderkey") * 86_399).cast("double") + 0.5
    return table(spark, d, "orders").select("o_orderkey", time_text(epoch).alias("time"), archive_stamp(epoch).alias("stamp"))


def _stream_terms(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a stream of candidates, and the glossary that the state store has after them."""
    parts = table(spark, d, "part")
    stream = spark.readStream.schema(parts.schema).parquet(f"{d}/part.parque[t]")  # as a pattern, a file by itself can be a stream too
    out, state = scratch_path(spark, "outcomes"), scratch_path(spark, "glossary")
    query = terms.glossary_stream(as_candidates(stream), _terms(spark, d), out, state)
    query.awaitTermination()
    return terms.current_terms(spark, state)


def queries() -> dict[str, Query]:
    return {
        "recognition_cascade": _cascade,
        "polygon_owners": _polygon_owners,
        "signed_distance": _distances,
        "grid_peaks": lambda s, d: grids.peaks(_scores(s, d)),
        "grid_leading": lambda s, d: grids.leading(grids.peaks(_scores(s, d)), 5, 0.9),
        "table_structure": lambda s, d: tables.decoded(_tokens(s, d)),
        "upright_runs": _upright,
        "upright_parts": lambda s, d: upright.reading_parts(_ink(s, d)[0], upright.upright_runs(*_ink(s, d))).withColumnsRenamed({"from": "top", "to": "bottom"}),
        "canonical_json": _props,
        "term_spans": _spans,
        "error_chunks": lambda s, d: quality.error_chunks(quality.pairs(table(s, d, "conversations"))),
        "digest_pack_texts": lambda s, d: chunking.digest_pack_texts(table(s, d, "documents"), "source", 8),
        "scan_suggestions": lambda s, d: scanner.suggestions(quality.pairs(table(s, d, "conversations")), _kept_terms(s, d), RUN),
        "qa_issues_user_only": lambda s, d: scanner.qa_issues(quality.pairs(table(s, d, "conversations")), ["conv_id", "turn"], _kept_terms(s, d), residue=LEFT, separator=r"\n", policy="A", runs=RUN),
        "usage_of_runs": _metered,
        "class_names": _classes,
        "preset_settings": lambda s, d: runs.with_preset(table(s, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("fast", "standard", "fine", "none"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("preset")), "preset"),
        "store_guards": _guards,
        "time_texts": _times,
        "glossary_stream": _stream_terms,
    }


_SCORED = "SELECT l_suppkey % 20 AS page, l_returnflag AS kind, l_partkey % 40 AS y, l_orderkey % 40 AS x, max((l_quantity / 50)::DOUBLE) AS score FROM lineitem GROUP BY ALL"
_PEAKS = f"s AS ({_SCORED}), p AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s AS o WHERE o.page = s.page AND o.kind = s.kind AND o.y BETWEEN s.y - 1 AND s.y + 1 AND o.x BETWEEN s.x - 1 AND s.x + 1 AND o.score > s.score))"
_BANDS = """
i AS (SELECT DISTINCT l_orderkey AS line, l_linenumber * 50 + l_partkey % 7 AS y0, l_linenumber * 50 + l_partkey % 7 + 20 + l_suppkey % 30 AS y1, l_returnflag IN ('A', 'R') AS pair FROM lineitem),
c AS (SELECT line, o_orderkey % 3 * 20 + 25 AS width, least(y0, 400) AS y0, least(y1, 400) AS y1, pair FROM i JOIN orders ON o_orderkey = line WHERE y0 < 400),
n AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY line ORDER BY y0, y1, pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 5 THEN 0 ELSE 1 END AS new FROM c),
g AS (SELECT *, sum(new) OVER (PARTITION BY line ORDER BY y0, y1, pair ROWS UNBOUNDED PRECEDING) - 1 AS band FROM n),
b AS (SELECT line, width, band, min(y0) AS t, max(y1) AS u, greatest(2, (max(y1) - min(y0)) // 10) AS m, greatest(5, (max(y1) - min(y0)) // 2) AS r FROM g GROUP BY ALL),
w AS (SELECT b.*, sum(greatest(0, least(c.y1, b.u + m, 400) - greatest(c.y0, b.t - m, 0))) AS sides, sum(CASE WHEN c.pair THEN 0 ELSE greatest(0, least(c.y1, b.u + m, 400) - greatest(c.y0, b.t - m, 0)) END) AS gap FROM b JOIN c USING (line) GROUP BY ALL),
f AS (SELECT line, band, t, u, r, CASE WHEN gap * 10 > sides THEN 1 ELSE 2 END AS parts, width >= 30 AND u - t >= 5 AND gap * 10 <= sides AND (u - t) * 4 <= width * 3 AS upright FROM w)"""

_SUGGESTED = f"""su AS (SELECT source, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RUN}')) AS source FROM conversations WHERE role = 'user') GROUP BY source HAVING count(*) >= 3),
st AS (SELECT DISTINCT source FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS source FROM benchmark) WHERE length(source) >= 8),
sg AS (SELECT row_number() OVER (ORDER BY n DESC, source)::INTEGER AS position, source, n FROM su WHERE lower(source) NOT IN (SELECT source FROM st) ORDER BY n DESC, source LIMIT 20)"""


def oracle_sql() -> dict[str, str]:
    return {
        "recognition_cascade": f"WITH {_PARAS}, l AS (SELECT doc_id AS page, para_idx AS line, (para_idx + doc_id) % 4 AS k, para, length(para) AS n, doc_id % 200 AS height FROM p), m AS (SELECT *, CASE WHEN k = 3 AND n < 25 THEN 30 WHEN k IN (2, 3) AND n < 45 THEN 50 WHEN n >= 98 AND height < n THEN 200 ELSE 100 END AS model, (n + 1) // 2 AS h FROM l) SELECT page, line, CASE model WHEN 200 THEN para[1:least(h, 100)] || para[h + 1:h + 100] ELSE para[1:100] END AS text, model FROM m",
        "polygon_owners": """WITH o AS (SELECT o_custkey AS page, o_orderkey AS k, o_orderkey * 7 % 1000 AS x, o_orderkey * 13 % 1000 AS y, o_orderstatus AS s FROM orders),
b AS (SELECT page, k AS block, x, y, CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank FROM o WHERE k % 3 = 0), l AS (SELECT page, k AS box, x + 10 AS x, y + 5 AS y FROM o WHERE k % 3 > 0 AND k % 10 > 0),
h AS (SELECT l.page, l.box, min({'rank': rank, 'block': block}) AS o FROM l LEFT JOIN b ON l.page = b.page AND l.x BETWEEN b.x AND b.x + 400 AND l.y BETWEEN b.y AND b.y + 400 AND (rank > 0 OR l.x <= b.x + 150 OR l.y <= b.y + 150) AND block IS NOT NULL GROUP BY ALL)
SELECT page, box, coalesce(['text', 'ad', 'table'][o.rank + 1], 'independent') AS kind, o.block AS block FROM h""",
        "signed_distance": "WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 100)::DOUBLE AS x, (l_suppkey * 13 % 100)::DOUBLE AS y FROM lineitem), q AS (SELECT *, greatest(20 - x, 0, x - 80) AS dx, greatest(30 - y, 0, y - 70) AS dy FROM p) SELECT l_orderkey, l_linenumber, round(CASE WHEN dx > 0 OR dy > 0 THEN -sqrt(dx * dx + dy * dy) ELSE least(x - 20, 80 - x, y - 30, 70 - y) END, 6) AS distance FROM q",
        "grid_peaks": f"WITH {_PEAKS} SELECT * FROM p",
        "grid_leading": f"WITH {_PEAKS}, r AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY score DESC, kind, y, x)::INTEGER AS rank, kind, y, x, score FROM p WHERE score >= 0.9) SELECT * FROM r WHERE rank <= 5",
        "table_structure": """WITH l AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_partkey::VARCHAR) AS a, min(l_returnflag) AS b, min(l_linestatus) AS c FROM lineitem GROUP BY ALL),
k AS (SELECT page, a, b, c, row_number() OVER (PARTITION BY page ORDER BY n) AS n FROM l), p AS (SELECT *, n - 1 AS r, n % 2 = 0 AS under FROM k),
e AS (SELECT page, n, 1 AS i, r, CASE WHEN n % 2 = 1 THEN r + 1 ELSE r END AS row1, CASE WHEN under THEN 1 ELSE 0 END AS col0, 1 AS wide, CASE WHEN n % 2 = 1 THEN a ELSE b END AS text FROM p UNION ALL SELECT page, n, 2, r, r, CASE WHEN under THEN 2 ELSE 1 END, CASE WHEN n % 2 = 1 THEN 2 ELSE 1 END, CASE WHEN n % 2 = 1 THEN b ELSE c END FROM p)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY n, i) - 1 AS box, r::INTEGER AS row0, row1::INTEGER AS row1, col0::INTEGER AS col0, (col0 + wide - 1)::INTEGER AS col1, text FROM e""",
        "upright_runs": f"WITH {_BANDS} SELECT line, band, t AS top, u AS bottom, parts::BIGINT AS parts, upright FROM f",
        "upright_parts": f"""WITH {_BANDS}, s AS (SELECT *, bool_or(upright) OVER (PARTITION BY line) AS flagged, lag(upright) OVER v AS above, lag(u) OVER v AS above_to, lead(upright) OVER v AS below, lead(t) OVER v AS below_from FROM f WINDOW v AS (PARTITION BY line ORDER BY band)),
k AS (SELECT *, sum(CASE WHEN upright OR above IS NULL OR above THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY band ROWS UNBOUNDED PRECEDING) - 1 AS part FROM s WHERE flagged)
SELECT line, part::BIGINT AS part, min(CASE WHEN upright THEN greatest(0, t - r) WHEN above THEN above_to ELSE t END) AS top, max(CASE WHEN upright THEN least(400, u + r) WHEN below THEN below_from ELSE u END) AS bottom, bool_or(upright) AS upright FROM k GROUP BY line, part""",
        "canonical_json": """WITH f AS (SELECT event_id, concat('{"a":[', event_id, '.0,', event_id, ',{"b":null,"é":"', event_type, '"}],"z":{"k":', props::JSON ->> '$.k', '}}') AS form FROM events) SELECT event_id, form, sha256(form) AS hash FROM f""",
        "term_spans": f"WITH {r._HITS}, p AS (SELECT doc_id, regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '[^a-z0-9_]') AS ps FROM documents), q AS (SELECT doc_id, unnest(ps) AS source, unnest(list_transform(range(1, len(ps) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT)) AS begin FROM p) SELECT doc_id, source, source AS term_key, begin, begin + length(source) AS finish FROM q JOIN w USING (source)",
        "error_chunks": f"{r._ALIGN} SELECT DISTINCT conv_id, turn FROM i WHERE severity = 'error'",
        "digest_pack_texts": f"WITH p AS (SELECT source, doc_id, {r._STRIP.format('text')} AS t, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 + 1 AS pack FROM documents) SELECT source, pack, printf('# 梗概包 %02d（第 %d–%d 块）', pack, min(doc_id), max(doc_id)) || chr(10) || chr(10) || '- 覆盖块数：' || count(*) || chr(10) || chr(10) || '> 说明：以下为逐块中文梗概。请先归纳本包的情节主线、登场人物与' || chr(10) || '> 关键设定，输出一段不超过 400 字的小结，供后续汇总为全书简介。' || chr(10) || chr(10) || string_agg('## 第 ' || doc_id || ' 块' || chr(10) || chr(10) || CASE WHEN t = '' THEN '（本块梗概为空）' ELSE t END || chr(10), chr(10) ORDER BY doc_id) AS text FROM p GROUP BY source, pack",
        "scan_suggestions": f"WITH {_SUGGESTED} SELECT * FROM sg",
        "qa_issues_user_only": f"{_ISSUES}, {_SUGGESTED}, al AS (SELECT conv_id, turn, rank, part, kind, severity, detail, line::BIGINT AS line, n::BIGINT AS n, found, excerpt FROM iss UNION ALL SELECT NULL, NULL, 99, position, 'suggestion', 'info', source, NULL, n, NULL, NULL FROM sg) SELECT row_number() OVER (ORDER BY rank = 99, conv_id, turn, rank, part, detail) AS id, conv_id, turn, kind, severity, detail, line, n, found, excerpt FROM al",
        "class_names": f"WITH c(class_id, class_name, class_label) AS (VALUES {', '.join(str((i, *x)) for i, x in enumerate(classes.BOXES, 1))}), l AS (SELECT l_partkey % {3 * len(classes.BOXES) + 1} // 3 + 1 AS class_id FROM lineitem) SELECT class_id::INTEGER AS class_id, class_name, class_label, CASE WHEN class_name[1:5] = 'line_' THEN 'line' WHEN class_name[1:6] = 'block_' AND class_name <> 'block_table' THEN 'block' END AS kind, count(*) AS n FROM (SELECT c.* FROM l LEFT JOIN c USING (class_id)) GROUP BY ALL",
        "preset_settings": "SELECT c_custkey, p.* EXCLUDE k FROM customer JOIN (VALUES (0, 'fast', false, false, 'off', 10, 6000), (1, 'standard', true, true, 'always', 10, 4000), (2, 'fine', true, true, 'always', 20, 3000), (3, 'none', NULL, NULL, NULL, NULL, NULL)) AS p(k, preset, prescan, style, pre_extract, first_n, max_chars) ON c_custkey % 4 = k",
        "time_texts": "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS time, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y%m%d%H%M%S') AS stamp FROM orders",
        "store_guards": "SELECT o_orderkey, ['A', 'B', 'D', 'C', 'C'][o_orderkey % 5 + 1] AS policy, o_orderkey % 4 = 1 AS refused FROM orders",
        "usage_of_runs": "WITH c AS (SELECT event_type AS stage, CASE WHEN user_id % 3 = 0 THEN 'fast' ELSE 'strong' END AS tier, floor(value)::BIGINT AS v, event_id % 50 AS e FROM events), u AS (SELECT 'tier' AS level, tier AS name, v, e FROM c UNION ALL SELECT 'stage', stage, v, e FROM c), s AS (SELECT level, name, count(*) AS calls, sum(v)::BIGINT AS prompt_tokens, sum(e)::BIGINT AS completion_tokens, sum(v + e)::BIGINT AS total_tokens, sum(floor(v / 3))::BIGINT AS cache_hit_tokens, sum(v - floor(v / 3))::BIGINT AS cache_miss_tokens FROM u WHERE name IN ('fast', 'strong', 'view', 'click', 'purchase') GROUP BY ALL) SELECT *, CASE WHEN prompt_tokens > 0 THEN round_even(cache_hit_tokens::DOUBLE / prompt_tokens, 4) ELSE 0 END AS cache_hit_rate FROM s",
        "glossary_stream": f"WITH {_B} SELECT * FROM u",
    }
