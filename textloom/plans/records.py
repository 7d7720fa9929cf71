"""Queries over boxes within boxes, tables, exports and the records of runs, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import HALF_WIDTH, PLACEHOLDERS, first_line_with
from ..operators import events, glossary, lifecycle, nesting, quality, scanner, tables
from ..sources import exports, readers
from . import registry as r
from .more import _papers
from .registry import Query, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def _sheets(orders: DataFrame) -> DataFrame:
    """Boxes on pages of a customer: 5 to 34 wide, 5 to 44 high, some of them beyond a page of 1,000 by 1,000."""
    k = F.col("o_orderkey")
    x, y = k * 7 % 1000, k * 13 % 1000
    return orders.select(F.col("o_custkey").alias("page"), k.alias("box"), x.alias("x0"), y.alias("y0"), (x + k % 30 + 5).alias("x1"), (y + k % 40 + 5).alias("y1"), (k % 10 / 10).alias("conf"), (k % 5).cast("int").alias("category_id"), F.col("o_orderpriority").alias("text"))


def _images(orders: DataFrame) -> DataFrame:
    name = F.concat(F.lit("p "), F.col("o_custkey").cast("string"), F.lit(".jpg"))
    return orders.select(F.col("o_custkey").alias("page"), name.alias("file_name"), F.lit(1000).alias("width"), F.lit(1000).alias("height")).distinct()


def _annotations(spark: SparkSession, d: str, which: int) -> DataFrame:
    orders = _orders(spark, d)
    return exports.annotation_tables(_images(orders), _sheets(orders), 0.5, 2.0)[which]


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    lines = _sheets(_orders(spark, d)).withColumnRenamed("page", "doc").withColumn("page", F.col("box") % 2)
    name = F.concat(F.lit("p "), F.col("page").cast("string"))
    pages = lines.select("doc", "page", name.alias("name"), F.concat(name, F.lit(".jpg")).alias("path"), F.lit(1000).alias("width"), F.lit(900).alias("height")).distinct()
    return exports.encoded_text(pages, lines)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    lines = _papers(_orders(spark, d), -1, 120).withColumn("rank", F.col("box") % 11)
    return nesting.note_blocks(nesting.notes(lines))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    boxes = _papers(_orders(spark, d), -1, 100).withColumn("n_lines", (F.col("box") % 2).cast("int"))
    wide = F.col("box") % 5 == 0
    return nesting.nested_blocks(boxes.withColumns({"x1": F.when(wide, F.col("x1") + 600).otherwise(F.col("x1")), "y1": F.when(wide, F.col("y1") + 600).otherwise(F.col("y1"))}))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a table of three columns."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = _orders(spark, d).select(F.col("o_custkey").alias("page"), k.alias("box"), F.col("o_orderpriority").alias("text"))
    row, col = F.floor(F.col("box") / 3), F.col("box") % 3
    return tables.rendered(cells.withColumns({"row0": row, "row1": row, "col0": col, "col1": col}))


def _recognized(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of each page as a recognition result, and read again."""
    point = lambda a, b: F.array(F.col(a).cast("double"), F.col(b).cast("double"))
    line = F.struct("box", F.struct(F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")).alias("boundingBox"), "text").alias("l"))
    pages = _sheets(_orders(spark, d)).groupBy("page").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    files = pages.select("page", F.to_json(F.struct(F.array(F.transform("ls", lambda x: x["l"])).alias("contents"))).alias("json"))
    return readers.line_centres(readers.recognized_boxes(files, "page", "json"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose stored and present values differ here and there."""
    k = F.col("o_orderkey")
    runs = _orders(spark, d).select(k, F.when(k % 13 != 0, k % 7 != 0).alias("enable_resume"), F.when(k % 11 == 0, 2).otherwise(1).alias("schema_version"), F.lit("a").alias("input_sha256"), F.when(k % 5 == 0, "b").otherwise("a").alias("now_input"), F.when(k % 17 != 0, "p").alias("params_sha256"), F.lit("p").alias("now_params"), (F.col("o_orderstatus") == "F").alias("finished"))
    return lifecycle.resume_reasons(runs).select("o_orderkey", "reason", "resumable")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    turns, k = table(spark, d, "conversations"), F.col("conv_id")
    runs = turns.select("conv_id").distinct().withColumns({"in_structure": F.when(k % 3 == 0, k % 2), "in_config": F.when(k % 4 == 0, k), "in_status": F.lit(0)})
    return lifecycle.total_chunks(runs, turns.select("conv_id", (F.col("turn") + F.when(F.col("turn") < 4, 1).otherwise(2)).alias("chunk")), "conv_id")


def _policies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return lifecycle.policies(_orders(spark, d).select(k, F.when(k % 5 != 0, k % 2 == 0).alias("has_user"), (k % 3 == 0).alias("auto")))


def _adopted(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    seeds = part.where("p_size >= 25").groupBy(F.col("p_name").alias("source")).agg(F.max_by("p_brand", "p_partkey").alias("target"), F.max("p_partkey").alias("k"))
    terms = seeds.select("source", "target", F.lit("user").alias("origin"), (F.col("k") % 2 == 0).alias("locked"), F.lit("conflict").alias("status"))
    return lifecycle.adopted(terms, part.where("p_size < 25").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("arrival")))


def _folders(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.sha2("p_brand", 256).alias("sha256"), F.sha2("p_type", 256).alias("other"))
    k = F.col("path")
    return lifecycle.folder_differences(files.where((k % 5 != 0) | (k % 7 == 0)), files.where(k % 7 != 0).select(k, F.when(k % 3 == 0, F.col("other")).otherwise(F.col("sha256")).alias("sha256")))


def _compliance(spark: SparkSession, d: str) -> DataFrame:
    e, stages = table(spark, d, "events"), (lambda *s: F.array(*map(F.lit, s)))
    order = events.happens_before(e, "view", "purchase", "user_id", "event_id")
    owed = lifecycle.owed_artifacts(e.select(stages("S1", "S4").alias("planned"), stages("S1").alias("finished"), F.array().cast("array<string>").alias("skipped"), stages("S1").alias("files")))
    return lifecycle.compliance(order, owed, e.select("user_id").distinct(), events.pending(e, e.where("event_type = 'purchase'"), "user_id"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.floor("value").cast("bigint"), F.col("event_id")
    details = F.when(k % 3 == 0, F.struct(F.floor(v / 2).alias("cached_tokens")))
    usage = F.struct(v.alias("prompt_tokens"), (k % 50).alias("completion_tokens"), F.when(k % 4 == 0, v).alias("total_tokens"), F.floor(v / 3).alias("prompt_cache_hit_tokens"), (v - F.floor(v / 3)).alias("prompt_cache_miss_tokens"), details.alias("prompt_tokens_details"))
    calls = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "deepseek").otherwise("openai").alias("provider"), F.to_json(usage).alias("usage"))
    return events.usage_samples(calls).drop("usage")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(F.concat(F.lit("n="), F.col("event_id").cast("string")), F.lit("x=1.5"), F.lit("b=True"), F.concat(F.lit("t=a="), "event_type"), F.lit("none"))
    return table(spark, d, "events").select("event_id", F.explode(readers.typed_pairs(items)).alias("p")).select("event_id", "p.*")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pairs, letters beyond ASCII as what should not be left, benchmark tokens as terms that stay as they are."""
    terms = glossary.ascii_terms(table(spark, d, "benchmark")).select("source", F.col("source").alias("target"), F.lit("").alias("type"), F.lit(None).cast("array<string>").alias("aliases"))
    return scanner.qa_issues(quality.pairs(table(spark, d, "conversations")), ["conv_id", "turn"], terms, residue=LEFT, separator=r"\n")


def _search(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.when(F.col("p_size") > 9, F.col("p_type")).alias("note"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("type"), F.when(F.col("p_size") % 3 == 0, "conflict").otherwise("ok").alias("status"))
    return glossary.search(part, "BRAND#1", "a", only_conflicts=True).select("p_partkey", "source", "target")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    chunks = e.select("user_id").distinct().withColumn("status", F.lit("new"))
    return lifecycle.marked(chunks, e.select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("seq")), "user_id")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Users as runs: purchases are done, views failed, and the last event is the sign of life."""
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), is_("purchase").alias("done"), is_("view").alias("failed"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    return runs.select("user_id", lifecycle.progress_line(F.col("n"), F.col("done"), F.col("failed")).alias("line"), lifecycle.stale(F.col("first"), F.col("last"), 86_400).alias("stale"))


#: Letters that stand for those of the source's script.
LEFT = "[äöüßéèêçñwq]"


def queries() -> dict[str, Query]:
    return {
        "qa_issues": _issues,
        "qa_counts": lambda s, d: scanner.qa_counts(_issues(s, d)),
        "term_search": _search,
        "chunk_marks": _marks,
        "run_progress": _progress,
        "chunk_estimates": lambda s, d: table(s, d, "documents").select("doc_id", lifecycle.estimated_chunks(F.length("text"), 4000).alias("n")),
        "note_blocks": _notes,
        "nested_blocks": _nested,
        "detections": lambda s, d: nesting.detections(_sheets(_orders(s, d)).withColumns({"w": F.lit(1000), "h": F.lit(1000)}), "w", "h", side=10).select("page", "box", "x0", "y0", "x1", "y1"),
        "page_stats": lambda s, d: nesting.page_stats(_sheets(_orders(s, d))),
        "dataset_summary": lambda s, d: nesting.dataset_summary(_sheets(_orders(s, d))),
        "overlapping_texts": lambda s, d: tables.overlapping_texts(_papers(_orders(s, d), 1, 20).withColumnRenamed("o_orderpriority", "text"), _papers(_orders(s, d), 0, 400, "cell")),
        "table_render": _tables,
        "annotation_images": lambda s, d: _annotations(s, d, 0),
        "annotations": lambda s, d: _annotations(s, d, 1),
        "encoded_text": _encoded,
        "wrapped_pages": lambda s, d: exports.wrapped(table(s, d, "conversations"), "conv_id", "text", "turn"),
        "recognized_boxes": _recognized,
        "typed_pairs": _pairs,
        "resume_reasons": _runs,
        "total_chunks": _totals,
        "policies": _policies,
        "adopted_terms": _adopted,
        "folder_differences": _folders,
        "compliance": _compliance,
        "usage_samples": _usage,
        "first_line_with": lambda s, d: table(s, d, "documents").select("doc_id", first_line_with(F.col("text"), F.lit("er ")).alias("f")).where("f is not null").select("doc_id", "f.*"),
        "residue_lines": lambda s, d: quality.residue_scan(table(s, d, "documents"), "[éèêçñ]"),
    }


_SHEET = "s AS (SELECT *, x0 + box % 30 + 5 AS x1, y0 + box % 40 + 5 AS y1 FROM (SELECT o_custkey AS page, o_orderkey AS box, o_orderkey * 7 % 1000 AS x0, o_orderkey * 13 % 1000 AS y0, (o_orderkey % 5)::INTEGER AS category_id, o_orderpriority AS text FROM orders))"
_TEXTS = "SELECT o_custkey AS page, o_orderkey AS k, o_orderkey * 7 % 1000 AS x0, o_orderkey * 13 % 1000 AS y0, o_orderpriority AS text FROM orders"
_ZONE = "'L' || lpad(page::VARCHAR, 4, '0') || '_' || lpad(box::VARCHAR, greatest(3, length(box::VARCHAR))::INTEGER, '0')"
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


_LIST = "array_to_string(list_sort(list_distinct({}))[1:{}], '{}')"
_EXCERPT = "CASE WHEN length({0}) <= 60 THEN {0} ELSE left({0}, 57) || '…' END"
_PLACE = " UNION ALL ".join(
    f"SELECT conv_id, turn, 4, {i}, 'placeholder', 'error', '{k}', NULL, len(regexp_extract_all(zh, '{p}')) - len(regexp_extract_all(src, '{p}')), {_LIST.format(f"regexp_extract_all(src, '{p}')", 5, ', ')}, NULL FROM fl WHERE len(regexp_extract_all(src, '{p}')) <> len(regexp_extract_all(zh, '{p}'))"
    for i, (k, p) in enumerate(PLACEHOLDERS.items())
)
_MARKS = " UNION ALL ".join(
    f"SELECT conv_id, turn, 6, {i}, 'punctuation', '{v}', NULL, NULL, len(regexp_extract_all(zh, '{p}')), {_LIST.format(f"regexp_extract_all(zh, '{p}')", 20, '')}, NULL FROM fl WHERE len(regexp_extract_all(zh, '{p}')) > 0"
    for i, (p, v) in enumerate(((scanner.BRACKETS, "warn"), (HALF_WIDTH, "info")))
)
_ISSUES = f"""WITH {r._PAIRS}, fl AS (SELECT * FROM pr WHERE zh IS NOT NULL AND {r._STRIP.format("zh")} <> ''),
ln AS (SELECT conv_id, turn, unnest(range(len(ls))) AS i, unnest(ls) AS t FROM (SELECT conv_id, turn, string_split(zh, chr(10)) AS ls FROM fl)),
re AS (SELECT *, regexp_extract_all(t, '{LEFT}') AS c, {r._STRIP.format("t")} AS s FROM ln),
sn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, number ORDER BY pos) AS nth FROM (SELECT conv_id, turn, unnest(range(len(ns))) AS pos, unnest(ns) AS number FROM (SELECT conv_id, turn, regexp_extract_all(src, '[0-9]+') AS ns FROM fl))),
zn AS (SELECT conv_id, turn, number, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(zh, '[0-9]+')) AS number FROM fl) GROUP BY ALL),
mn AS (SELECT conv_id, turn, list(number ORDER BY pos) AS ns FROM sn LEFT JOIN zn USING (conv_id, turn, number) WHERE nth > coalesce(m, 0) GROUP BY conv_id, turn),
{r._HITS.split("," + chr(10))[0]},
ts AS (SELECT conv_id, turn, source, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(src), 'ß', 'ss'), '[a-z0-9_]+')) AS source FROM fl) JOIN w USING (source) GROUP BY ALL),
tz AS (SELECT conv_id, turn, source, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(replace(lower(zh), 'ß', 'ss'), '[a-z0-9_]+')) AS source FROM fl) GROUP BY ALL),
tm AS (SELECT conv_id, turn, source, n - coalesce(m, 0) AS n, zh FROM ts LEFT JOIN tz USING (conv_id, turn, source) JOIN fl USING (conv_id, turn) WHERE n > coalesce(m, 0)),
tl AS (SELECT conv_id, turn, source, min(i) AS i, arg_min(s, i) AS s FROM tm JOIN re USING (conv_id, turn) WHERE contains(t, source) GROUP BY ALL),
iss(conv_id, turn, rank, part, kind, severity, detail, line, n, found, excerpt) AS (
    SELECT conv_id, turn, 1, 0, 'empty', 'error', CASE WHEN zh IS NULL THEN 'missing' ELSE 'blank' END, NULL, NULL, NULL, NULL FROM pr WHERE zh IS NULL OR {r._STRIP.format("zh")} = ''
    UNION ALL SELECT conv_id, turn, 2, i, 'residue', 'error', NULL, i + 1, len(c), {_LIST.format("c", 20, "")}, {_EXCERPT.format("s")} FROM re WHERE len(c) > 0
    UNION ALL SELECT conv_id, turn, 3, 0, 'terminology', 'error', source, i + 1, n, CASE WHEN contains(zh, source) THEN source ELSE '' END, {_EXCERPT.format("s")} FROM tm LEFT JOIN tl USING (conv_id, turn, source)
    UNION ALL {_PLACE}
    UNION ALL SELECT conv_id, turn, 5, 0, 'number', 'warn', NULL, NULL, len(ns), array_to_string(ns[1:8], ', '), NULL FROM mn
    UNION ALL {_MARKS}
    UNION ALL SELECT conv_id, turn, 7, 0, 'paragraph', 'warn', NULL, NULL, {r._N_PARAS.format("zh")} - {r._N_PARAS.format("src")}, NULL, NULL FROM fl WHERE {r._N_PARAS.format("zh")} <> {r._N_PARAS.format("src")})"""


def oracle_sql() -> dict[str, str]:
    return {
        "qa_issues": f"{_ISSUES} SELECT row_number() OVER (ORDER BY conv_id, turn, rank, part, detail) AS id, conv_id, turn, kind, severity, detail, line::BIGINT AS line, n::BIGINT AS n, found, excerpt FROM iss",
        "qa_counts": f"{_ISSUES}, k(level, name) AS (VALUES {', '.join(f"('kind', '{k}')" for k in scanner.KINDS)}, {', '.join(f"('severity', '{v}')" for v in scanner.SEVERITIES)}), f AS (SELECT 'kind' AS level, kind AS name, count(*) AS n FROM iss GROUP BY kind UNION ALL SELECT 'severity', severity, count(*) FROM iss GROUP BY severity) SELECT level, name, coalesce(n, 0) AS n FROM k LEFT JOIN f USING (level, name)",
        "term_search": "SELECT p_partkey, p_name AS source, p_brand AS target FROM part WHERE (contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR coalesce(contains(lower(CASE WHEN p_size > 9 THEN p_type END), 'brand#1'), false)) AND p_size % 2 = 0 AND p_size % 3 = 0",
        "chunk_marks": "WITH c AS (SELECT DISTINCT user_id FROM events), m AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events GROUP BY user_id) SELECT user_id, coalesce(s, 'new') AS status FROM c FULL JOIN m USING (user_id)",
        "run_progress": "WITH r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS d, count(*) FILTER (event_type = 'view') AS f, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS age FROM events GROUP BY user_id) SELECT user_id, '- ' || d || '/' || n || ' (' || (d * 100 // n) || '%)' || CASE WHEN f > 0 THEN ', ' || f || ' failed' ELSE '' END AS line, age > 86400 AS stale FROM r",
        "chunk_estimates": "SELECT doc_id, greatest(1, ceil(length(text) / 4000.0::DOUBLE))::BIGINT AS n FROM documents",
        "detections": f"WITH {_SHEET}, c AS (SELECT page, box, least(x0, 1000) AS x0, least(y0, 1000) AS y0, least(x1, 1000) AS x1, least(y1, 1000) AS y1 FROM s WHERE box % 10 / 10.0::DOUBLE > 0.25) SELECT * FROM c WHERE x1 - x0 >= 10 OR y1 - y0 >= 10",
        "page_stats": f"WITH {_SHEET} SELECT page, count(*) AS n_lines, count(*) FILTER (x1 - x0 < y1 - y0) AS n_vertical, median(x1 - x0)::DOUBLE AS median_width, median(y1 - y0)::DOUBLE AS median_height, count(*) < 2 * count(*) FILTER (x1 - x0 < y1 - y0) AS vertical FROM s GROUP BY page",
        "dataset_summary": f"""WITH {_SHEET}, v AS (SELECT 'width' AS measure, (x1 - x0)::DOUBLE AS v FROM s UNION ALL SELECT 'height', (y1 - y0)::DOUBLE FROM s UNION ALL SELECT 'aspect', (y1 - y0)::DOUBLE / (x1 - x0)::DOUBLE FROM s UNION ALL SELECT 'per_page', count(*)::DOUBLE FROM s GROUP BY page),
            m AS (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high FROM v WINDOW w AS (PARTITION BY measure))
            SELECT measure, (CASE WHEN high > low THEN least(9, floor((v - low) * 10 / (high - low))) ELSE 0 END)::INTEGER AS bin, count(*) AS n FROM m GROUP BY ALL""",
        "overlapping_texts": f"""WITH p AS ({_TEXTS}), h AS (SELECT c.page, c.k AS cell, string_agg(t.text, '' ORDER BY t.y0, t.x0, t.k) AS content FROM p t JOIN p c ON t.page = c.page AND t.k % 3 > 0 AND c.k % 3 = 0
            AND greatest(0, least(t.x0 + 20, c.x0 + 400) - greatest(t.x0, c.x0)) * greatest(0, least(t.y0 + 20, c.y0 + 400) - greatest(t.y0, c.y0)) > 400 * 0.2::DOUBLE GROUP BY ALL)
            SELECT p.page, p.k AS cell, coalesce(content, '') AS content FROM p LEFT JOIN h ON h.page = p.page AND h.cell = p.k WHERE p.k % 3 = 0""",
        "table_render": """WITH t AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_orderpriority AS t FROM orders), n AS (SELECT page, count(*) AS n, least(count(*), 3) AS c FROM t GROUP BY page),
            g AS (SELECT page, c, unnest(range(0, ((n + 2) // 3) * c)) AS i FROM n), f AS (SELECT page, c, i, i // c AS r, coalesce(t, '') AS t FROM g LEFT JOIN t USING (page, i)),
            l AS (SELECT page, c, r, '<tr>' || string_agg('<td>' || t || '</td>', '' ORDER BY i) || '</tr>' AS h, '| ' || string_agg(t, ' | ' ORDER BY i) || ' |' AS m FROM f GROUP BY ALL)
            SELECT page, '<table border="1">' || string_agg(h, '' ORDER BY r) || '</table>' AS html, '| ' || array_to_string(range(0, c), ' | ') || ' |' || chr(10) || '|' || repeat('---|', c) || chr(10) || string_agg(m, chr(10) ORDER BY r) AS markdown FROM l GROUP BY page, c""",
        "annotation_images": "SELECT row_number() OVER (ORDER BY page) - 1 AS id, 'p ' || page || '.jpg' AS file_name, 500::INTEGER AS width, 2000::INTEGER AS height FROM (SELECT DISTINCT o_custkey AS page FROM orders)",
        "annotations": f"""WITH {_SHEET}, i AS (SELECT page, row_number() OVER (ORDER BY page) - 1 AS image_id FROM (SELECT DISTINCT page FROM s)), a AS (SELECT s.*, image_id, x0 * 0.5::DOUBLE AS x, y0 * 2.0::DOUBLE AS y, (x1 - x0) * 0.5::DOUBLE AS w, (y1 - y0) * 2.0::DOUBLE AS h FROM s JOIN i USING (page))
            SELECT row_number() OVER (ORDER BY image_id, box) - 1 AS id, image_id, category_id, [x, y, w, h] AS bbox, w * h AS area, 0::INTEGER AS iscrowd, [[x, y, x + w, y, x + w, y + h, x, y + h]] AS segmentation FROM a""",
        "encoded_text": f"""WITH {_SHEET}, l AS (SELECT page AS doc, box % 2 AS page, box, x0, y0, x1, y1, text FROM s), z AS (SELECT *, {_ZONE} AS z FROM l),
            p AS (SELECT doc, page, '<surface><graphic url="p%20' || page || '.jpg" width="1000px" height="900px"/>' || string_agg('<zone xml:id="' || z || '" ulx="' || x0 || '" uly="' || y0 || '" lrx="' || x1 || '" lry="' || y1 || '"/>', '' ORDER BY box) || '</surface>' AS a,
                '<pb n="p ' || page || '" facs="#p ' || page || '"/>' || string_agg('<lb n="' || box || '" facs="#' || z || '"/>' || {_ESC.format("text")}, '' ORDER BY box) AS b FROM z GROUP BY doc, page)
            SELECT doc, '{exports.HEAD}' || string_agg(a, '' ORDER BY page) || '</facsimile><text><body><p>' || string_agg(b, '' ORDER BY page) || '</p></body></text></TEI>' AS xml FROM p GROUP BY doc""",
        "wrapped_pages": "SELECT conv_id, '<OCRDATASET>' || chr(10) || string_agg(text, chr(10) ORDER BY turn) || chr(10) || '</OCRDATASET>' AS xml FROM conversations GROUP BY conv_id",
        "recognized_boxes": f"WITH {_SHEET} SELECT page, (row_number() OVER (PARTITION BY page ORDER BY y0, x0, box) - 1)::INTEGER AS box, x0, y0, x1, y1, text, (x0 + x1) // 2 AS x, (y0 + y1) // 2 AS y FROM s",
        "typed_pairs": "SELECT event_id, p.key, p.kind, p.value FROM (SELECT event_id, unnest([{'key': 'n', 'kind': 'int', 'value': event_id::VARCHAR}, {'key': 'x', 'kind': 'float', 'value': '1.5'}, {'key': 'b', 'kind': 'bool', 'value': 'True'}, {'key': 't', 'kind': 'string', 'value': 'a=' || event_type}]) AS p FROM events)",
        "resume_reasons": "SELECT o_orderkey, reason, reason = '' AS resumable FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 7 = 0 THEN 'resume_disabled' WHEN o_orderkey % 11 = 0 THEN 'schema_mismatch' WHEN o_orderkey % 5 = 0 THEN 'input_changed' WHEN o_orderkey % 17 = 0 THEN 'params_changed' WHEN o_orderstatus = 'F' THEN 'finished' ELSE '' END AS reason FROM orders)",
        "total_chunks": """WITH c AS (SELECT DISTINCT conv_id, turn + CASE WHEN turn < 4 THEN 1 ELSE 2 END AS chunk FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY chunk) AS i FROM c), g AS (SELECT conv_id, count(*) AS n FROM n WHERE chunk = i GROUP BY conv_id), k AS (SELECT DISTINCT conv_id FROM conversations)
            SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 > 0 THEN conv_id % 2 WHEN conv_id % 4 = 0 AND conv_id > 0 THEN conv_id ELSE coalesce(n, 0) END::BIGINT AS total FROM k LEFT JOIN g USING (conv_id)""",
        "policies": "SELECT o_orderkey, has_user, auto, CASE WHEN u AND NOT auto THEN 'A' WHEN u THEN 'B' WHEN auto THEN 'C' ELSE 'D' END AS policy, auto AS inserts, u AS seeds, u OR auto AS maintains, u AND NOT auto AS suggests FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS has_user, o_orderkey % 3 = 0 AS auto, o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS u FROM orders)",
        "adopted_terms": """WITH t AS (SELECT p_name AS source, arg_max(p_brand, p_partkey) AS had, max(p_partkey) % 2 = 0 AS held FROM part WHERE p_size >= 25 GROUP BY p_name), f AS (SELECT p_name AS source, arg_min(p_brand, p_partkey) AS new FROM part WHERE p_size < 25 GROUP BY p_name),
            b AS (SELECT *, new IS NOT NULL AND (had IS NULL OR had = new OR NOT held) AS takes FROM t FULL JOIN f USING (source)) SELECT source, CASE WHEN takes THEN new ELSE had END AS target, 'user' AS origin, CASE WHEN takes THEN true ELSE held END AS locked, CASE WHEN takes THEN 'ok' ELSE 'conflict' END AS status FROM b""",
        "folder_differences": "SELECT * FROM (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 AND p_partkey % 7 <> 0 THEN 'orphan' WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0 AND p_brand <> p_type THEN 'changed' END AS problem FROM part) WHERE problem IS NOT NULL",
        "compliance": """WITH u AS (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS f, min(event_id) FILTER (event_type = 'purchase') AS t FROM events GROUP BY user_id), c AS (SELECT 'pre_extract_order' AS "check", count(*) FILTER (t IS NOT NULL AND (f IS NULL OR f >= t)) = 0 AS passed FROM u UNION ALL SELECT 'stage_artifacts', true UNION ALL SELECT 'chunk_complete', count(*) > 0 AND count(*) FILTER (t IS NULL) = 0 FROM u)
            SELECT * FROM c UNION ALL SELECT 'all', bool_and(passed) FROM c""",
        "usage_samples": """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'deepseek' ELSE 'openai' END AS provider, floor(value)::BIGINT AS v, event_id % 50 AS c FROM events)
            SELECT event_id, provider, v AS prompt_tokens, c AS completion_tokens, CASE WHEN event_id % 4 = 0 AND v <> 0 THEN v ELSE v + c END AS total_tokens, greatest(0, CASE WHEN provider = 'deepseek' THEN floor(v / 3)::BIGINT WHEN event_id % 3 = 0 THEN floor(v / 2)::BIGINT ELSE 0 END) AS hit_tokens,
            greatest(0, CASE WHEN provider = 'deepseek' THEN v - floor(v / 3)::BIGINT WHEN event_id % 3 = 0 THEN v - floor(v / 2)::BIGINT ELSE 0 END) AS miss_tokens FROM e""",
        "first_line_with": f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), i AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line, unnest(ls) AS t FROM l), f AS (SELECT doc_id, min(line) AS line, arg_min({r._STRIP.format('t')}, line) AS t FROM i WHERE contains(t, 'er ') GROUP BY doc_id) SELECT doc_id, line, CASE WHEN length(t) <= 60 THEN t ELSE left(t, 57) || '…' END AS excerpt FROM f",
        "residue_lines": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, line, regexp_extract_all(t, '[éèêçñ]') AS cs FROM (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line, unnest(ls) AS t FROM l)) SELECT doc_id, line, len(cs)::INTEGER AS n_chars, array_to_string(list_sort(list_distinct(cs))[1:20], '') AS found FROM c WHERE len(cs) > 0",
    }
