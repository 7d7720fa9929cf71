"""Queries over the glossary's write path, the state of runs, polygons and readings, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, is_heading
from ..operators import chunking, quality, runs, store
from . import registry as r
from .registry import Query, table

#: Every part is either a term (its size is 40 or more; the last of a source counts) or a candidate.
_KEY = "p_name || '-' || (p_size % 3)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").where("p_size >= 40").withColumn("source", F.expr(_KEY)).groupBy("source").agg(F.max_by("p_brand", "p_partkey").alias("target"), F.max("p_partkey").alias("k"))
    user = F.col("k") % 3 == 0
    return own.select("source", "target", F.lit("").alias("reading"), F.when(F.col("k") % 2 == 0, store.DEFAULT_TYPE).otherwise("人物").alias("type"), F.lit("").alias("gender"), F.array(F.lit(" z "), F.col("target")).alias("aliases"), F.when(F.col("k") % 5 == 0, "n").otherwise("").alias("note"), F.when(user, "user").otherwise("auto").alias("origin"), user.alias("locked"), F.lit("ok").alias("status"), F.col("k").alias("first_chunk"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return as_candidates(table(spark, d, "part"))


def as_candidates(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return parts.where("p_size < 40").select(
        k.alias("arrival"), F.expr(f"CASE WHEN p_partkey % 17 = 0 THEN '　' ELSE '　' || {_KEY} || ' ' END").alias("source"), F.concat(F.lit(" "), F.col("p_brand")).alias("target"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("reading"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "?").otherwise(" 地名 ").alias("type"), F.when(k % 3 == 0, "f").alias("gender"), F.array(F.col("p_type"), F.lit(" "), F.expr(_KEY)).alias("aliases"), F.when(k % 5 == 0, F.col("p_type")).otherwise("").alias("note"),
        F.when(k % 7 == 0, "user").otherwise("x").alias("origin"), F.lit(False).alias("locked"), F.floor(k / 10).alias("chunk"), F.when(k % 2 == 0, "pre").otherwise("post").alias("phase"),
    )


def _upserted(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted(_terms(spark, d), _candidates(spark, d))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert_log(_terms(spark, d), _candidates(spark, d))


def _choices(spark: SparkSession, d: str) -> DataFrame:
    terms, n = _upserted(spark, d), F.length("source")
    picks = terms.select("source", F.when(n % 5 == 0, "named").otherwise("").alias("target"), F.when(n % 2 == 0, "existing").otherwise("proposed").alias("take"), F.when(n % 3 == 0, F.lit(1)).cast("bigint").alias("conflict_id"))
    return store.choices(picks, terms, _log(spark, d))


def _prompt(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("source")
    hits = r._hits(spark, d).select("doc_id", "source", F.col("source").alias("target"), F.when(n % 2 == 0, "a").otherwise("b").alias("type"), (n % 5 == 0).alias("locked"), F.array("source").alias("aliases"), F.lit("").alias("note"), F.lit("ok").alias("status"), F.col("n").alias("hits"), F.when(n % 3 > 0, n).alias("first_chunk"))
    return store.prompt_rows(hits, 3)


def _chunk_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "glossary_pre_extract").when(F.col("event_type") == "purchase", "chunk_translated").otherwise(F.col("event_type"))
    chunk = F.when(F.col("event_id") % 50 == 0, "x").otherwise((F.col("event_id") % 20 + 1).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), kind.alias("event_type"), chunk.alias("chunk"), F.col("event_id").cast("string").alias("seq"))


def _extract_order(spark: SparkSession, d: str) -> DataFrame:
    events = runs.valid_events(_chunk_events(spark, d), ("glossary_pre_extract", "chunk_translated"))
    status = F.when(F.bool_or(F.col("event_type") == "chunk_translated"), "done").otherwise("pending").alias("status")
    mode = F.when(F.col("run") % 3 == 0, "off").when(F.col("run") % 3 == 1, "firstNChunks").otherwise("always")
    settings = events.select("run").distinct().select("run", mode.alias("mode"), F.lit(5).alias("first_n"), F.lit(15).alias("total"))
    return runs.extract_order(runs.required_chunks(events.groupBy("run", "chunk").agg(status), settings), events)


def _stage_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    data = F.when(k % 2 == 0, F.concat(F.lit('{"stage":"S'), (k % 9).cast("string"), F.lit('"}'))).otherwise("{}")
    kind = F.when(F.col("event_type") == "view", "stage_finished").when(F.col("event_type") == "click", "stage_skipped").otherwise("note")
    return runs.stage_events(table(spark, d, "events").select(F.col("user_id").alias("run"), kind.alias("event_type"), F.when(k % 3 > 0, F.concat(F.lit("S"), (k % 5).cast("string"))).alias("stage"), data.alias("data")))


def _without_skipped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    marks = table(spark, d, "events").select(F.col("user_id").alias("run"), F.when(k % 7 == 0, "x").otherwise(F.concat(F.lit(" "), (k % 50).cast("string"))).alias("key"), F.when(F.col("event_type") == "error", "skipped").otherwise("done").alias("status"))
    return runs.without_skipped(table(spark, d, "events").select(F.col("user_id").alias("run"), (k % 50).alias("chunk")).distinct(), marks)


def _chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    told = e.select(F.col("user_id").alias("run"), F.when(F.col("user_id") % 2 == 0, k % 9).alias("chunk"))
    return runs.chunk_ids(told, e.select(F.col("user_id").alias("run"), F.concat(F.lit("chunk_00"), (k % 12).cast("string"), F.when(k % 12 == 5, ".md").otherwise(".txt")).alias("name")).distinct())


def _char_totals(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("run"), "text", "turn")
    return runs.char_totals(turns.where("turn = 0").where("run % 2 = 0"), turns)


def _sample_pack(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    picked = chunking.sample_positions(sizes, "conv_id", "n", 3).join(sizes, "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("position").alias("chunk"), F.col("n").alias("n_chunks"), F.lit(1).alias("first"), F.col("n").alias("last"))
    return runs.sample_pack(picked.join(turns.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("chunk"), "text"), ["doc_id", "chunk"]), 40)


def _recognised(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("l_partkey").cast("string"), F.lit('<"&'), F.col("l_returnflag"))
    line = F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return runs.recognised_texts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), line.alias("line"), text.alias("text")))


_TRIANGLE = ((10.0, 10.0), (90.0, 10.0), (50.0, 90.0))


def _polygon(spark: SparkSession, d: str) -> DataFrame:
    points = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in _TRIANGLE))
    x, y = (F.col("o_orderkey") * 7 % 100).cast("double"), (F.col("o_custkey") * 13 % 100).cast("double")
    return table(spark, d, "orders").select("o_orderkey", runs.in_polygon(x, y, points).alias("place"))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    tiers = F.map_concat(F.create_map(F.lit("strong"), F.lit("S")), *(F.when(k % n == 0, F.create_map(F.lit(t), F.lit(t[0]))).otherwise(F.create_map().cast("map<string,string>")) for t, n in (("cheap", 2), ("fast", 3))))
    stage = F.concat(F.lit("S"), (k % 12).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", *(runs.tier_of(tiers, t).alias(t) for t in ("fast", "cheap", "strong", "other")), runs.stage_index(stage).alias("stage"))


def _marked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """An order's key, price and placeholders as a source, and what a target made of them."""
    k, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("bigint").cast("string")
    src = F.concat(k, F.lit(" {name} %d ５ "), price, F.lit(" <b> "), F.col("o_custkey").cast("string"))
    zh = F.concat(k, F.when(F.col("o_orderkey") % 2 == 0, " {name} 5 ").otherwise(" %s "), F.when(F.col("o_orderkey") % 3 == 0, price).otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, " <b>").otherwise(""))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), src.alias("src"), zh.alias("zh"))


def _wide(c: str):
    return F.translate(F.col(c), "öüäß", "カナ゛Ａ")


def queries() -> dict[str, Query]:
    return {
        "glossary_upsert": _upserted,
        "glossary_upsert_outcomes": lambda s, d: store.upsert_outcomes(_terms(s, d), _candidates(s, d)),
        "glossary_upsert_user_only": lambda s, d: store.upserted(_terms(s, d), _candidates(s, d), "A"),
        "glossary_upsert_log": _log,
        "glossary_choices": _choices,
        "glossary_store_stats": lambda s, d: store.store_stats(_upserted(s, d), _log(s, d)),
        "prompt_rows": _prompt,
        "extract_order": _extract_order,
        "stage_events": _stage_events,
        "without_skipped": _without_skipped,
        "chunk_ids": _chunk_ids,
        "char_totals": _char_totals,
        "sample_pack": _sample_pack,
        "recognised_texts": _recognised,
        "in_polygon": _polygon,
        "tier_settings": _settings,
        "number_missing": lambda s, d: quality.number_missing(_marked_pairs(s, d)),
        "placeholder_diff": lambda s, d: quality.placeholder_diff(_marked_pairs(s, d)),
        "residue_kana": lambda s, d: quality.residue_scan(table(s, d, "documents").select("doc_id", _wide("text").alias("text")), "[぀-ヿ]"),
        "katakana_runs": lambda s, d: quality.katakana_runs(table(s, d, "documents").select("doc_id", F.regexp_replace("text", "[öüä][a-z]", "カナー").alias("text"))),
        "headings": lambda s, d: table(s, d, "orders").select("o_orderkey", is_heading(F.concat(F.lit("　第"), F.translate((F.col("o_orderkey") % 40).cast("string"), "0123456789", "０１２３4567八九"), F.when(F.col("o_custkey") % 2 == 0, "章").otherwise("版"))).alias("head")),
    }


_STRIPPED = "regexp_replace({}, '^[\\s　]+|[\\s　]+$', '', 'g')"
_TYPE = "CASE WHEN coalesce(trim({0}), '') = '' THEN '术语' WHEN trim({0}) IN (" + ", ".join(f"'{t}'" for t in store.TYPES) + ") THEN trim({0}) ELSE '其他' END"
_ALIASES = "list_sort(list_distinct(list_filter(list_transform({0}, lambda x: trim(x)), lambda x: x <> '' AND x <> {1})))"
_STORE = f"""tk AS (SELECT {_KEY} AS source, arg_max(p_brand, p_partkey) AS target, max(p_partkey) AS k FROM part WHERE p_size >= 40 GROUP BY 1),
t AS (SELECT source, target, '' AS reading, CASE WHEN k % 2 = 0 THEN '术语' ELSE '人物' END AS type, '' AS gender, [' z ', target] AS aliases, CASE WHEN k % 5 = 0 THEN 'n' ELSE '' END AS note, CASE WHEN k % 3 = 0 THEN 'user' ELSE 'auto' END AS origin, k % 3 = 0 AS locked, 'ok' AS status, k AS first_chunk FROM tk),
c AS (SELECT p_partkey AS arrival, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE {_KEY} END AS source, p_brand AS target, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS reading,
    CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '?' ELSE ' 地名 ' END AS type, CASE WHEN p_partkey % 3 = 0 THEN 'f' ELSE '' END AS gender, [p_type, ' ', {_KEY}] AS aliases, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS note,
    CASE WHEN p_partkey % 7 = 0 THEN 'user' ELSE 'auto' END AS origin, p_partkey // 10 AS chunk, CASE WHEN p_partkey % 2 = 0 THEN 'pre' ELSE 'post' END AS phase FROM part WHERE p_size < 40),
f AS (SELECT source AS fs, arg_min(target, arrival) AS ft, min(arrival) AS fa, arg_min(origin, arrival) = 'user' AS fl FROM c WHERE source <> '' GROUP BY source),
j AS (SELECT c.*, t.source IS NOT NULL AS known, coalesce(t.target, ft) AS base, CASE WHEN c.source = '' THEN 'invalid' WHEN {{policy}} AND t.source IS NULL THEN 'rejected_by_policy' WHEN t.source IS NULL AND arrival = fa THEN 'inserted'
    WHEN c.target = coalesce(t.target, ft) THEN 'unchanged' WHEN CASE WHEN t.source IS NOT NULL THEN t.locked ELSE fl END THEN 'rejected_by_lock' ELSE 'conflict' END AS outcome FROM c LEFT JOIN t USING (source) LEFT JOIN f ON c.source = fs),
y AS (SELECT *, CASE WHEN outcome = 'inserted' THEN {_TYPE.format('type')} WHEN type = '' THEN '术语' ELSE {_TYPE.format('type')} END AS kind, outcome IN ('inserted', 'unchanged') AS same FROM j WHERE outcome IN ('inserted', 'unchanged', 'conflict')),
g AS (SELECT source, bool_or(outcome = 'inserted') AS new, bool_or(same) AS same, bool_or(outcome = 'conflict') AS conflict, min(base) AS target, arg_min(reading, arrival) FILTER (same AND reading <> '') AS reading, arg_min(gender, arrival) FILTER (same AND gender <> '') AS gender,
    arg_min(note, arrival) FILTER (same AND note <> '') AS note, arg_min(kind, arrival) FILTER (same AND kind <> '术语') AS type, arg_min(origin, arrival) FILTER (outcome = 'inserted') AS origin, arg_min(chunk, arrival) FILTER (outcome = 'inserted') AS chunk, coalesce(flatten(list(aliases) FILTER (same)), []) AS aliases FROM y GROUP BY source),
u AS (SELECT coalesce(t.source, g.source) AS source, coalesce(t.target, g.target) AS target, coalesce(nullif(t.reading, ''), g.reading, '') AS reading, CASE WHEN t.source IS NULL THEN coalesce(g.type, '术语') WHEN t.type = '术语' THEN coalesce(g.type, t.type) ELSE t.type END AS type, coalesce(nullif(t.gender, ''), g.gender, '') AS gender,
    CASE WHEN coalesce(same, false) THEN {_ALIASES.format('list_concat(coalesce(t.aliases, []), g.aliases)', 'coalesce(t.source, g.source)')} ELSE t.aliases END AS aliases, coalesce(nullif(t.note, ''), g.note, '') AS note, CASE WHEN t.source IS NULL THEN g.origin ELSE t.origin END AS origin,
    CASE WHEN t.source IS NULL THEN g.origin = 'user' ELSE t.locked END AS locked, CASE WHEN coalesce(conflict, false) THEN 'conflict' ELSE coalesce(t.status, 'ok') END AS status, CASE WHEN t.source IS NULL THEN g.chunk ELSE t.first_chunk END AS first_chunk FROM t FULL JOIN g USING (source) WHERE t.source IS NOT NULL OR new),
l AS (SELECT row_number() OVER (ORDER BY arrival) AS id, source, base AS existing_target, target AS proposed_target, chunk, phase, outcome = 'rejected_by_lock' AS resolved, CASE WHEN outcome = 'rejected_by_lock' THEN outcome ELSE '' END AS resolution, arrival FROM j WHERE outcome IN ('conflict', 'rejected_by_lock'))"""
_B, _A = _STORE.format(policy="false"), _STORE.format(policy="true")
_LINES = "x AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_linenumber::BIGINT * 10000000 + l_partkey * 1000 + l_suppkey AS line, l_partkey || '<\"&' || l_returnflag AS text FROM lineitem)"
_SIDES = [(*a, *b) for a, b in zip(_TRIANGLE, (*_TRIANGLE[1:], _TRIANGLE[0]), strict=True)]
_CROSSED = " + ".join(f"CASE WHEN least({b}, {q}) < y AND y <= greatest({b}, {q}) AND x <= {a} + (y - {b}) * ({p} - {a})::DOUBLE / nullif({q} - {b}, 0)::DOUBLE THEN 1 ELSE 0 END" for a, b, p, q in _SIDES)
_PAIRS = """pr AS (SELECT o_orderkey AS conv_id, 0::BIGINT AS turn, o_orderkey || ' {name} %d 5 ' || trunc(o_totalprice)::BIGINT || ' <b> ' || o_custkey AS src,
    o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' {name} 5 ' ELSE ' %s ' END || CASE WHEN o_orderkey % 3 = 0 THEN (trunc(o_totalprice)::BIGINT)::VARCHAR ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' <b>' ELSE '' END AS zh FROM orders)"""


def oracle_sql() -> dict[str, str]:
    return {
        "glossary_upsert": f"WITH {_B} SELECT * FROM u",
        "glossary_upsert_outcomes": f"WITH {_B} SELECT arrival, source, target, outcome FROM j",
        "glossary_upsert_user_only": f"WITH {_A} SELECT * FROM u",
        "glossary_upsert_log": f"WITH {_B} SELECT * FROM l",
        "glossary_choices": f"WITH {_B}, z AS (SELECT source, arg_max(proposed_target, arrival) AS last FROM l WHERE NOT resolved GROUP BY source), q AS (SELECT u.source, length(u.source) AS n, u.target AS own, last, o.proposed_target AS one FROM u LEFT JOIN z USING (source) LEFT JOIN l o ON o.id = 1 AND o.source = u.source) SELECT * FROM (SELECT source, CASE WHEN n % 5 = 0 THEN 'named' WHEN n % 2 = 0 THEN own WHEN n % 3 = 0 THEN one ELSE last END AS target FROM q) WHERE target IS NOT NULL",
        "glossary_store_stats": f"WITH {_B} SELECT 'total' AS level, 'terms' AS name, count(*) AS n FROM u UNION ALL SELECT 'total', 'locked', count(*) FILTER (locked) FROM u UNION ALL SELECT 'total', 'auto', count(*) FILTER (origin = 'auto') FROM u UNION ALL SELECT 'total', 'open_conflicts', count(*) FILTER (NOT resolved) FROM l UNION ALL SELECT 'by_type', type, count(*) FROM u GROUP BY type UNION ALL SELECT 'by_status', status, count(*) FROM u GROUP BY status",
        "prompt_rows": f"WITH {r._HITS}, p AS (SELECT doc_id, source, n AS hits, length(source) AS len, CASE WHEN length(source) % 2 = 0 THEN 'a' ELSE 'b' END AS type FROM h), kk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len % 5 = 0 DESC, hits DESC, CASE WHEN len % 3 > 0 THEN len ELSE 1073741824 END, type, source) AS rank, count(*) OVER (PARTITION BY doc_id) > 3 AS truncated FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY type, source)::INTEGER AS position, source, source AS target, type, len % 5 = 0 AS locked, [source] AS aliases, '' AS note, 'ok' AS status, truncated FROM kk WHERE rank <= 3",
        "extract_order": "WITH e AS (SELECT user_id AS run, event_id % 20 + 1 AS chunk, min(event_id) FILTER (event_type = 'view') AS first_seq, min(event_id) FILTER (event_type = 'purchase') AS then_seq FROM events WHERE event_id % 50 <> 0 AND event_type IN ('view', 'purchase') GROUP BY ALL) SELECT *, CASE WHEN first_seq IS NULL THEN 'missing' WHEN first_seq >= then_seq THEN 'out_of_order' ELSE 'ok' END AS status FROM e WHERE then_seq IS NOT NULL AND chunk <= 15 AND (run % 3 = 2 OR run % 3 = 1 AND chunk <= 5)",
        "stage_events": "WITH e AS (SELECT user_id AS run, event_type, (props->>'$.k')::INTEGER AS k FROM events), s AS (SELECT run, event_type, CASE WHEN k % 2 = 0 THEN 'S' || (k % 9) WHEN k % 3 > 0 THEN 'S' || (k % 5) END AS stage FROM e) SELECT run, coalesce(list_sort(list(DISTINCT stage) FILTER (event_type = 'view')), []) AS finished, coalesce(list_sort(list(DISTINCT stage) FILTER (event_type = 'click')), []) AS skipped FROM s WHERE stage IS NOT NULL GROUP BY run",
        "without_skipped": "SELECT DISTINCT user_id AS run, event_id % 50 AS chunk FROM events WHERE (user_id, event_id % 50) NOT IN (SELECT (user_id, event_id % 50) FROM events WHERE event_type = 'error' AND event_id % 7 <> 0)",
        "chunk_ids": "SELECT DISTINCT user_id AS run, event_id % 9 AS chunk FROM events WHERE user_id % 2 = 0 UNION SELECT DISTINCT user_id, event_id % 12 FROM events WHERE user_id % 2 = 1 AND event_id % 12 <> 5",
        "char_totals": "SELECT conv_id AS run, (CASE WHEN conv_id % 2 = 0 AND count(*) FILTER (turn = 0) > 0 THEN max(length(text)) FILTER (turn = 0) ELSE sum(length(text)) END)::BIGINT AS chars FROM conversations GROUP BY conv_id",
        "sample_pack": "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, n, unnest(CASE WHEN n <= 3 THEN range(1, n + 1) ELSE list_distinct(list_transform(range(0, 3), lambda k: (round_even(k * (n - 1) / 2.0::DOUBLE, 0) + 1)::BIGINT)) END) AS chunk FROM n), p AS (SELECT s.*, '## ' || chunk || ' · ' || CASE WHEN chunk = 1 THEN 'first' WHEN chunk = n THEN 'last' ELSE 'middle' END || chr(10) || chr(10) || left(text, 40) AS part FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn + 1 = chunk) SELECT conv_id AS doc_id, '# samples' || chr(10) || chr(10) || '- chunks: ' || max(n) || chr(10) || '- sampled: ' || string_agg(chunk::VARCHAR, ', ' ORDER BY chunk) || chr(10) || '- characters at most: 40' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY chunk) || chr(10) AS pack FROM p GROUP BY conv_id",
        "recognised_texts": f"""WITH {_LINES}, p AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY line, text) AS text, '<PAGE>' || string_agg('<LINE STRING="' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '"/>', '' ORDER BY line, text) || '</PAGE>' AS xml, list(text ORDER BY line, text) AS contents FROM x GROUP BY doc, page)
            SELECT doc, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, '<OCRDATASET>' || chr(10) || string_agg(xml, chr(10) ORDER BY page) || chr(10) || '</OCRDATASET>' AS xml, to_json({{'contents': list(contents ORDER BY page), 'page_count': count(*)::INTEGER}})::VARCHAR AS json FROM p GROUP BY doc""",
        "in_polygon": f"WITH p AS (SELECT o_orderkey, (o_orderkey * 7 % 100)::DOUBLE AS x, (o_custkey * 13 % 100)::DOUBLE AS y FROM orders) SELECT o_orderkey, CASE WHEN y = 10 AND x BETWEEN 10 AND 90 THEN 0 WHEN ({_CROSSED}) % 2 = 1 THEN 1 ELSE -1 END::INTEGER AS place FROM p",
        "tier_settings": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'f' WHEN n_nationkey % 2 = 0 THEN 'c' ELSE 'S' END AS fast, CASE WHEN n_nationkey % 2 = 0 THEN 'c' ELSE 'S' END AS cheap, 'S' AS strong, 'S' AS other, CASE WHEN n_nationkey % 12 <= 8 THEN (n_nationkey % 12)::BIGINT END AS stage FROM nation",
        "number_missing": f"WITH {_PAIRS}, {r._NUMBERS} SELECT * FROM g",
        "placeholder_diff": f"WITH {_PAIRS}, {r._PLACES} SELECT * FROM x WHERE n_src <> n_zh",
        "residue_kana": "WITH l AS (SELECT doc_id, string_split(translate(text, 'öüäß', 'カナ゛Ａ'), chr(10)) AS ls FROM documents), c AS (SELECT doc_id, line, regexp_extract_all(t, '[カナ゛]') AS cs FROM (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line, unnest(ls) AS t FROM l)) SELECT doc_id, line, len(cs)::INTEGER AS n_chars, array_to_string(list_sort(list_distinct(cs))[1:20], '') AS found FROM c WHERE len(cs) > 0",
        "katakana_runs": "WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[öüä][a-z]', 'カナー', 'g'), '[カナー]{3,}')) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 3",
        "headings": "SELECT o_orderkey, o_custkey % 2 = 0 AS head FROM orders",
    }
