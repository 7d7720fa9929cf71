"""Queries of the engine and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HEADING, PLACEHOLDERS, TERMINAL
from ..operators import chunking, events, glossary, quality

Query = Callable[[SparkSession, str], DataFrame]
TERMS_OF = "benchmark"
PRICES = {"view": (0.1, 1.0), "purchase": (0.2, 2.0), "click": (0.05, 0.5)}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "documents"))


def _pairs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(quality.pairs(table(spark, d, "conversations")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return glossary.term_occurrences(table(spark, d, "documents"), glossary.ascii_terms(table(spark, d, TERMS_OF)))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Parts as glossary terms: those of size 50 are the locked seeds (the last wins), the others candidates in order."""
    part = table(spark, d, "part")
    seeds = part.where("p_size = 50").groupBy(F.col("p_name").alias("source")).agg(F.max_by("p_brand", "p_partkey").alias("target"))
    return glossary.merge(seeds, part.where("p_size <> 50").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.col("p_partkey").alias("arrival")))


def _events(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(table(spark, d, "events"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sample_positions(table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n")


def _owing(spark: SparkSession, d: str) -> DataFrame:
    """Customers who have orders, but none that is finished and not of high priority."""
    o = table(spark, d, "orders")
    return events.pending(o, o.where("o_orderstatus = 'F' and o_orderpriority > '2'"), "o_custkey")


def queries() -> dict[str, Query]:
    return {
        "paragraph_explode": _docs(chunking.paragraph_explode),
        "sentence_split": _docs(chunking.sentence_split),
        "chunk_structure": _docs(chunking.chunk_structure),
        "boundary_suspects": _docs(chunking.boundary_suspects),
        "digest_packs": _docs(lambda x: chunking.digest_packs(x, "source")),
        "merge_chunks": lambda s, d: chunking.merge_chunks(table(s, d, "conversations"), "conv_id", "turn", "text"),
        "sample_positions": _turns,
        "align_issues": _pairs(quality.align_issues),
        "align_summary": _pairs(quality.align_summary),
        "qa_summary": _pairs(lambda p: quality.qa_summary(p, "[dwüé]{2}")),
        "residue_scan": _docs(quality.residue_scan),
        "punct_scan": _docs(quality.punct_scan),
        "term_hits": _hits,
        "term_hits_topk": lambda s, d: glossary.hits_topk(_hits(s, d), 3),
        "hits_backfill": lambda s, d: glossary.backfill(_hits(s, d)),
        "run_frequency_suggestions": lambda s, d: glossary.frequent_runs(table(s, d, "documents"), glossary.ascii_terms(table(s, d, TERMS_OF))),
        "glossary_merge": _merged,
        "glossary_conflicts": lambda s, d: glossary.conflicts(_merged(s, d)),
        "glossary_stats": lambda s, d: glossary.stats(_merged(s, d)),
        "glossary_latest_conflict": lambda s, d: glossary.latest_conflict(glossary.conflicts(_merged(s, d))),
        "happens_before": _events(lambda e: events.happens_before(e, "view", "purchase", "user_id", "event_id")),
        "event_seq": _events(lambda e: events.sequenced(e.select("event_id", "user_id"), "event_id")),
        "pending_chunks": _owing,
        "status_counters": lambda s, d: events.status_counters(table(s, d, "orders"), "o_orderstatus", "F", "P"),
        "usage_rollup": _events(lambda e: events.usage_rollup(events.usage_facts(e))),
        "usage_cost": _events(lambda e: events.usage_cost(events.usage_facts(e), PRICES)),
        "cascade_route": _docs(lambda x: events.cascade_route(chunking.paragraph_explode(x))),
    }


_T = TERMINAL
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PARAS = f"""
d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS ps FROM documents),
p AS (SELECT doc_id, unnest(range(len(ps)))::INTEGER AS para_idx, unnest(ps) AS para FROM d)"""
_SENTS = f"list_filter(list_transform(regexp_extract_all(para, '[^{_T}]*[{_T}]|[^{_T}]+$'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_CHUNKS = f"""RECURSIVE {_PARAS},
q AS (SELECT *, length(para) <= 60 AND regexp_matches(para, '{HEADING}') AS head FROM p),
u AS (SELECT doc_id, para_idx, 0 AS s, head, false AS long, para AS t FROM q WHERE head OR length(para) <= {chunking.LONGEST}
    UNION ALL SELECT doc_id, para_idx, unnest(range(len(ss))) AS s, false, true, unnest(ss) AS t FROM (SELECT *, {_SENTS} AS ss FROM q WHERE NOT head AND length(para) > {chunking.LONGEST})),
n AS (SELECT *, length(t) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, s) AS k FROM u),
r AS (SELECT doc_id, k, head, long, para_idx, l AS cur, 1 AS chunk FROM n WHERE k = 1
    UNION ALL
    SELECT doc_id, k, head, long, para_idx, CASE WHEN fresh THEN l ELSE cur + l END, chunk + fresh::INTEGER
    FROM (SELECT n.*, r.cur, r.chunk, n.head OR r.head OR n.long <> r.long OR (n.long AND n.para_idx <> r.para_idx) OR r.cur + n.l > {chunking.TARGET} AS fresh FROM n JOIN r ON n.doc_id = r.doc_id AND n.k = r.k + 1)),
c AS (SELECT doc_id, chunk, string_agg(t, chr(10) || chr(10) ORDER BY k) AS body, count(*)::INTEGER AS paragraphs, min(n.para_idx) AS start_paragraph, bool_or(n.head) AS is_head
    FROM n JOIN r USING (doc_id, k) GROUP BY doc_id, chunk),
b AS (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY chunk) AS prev FROM c)"""
_OPEN = "strpos('" + TERMINAL + "', right({}, 1)) = 0"
_PAIRS = "s AS (SELECT conv_id, turn, text AS src FROM conversations WHERE role = 'user'), z AS (SELECT conv_id, turn - 1 AS turn, text AS zh FROM conversations WHERE role = 'assistant'), pr AS (SELECT * FROM s LEFT JOIN z USING (conv_id, turn))"
_N_PARAS = f"len(list_filter(string_split({{}}, chr(10)), lambda x: {_STRIP.format('x')} <> ''))"
_ALIGN = f"""WITH {_PAIRS},
m AS (SELECT *, ({_N_PARAS.format("zh")} - {_N_PARAS.format("src")})::INTEGER AS delta, {_N_PARAS.format("src")} AS ns, length({_STRIP.format("zh")})::DOUBLE / length({_STRIP.format("src")}) AS ratio, zh IS NOT NULL AND {_STRIP.format("zh")} <> '' AS full_ FROM pr),
i AS (SELECT conv_id, turn, 'missing_file' AS kind, 'error' AS severity, NULL::INTEGER AS delta, NULL::DOUBLE AS ratio FROM m WHERE zh IS NULL
    UNION ALL SELECT conv_id, turn, 'empty_translation', 'error', NULL, NULL FROM m WHERE zh IS NOT NULL AND NOT full_
    UNION ALL SELECT conv_id, turn, 'paragraph_mismatch', CASE WHEN abs(delta) >= 2 OR abs(delta)::DOUBLE / ns >= 0.15 THEN 'error' ELSE 'warn' END, delta, NULL FROM m WHERE full_ AND delta <> 0
    UNION ALL SELECT conv_id, turn, 'length_ratio', 'warn', NULL, round_even(ratio, 4) FROM m WHERE full_ AND (ratio < {quality.RATIO_MIN} OR ratio > {quality.RATIO_MAX}))"""
_NUMBERS = """a AS (SELECT conv_id, turn, number, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(src, '[0-9]+')) AS number FROM pr WHERE zh IS NOT NULL) GROUP BY ALL),
e AS (SELECT conv_id, turn, number, count(*) AS m FROM (SELECT conv_id, turn, unnest(regexp_extract_all(zh, '[0-9]+')) AS number FROM pr) GROUP BY ALL),
g AS (SELECT conv_id, turn, number, n - coalesce(m, 0) AS missing FROM a LEFT JOIN e USING (conv_id, turn, number) WHERE n > coalesce(m, 0))"""
_PLACES = "x AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS class, len(regexp_extract_all(src, '{r}'))::INTEGER AS n_src, len(regexp_extract_all(zh, '{r}'))::INTEGER AS n_zh FROM pr WHERE zh IS NOT NULL" for k, r in PLACEHOLDERS.items()) + ")"
_HITS = """w AS (SELECT DISTINCT source FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS source FROM benchmark) WHERE length(source) >= 8),
k AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9_]+')) AS source FROM documents),
h AS (SELECT doc_id, source, count(*) AS n FROM k JOIN w USING (source) GROUP BY ALL)"""
_MERGE = """sd AS (SELECT p_name AS source, arg_max(p_brand, p_partkey) AS locked FROM part WHERE p_size = 50 GROUP BY p_name),
ca AS (SELECT p_name AS source, p_brand AS target, p_partkey AS arrival, first(p_brand) OVER v AS first_, row_number() OVER v AS rank FROM part WHERE p_size <> 50 WINDOW v AS (PARTITION BY p_name ORDER BY p_partkey)),
mg AS (SELECT arrival, source, target, coalesce(locked, first_) AS kept, CASE WHEN trim(source) = '' OR trim(target) = '' THEN 'invalid' WHEN locked = target THEN 'unchanged'
    WHEN locked IS NOT NULL THEN 'rejected_by_lock' WHEN rank = 1 THEN 'inserted' WHEN target = first_ THEN 'unchanged' ELSE 'conflict' END AS action FROM ca LEFT JOIN sd USING (source)),
cf AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY arrival)::INTEGER AS nth, arrival, kept AS existing_target, target AS proposed_target, action = 'rejected_by_lock' AS resolved FROM mg WHERE action IN ('conflict', 'rejected_by_lock'))"""
_USAGE = "f AS (SELECT event_type AS tier, CASE WHEN k % 4 <> 0 THEN 'S' || (k % 4) END AS stage, floor(value)::BIGINT AS tokens, k % 2 = 0 AS hit FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))"
_ROLL = "count(*) AS calls, sum(tokens)::BIGINT AS tokens, coalesce(round_even(sum(CASE WHEN hit THEN tokens ELSE 0 END)::DOUBLE / nullif(sum(tokens), 0)::DOUBLE, 4), 0.0) AS hit_rate"


def oracle_sql() -> dict[str, str]:
    return {
        "paragraph_explode": f"WITH {_PARAS} SELECT * FROM p",
        "sentence_split": f"WITH {_PARAS} SELECT doc_id, para_idx, unnest(range(len(ss)))::INTEGER AS sent_idx, unnest(ss) AS sentence FROM (SELECT *, {_SENTS} AS ss FROM p)",
        "chunk_structure": f"WITH {_CHUNKS} SELECT doc_id, chunk, length(body)::INTEGER AS chars, paragraphs, start_paragraph, is_head, sum(is_head::BIGINT) OVER (PARTITION BY doc_id ORDER BY chunk)::BIGINT AS chapter_index, coalesce({_OPEN.format('prev')}, false) AS starts_mid_sentence, {_OPEN.format('body')} AS ends_mid_sentence, sha256(body) AS sha256 FROM b",
        "boundary_suspects": f"WITH {_CHUNKS} SELECT doc_id, chunk - 1 AS prev_chunk, chunk AS next_chunk, right(prev, 40) AS prev_end, left(body, 40) AS cur_start FROM b WHERE prev IS NOT NULL AND {_OPEN.format('prev')}",
        "digest_packs": "SELECT source, pack, count(*) AS n_docs, sum(length(text))::BIGINT AS total_chars, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 + 1 AS pack FROM documents) GROUP BY source, pack",
        "merge_chunks": f"SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) || chr(10) AS merged FROM (SELECT conv_id, turn, {_STRIP.format('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id",
        "sample_positions": "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(CASE WHEN n <= 5 THEN range(1, n + 1) ELSE list_distinct(list_transform(range(0, 5), lambda k: (round_even(k * (n - 1) / 4.0::DOUBLE, 0) + 1)::BIGINT)) END) AS position FROM n",
        "align_issues": f"{_ALIGN} SELECT * FROM i",
        "align_summary": f"{_ALIGN} SELECT kind, severity, count(*) AS n, count(DISTINCT (conv_id, turn)) AS n_chunks FROM i GROUP BY kind, severity",
        "qa_summary": f"""WITH {_PAIRS}, {_NUMBERS}, {_PLACES}, fl AS (SELECT * FROM pr WHERE zh IS NOT NULL AND {_STRIP.format("zh")} <> '')
            SELECT 'empty' AS kind, count(*) AS n FROM pr WHERE zh IS NULL OR {_STRIP.format("zh")} = '' UNION ALL SELECT 'number', count(DISTINCT (conv_id, turn)) FROM g UNION ALL SELECT 'paragraph', count(*) FROM fl WHERE {_N_PARAS.format("src")} <> {_N_PARAS.format("zh")}
            UNION ALL SELECT 'placeholder', count(*) FROM x WHERE n_src <> n_zh UNION ALL SELECT 'punctuation', count(*) FROM fl WHERE regexp_matches(zh, '[,.!?;:]') UNION ALL SELECT 'residue', count(*) FROM (SELECT unnest(string_split(zh, chr(10))) AS t FROM fl) WHERE regexp_matches(t, '[dwüé]{{2}}')""",
        "residue_scan": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, line, regexp_extract_all(t, '[äöüß]') AS cs FROM (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line, unnest(ls) AS t FROM l)) SELECT doc_id, line, len(cs)::INTEGER AS n_chars, array_to_string(list_sort(list_distinct(cs))[1:20], '') AS found FROM c WHERE len(cs) > 0",
        "punct_scan": "SELECT doc_id, len(regexp_extract_all(text, '[,.!?;:]'))::INTEGER AS n_half_width, len(regexp_extract_all(text, '[「」『』]'))::INTEGER AS n_brackets FROM documents",
        "term_hits": f"WITH {_HITS} SELECT * FROM h",
        "term_hits_topk": f"WITH {_HITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, source)::INTEGER AS rank, count(*) OVER (PARTITION BY doc_id) > 3 AS truncated FROM h) WHERE rank <= 3",
        "hits_backfill": f"WITH {_HITS} SELECT source, sum(n)::BIGINT AS hits, min(doc_id) AS first_doc FROM h GROUP BY source",
        "run_frequency_suggestions": f"WITH {_HITS}, t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zäöüß]{{9,}}')) AS token FROM documents) GROUP BY token HAVING count(*) >= 3) SELECT * FROM t WHERE token NOT IN (SELECT source FROM w) ORDER BY n DESC, token LIMIT 20",
        "glossary_merge": f"WITH {_MERGE} SELECT * FROM mg",
        "glossary_conflicts": f"WITH {_MERGE} SELECT * FROM cf",
        "glossary_stats": f"WITH {_MERGE} SELECT action, count(*) AS n, count(DISTINCT source) AS sources FROM mg GROUP BY action",
        "glossary_latest_conflict": f"WITH {_MERGE} SELECT source, arg_max(proposed_target, arrival) AS proposed_target, max(arrival) AS arrival, count(*) AS open FROM cf WHERE NOT resolved GROUP BY source",
        "happens_before": "SELECT *, CASE WHEN first_seq IS NULL THEN 'missing' WHEN first_seq >= then_seq THEN 'out_of_order' ELSE 'ok' END AS status FROM (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS first_seq, min(event_id) FILTER (event_type = 'purchase') AS then_seq FROM events GROUP BY user_id) WHERE then_seq IS NOT NULL",
        "event_seq": "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS seq FROM events",
        "pending_chunks": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority > '2')",
        "status_counters": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending FROM orders",
        "usage_rollup": f"WITH {_USAGE} SELECT 'tier' AS level, tier AS name, {_ROLL} FROM f GROUP BY tier UNION ALL SELECT 'stage', stage, {_ROLL} FROM f WHERE stage IS NOT NULL GROUP BY stage UNION ALL SELECT 'total', 'all', {_ROLL} FROM f",
        "usage_cost": f"WITH {_USAGE}, t AS (SELECT tier, coalesce(sum(tokens) FILTER (hit), 0)::BIGINT AS hit_tokens, coalesce(sum(tokens) FILTER (NOT hit), 0)::BIGINT AS miss_tokens FROM f GROUP BY tier), c(tier, ph, pm) AS (VALUES " + ", ".join(f"('{t}', {h}::DOUBLE, {m}::DOUBLE)" for t, (h, m) in PRICES.items()) + ") SELECT t.*, round_even((hit_tokens * ph + miss_tokens * pm) / 1e6::DOUBLE, 6) AS cost FROM t LEFT JOIN c USING (tier)",
        "cascade_route": f"WITH {_PARAS} SELECT doc_id, para_idx, length(para)::INTEGER AS predicted, CASE WHEN length(para) < 25 THEN 30 WHEN length(para) < 45 THEN 50 ELSE 100 END AS model, length(para) >= 98 AS halved FROM p",
    }
