"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, decontaminate, exact_dedup, html_text, language_id, mixing, pii, simhash, substring_dedup, toxicity, url_filter, warc, whitening
from .shared import table


#: Where the public tokenizers' files are; any other caller passes their contents.
TOKENIZERS = "file:///opt/tokenizers"
#: The key of the registered query; any other caller must bring one.
DEMO_KEY = "textloom-demo-key"


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.toxicity(docs, toxicity.fit(spark, docs, table(spark, d, "labels")))


def op2_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, d, "documents"))


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "labels"), columns=["doc_id"])


def op4_warc_revisits(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, d, "pages"))


def op5_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.duplicate_spans(table(spark, d, "documents"), digest_only=True)


def op6_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages"))


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_groups(table(spark, d, "documents"))


def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.pseudonyms(table(spark, d, "documents"), DEMO_KEY).select("doc_id", "text", "n_values")


def op10_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.main_text(table(spark, d, "pages"))


def op11_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(table(spark, d, "documents"))


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return align.alignment(docs, align.read(spark, f"{TOKENIZERS}/byte_bpe_50k.json"), align.read(spark, f"{TOKENIZERS}/piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_mixing, op4_warc_revisits, op5_substring_dedup, op6_url_filters, op7_decontamination, op8_simhash, op9_pii, op10_html_text, op11_language_id, op12_alignment, op13_whitening)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

_OP4 = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS original FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to
FROM f
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
r AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN m USING (k) WHERE first < doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, len(w) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, place: NOT list_contains(gone, place)) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM o
"""

#: The pages of the tables have no link to another host, so each host keeps its own share of the seeds.
_OP6 = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
h AS (SELECT page_id, {_LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
b AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
j AS (SELECT h.*, rule, v FROM h LEFT JOIN b USING (page_id)),
c AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS x FROM j WHERE host <> '' GROUP BY host),
t AS (SELECT host, (1 - 0.85::DOUBLE) * (a / greatest(sum(a) OVER (), 1)::DOUBLE) AS trust, (1 - 0.85::DOUBLE) * (x / greatest(sum(x) OVER (), 1)::DOUBLE) AS distrust FROM c)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN t ON j.host = t.host
"""

_OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[place:place + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS place FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, place, n, array_to_string(w[place:place + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS place FROM d, (SELECT DISTINCT n FROM i))),
o AS (SELECT doc_id, place, g.n, item_id FROM g JOIN i ON g.k = i.k AND g.n = i.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS pos FROM o) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_warc_revisits": _OP4, "op5_substring_dedup": _OP5, "op6_url_filters": _OP6, "op7_decontamination": _OP7}
