"""Queries over hits as files, rows of CSV texts, rounds of repair and the state of a run, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle, models
from ..sources import writers
from .registry import Query, table


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a hit of the chunk that its size stands for."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_size").alias("chunk"), k.alias("position"), F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.when(k % 4 == 0, F.concat("p_type", F.lit(' "x"'))).otherwise(F.col("p_type")).alias("type"), (k % 5 == 0).alias("locked"), F.array("p_brand", "p_type").alias("aliases"),
        F.when(k % 3 == 0, F.lit("a,b")).when(k % 3 == 1, "").alias("note"), F.lit("ok").alias("status"), F.when(k % 7 == 0, "user").otherwise("auto").alias("origin"), (k % 50 == 0).alias("truncated"),
    )


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a value that is wrong above 0 and that each round lowers by 1."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("left"))
    return models.repair_rounds(rows, "o_orderkey", lambda r: r.where("left > 0"), lambda bad: bad.withColumn("left", F.col("left") - 1))


def _status(spark: SparkSession, d: str) -> DataFrame:
    k, number = F.col("o_orderkey"), F.col("o_custkey")
    run = F.struct(
        (k % 9).alias("stage_index"), F.lit(9).alias("stage_total"), F.col("o_orderstatus").alias("stage_name"), number.alias("total"), F.when(k % 2 == 0, number).alias("done"), (k % 3).alias("failed"), F.lit(0).alias("skipped"), k.alias("terms"), (k % 11).alias("locked"),
        (k % 4).alias("open_conflicts"), (k % 5).alias("issues"), (k % 6).alias("misaligned"), F.when(k % 3 > 0, k % 3 == 1).alias("compliant"), F.when(k % 2 == 0, "m").alias("message"),
    )
    return table(spark, d, "orders").select("o_orderkey", lifecycle.status_document(run).alias("document"))


def queries() -> dict[str, Query]:
    return {
        "hits_json": lambda s, d: writers.hits_json(_hits(s, d), "chunk"),
        "hits_csv": lambda s, d: writers.hits_csv(_hits(s, d), "chunk"),
        "csv_rows": lambda s, d: table(s, d, "documents").select("doc_id", writers.csv_rows(F.col("text")).alias("n")),
        "repair_rounds": _repaired,
        "status_document": _status,
    }


_ROWS = """x AS (SELECT p_size AS chunk, p_partkey AS k, p_name AS source, p_brand AS target, CASE WHEN p_partkey % 4 = 0 THEN p_type || ' "x"' ELSE p_type END AS type, [p_brand, p_type] AS aliases, CASE p_partkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN '' END AS note FROM part)"""


def oracle_sql() -> dict[str, str]:
    return {
        "hits_json": f"""WITH {_ROWS.replace("WHEN 1 THEN ''", "ELSE ''")}, y AS (SELECT *, k % 3 = 2 AS no_note FROM x) SELECT chunk, rtrim(to_json({{'count': count(*), 'truncated': bool_or(k % 50 = 0)}})::VARCHAR, '}}') || ',"terms":[' || string_agg(CASE WHEN no_note
            THEN to_json({{'source': source, 'target': target, 'type': type, 'locked': k % 5 = 0, 'aliases': aliases, 'status': 'ok'}})::VARCHAR ELSE to_json({{'source': source, 'target': target, 'type': type, 'locked': k % 5 = 0, 'aliases': aliases, 'note': note, 'status': 'ok'}})::VARCHAR END, ',' ORDER BY k) || ']}}' AS json FROM y GROUP BY chunk""",
        "hits_csv": f"""WITH {_ROWS} SELECT chunk, '日语,中文,类型,来源,备注' || chr(10) || string_agg(source || ',' || target || ',' || CASE WHEN k % 4 = 0 THEN '"' || replace(type, '"', '""') || '"' ELSE type END || ',' || CASE WHEN k % 7 = 0 THEN '用户' ELSE '自动' END || ',' || CASE WHEN note = 'a,b' THEN '"a,b"' ELSE '' END, chr(10) ORDER BY k) || chr(10) AS csv FROM x GROUP BY chunk""",
        "csv_rows": "SELECT doc_id, len(list_filter(list_filter(string_split(text, chr(10)), lambda x: x <> '')[2:], lambda x: regexp_matches(x, '[^\\s　]')))::INTEGER AS n FROM documents",
        "repair_rounds": 'SELECT o_orderkey, greatest(o_orderkey % 7 - 3, 0) AS "left" FROM orders',
        "status_document": "SELECT o_orderkey, '### Stage ' || (o_orderkey % 9 + 1) || '/9 · ' || o_orderstatus || chr(10) || chr(10) || '- chunks: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END || '/' || o_custkey || ' (' || o_orderkey % 3 || ' failed, 0 skipped)' || chr(10) || '- terms: ' || o_orderkey || ' (' || o_orderkey % 11 || ' locked), open conflicts: ' || o_orderkey % 4 || chr(10) || '- issues: ' || o_orderkey % 5 || ', misaligned: ' || o_orderkey % 6 || chr(10) || '- compliant: ' || CASE o_orderkey % 3 WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE '' END || chr(10) || '- ' || CASE WHEN o_orderkey % 2 = 0 THEN 'm' ELSE '' END || chr(10) AS document FROM orders",
    }
