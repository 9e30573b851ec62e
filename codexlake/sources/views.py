"""Inputs of the operators as views over the given tables, and the same views as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codexlake.cluster import bounded

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Views in the order in which they build on each other; the SQL runs in Spark and in DuckDB.
VIEWS: dict[str, str] = {
    "v_archives": "SELECT CAST(dense_rank() OVER (ORDER BY source) AS INT) AS id, source AS name, min(lang) AS language, count(*) AS indexed_entries, CASE WHEN source LIKE '%7' THEN 'pending' ELSE 'ready' END AS index_status, source NOT LIKE '%3' AS embed_enabled FROM documents GROUP BY source",
    "v_articles": "SELECT d.doc_id AS id, a.id AS archive_id, d.source AS archive, concat('A/Doc_', CAST(d.doc_id AS VARCHAR(20))) AS path, substring(trim(split_part(d.text, chr(10), 1)), 1, 80) AS title, substring(d.text, 1, 2000) AS content_preview, d.lang AS language FROM documents d JOIN v_archives a ON a.name = d.source",
    "v_entity_links": "SELECT archive_id, path, id % 97 AS qid FROM v_articles WHERE id % 5 <> 0",
    "v_titles": "SELECT p_partkey AS id, lower(p_name) AS title_lower, p_brand AS archive FROM part",
    "v_vectors": "SELECT vec_id AS id, embedding, label FROM embeddings WHERE vec_id % 10 <> 0",
    "v_catalog": "SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS name, c_custkey * 10 AS file_size, CASE WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'pending' END AS index_status FROM customer WHERE c_custkey % 10 <> 0",
    "v_snapshot": "SELECT concat('c', CAST(c_custkey AS VARCHAR(20))) AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN c_custkey * 10 + 1 ELSE c_custkey * 10 END AS file_size FROM customer WHERE c_custkey % 7 <> 0",
    "v_transfers": "SELECT o_orderkey AS id, concat('t', CAST(o_custkey AS VARCHAR(20))) AS name, concat('http://h/', CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_orderkey % 3 = 0 THEN '.zim?x=1' ELSE '.torrent' END) AS url, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'downloading' WHEN 2 THEN 'complete' WHEN 3 THEN 'seeding' WHEN 4 THEN 'error' ELSE 'cancelled' END AS status, CASE WHEN o_orderkey % 6 = 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'connection refused: port 40152' ELSE 'connect failed: HTTP 401' END END AS error, CASE WHEN o_orderkey % 6 IN (2,3) THEN md5(concat(CAST(o_custkey AS VARCHAR(20)), o_orderpriority)) END AS digest, o_orderdate AS updated_at FROM orders",
    "v_local": "SELECT concat(lower(n_name), '_2024-', CASE WHEN n_nationkey % 2 = 0 THEN '03' ELSE '06' END) AS name FROM nation",
    "v_feed": "SELECT n_nationkey * 3 + k AS feed_pos, concat('http://h/', lower(n_name), '_2024-0', CAST(k + 4 AS VARCHAR(4)), '.zim') AS href, '2024-07-15T00:00:00Z' AS updated FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks WHERE n_nationkey % 4 <> 0",
    "v_outcomes": "SELECT user_id AS branch, event_id AS seq, ts, CASE WHEN event_type IN ('error','view') THEN 0 ELSE 1 END AS ok FROM events",
    "v_listing": "SELECT md5(concat(CAST(o_custkey AS VARCHAR(20)), o_orderpriority)) AS hash, concat('T', CAST(o_custkey AS VARCHAR(20))) AS name, CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE (o_orderkey % 100) / 100.0 END AS progress, CASE o_orderkey % 4 WHEN 0 THEN 'uploading' WHEN 1 THEN 'downloading' WHEN 2 THEN 'error' ELSE 'stalledUP' END AS state, o_orderkey AS seq FROM orders WHERE o_orderkey % 7 = 0",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """The query with the views that it needs before it, in order."""
    need: set[str] = set()
    todo = _needs(sql)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += _needs(VIEWS[v])
    if not need:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; built from DataFrames, so nothing is registered in the session."""
    sql = VIEWS[name]
    parts = {x: (view(spark, sf_dir, x) if x in VIEWS else table(spark, sf_dir, x)) for x in [*VIEWS, *TABLES] if x != name and re.search(rf"(FROM|JOIN) {x}\b", sql)}
    if "v_archives" in parts:
        # archives are few; unless they are broadcast, whole texts are shuffled to meet them
        parts["v_archives"] = bounded(parts["v_archives"])
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in parts else m[0], sql), **parts)
