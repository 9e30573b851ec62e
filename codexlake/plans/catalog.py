"""Queries over the catalog operators (K)."""

from pyspark.sql import functions as F

from codexlake.cluster import scratch
from codexlake.operators import catalog as C
from codexlake.operators import ledger as G
from codexlake.plans.registry import query
from codexlake.sources.versions import read_version
from codexlake.sources.views import table, view


@query("K1_reindex", "WITH o AS (SELECT id, archive, path FROM v_articles WHERE id % 4 <> 0), n AS (SELECT archive, path, title FROM v_articles WHERE id % 5 <> 0), j AS (SELECT n.*, o.id AS oid FROM n LEFT JOIN o ON o.archive = n.archive AND o.path = n.path) SELECT coalesce(oid, (SELECT max(id) FROM o) + row_number() OVER (PARTITION BY oid IS NULL ORDER BY archive, path)) AS id, archive, path, title, oid IS NOT NULL AND oid % 10 <> 0 AS has_vector FROM j")
def _(spark, d):
    a = view(spark, d, "v_articles")
    vec = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 0, F.array(F.lit(1.0))).alias("embedding"))
    old = a.where("id % 4 <> 0").join(vec, "id")
    out = C.reindex(old, a.where("id % 5 <> 0").select("archive", "path", "title"))
    return out.select("id", "archive", "path", "title", F.col("embedding").isNotNull().alias("has_vector"))


_TWICE = "a AS (SELECT * FROM v_articles WHERE id % 4 <> 0), n AS (SELECT archive, path FROM v_articles WHERE id % 5 <> 0 AND archive <= 'src4'), r AS (SELECT archive, path FROM n UNION ALL SELECT archive, path FROM a WHERE archive NOT IN (SELECT archive FROM n)), l AS (SELECT archive, path, id % 97 AS qid FROM v_articles WHERE id % 5 <> 1)"


@query("K1_reindex_merge", f"WITH {_TWICE} SELECT 'article' AS kind, archive, path FROM r UNION ALL SELECT 'link', archive, path FROM l JOIN r USING (archive, path) UNION ALL SELECT 'archive', archive, CASE WHEN archive IN (SELECT archive FROM n) THEN '2024-02-02' ELSE '2024-01-01' END FROM (SELECT DISTINCT archive FROM r)")
def _(spark, d):
    # a first run over all archives, and a second over some of them
    path = scratch(spark, "reindex")
    a = view(spark, d, "v_articles").select("id", "archive", "path", "title")
    links = a.where("id % 5 <> 1").select("archive", "path", (F.col("id") % 97).alias("qid"))
    C.merge_reindex(path, a.where("id % 4 <> 0").drop("id"), links, F.expr("DATE '2024-01-01'"))
    C.merge_reindex(path, a.where("id % 5 <> 0 and archive <= 'src4'").drop("id"), links, F.expr("DATE '2024-02-02'"))
    articles, kept, runs = (read_version(spark, f"{path}/{t}") for t in ("articles", "links", "archives"))
    out = articles.select(F.lit("article").alias("kind"), "archive", "path").unionByName(kept.select(F.lit("link").alias("kind"), "archive", "path"))
    return out.unionByName(runs.select(F.lit("archive").alias("kind"), "archive", F.col("updated_at").cast("string").alias("path")))


@query("K2_snapshot_diff", "SELECT coalesce(c.name, s.name) AS name, CASE WHEN c.name IS NULL THEN 'added' WHEN s.name IS NULL THEN 'removed' WHEN s.file_size IS NULL THEN 'unreadable' WHEN c.file_size <> s.file_size THEN 'changed' ELSE 'same' END AS change, CASE WHEN c.name IS NULL OR (s.file_size IS NOT NULL AND c.file_size <> s.file_size) THEN 'pending' ELSE c.index_status END AS index_status FROM v_catalog c FULL JOIN v_snapshot s ON c.name = s.name")
def _(spark, d):
    return C.snapshot_diff(view(spark, d, "v_catalog"), view(spark, d, "v_snapshot"))


#: Some names and entries carry no date; entries differ in their `updated`, and some have none.
_HREF = "CASE WHEN feed_pos % 4 = 1 THEN regexp_replace(href, '_2024-0[0-9]', '') ELSE href END"
_UPDATED = "CASE feed_pos % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-09-01T00:00:00Z' WHEN 2 THEN 'soon' ELSE updated END"
_NAME = "CASE WHEN length(name) % 3 = 0 THEN regexp_replace(name, '_2024-0[0-9]', '') ELSE name END"
_DATE = "CASE WHEN length(name) % 2 = 0 THEN '2024-06-30' END"
_FOUND = (
    f"f AS (SELECT feed_pos, {_HREF} AS href, {_UPDATED} AS updated FROM v_feed), l AS (SELECT {_NAME} AS name, {_DATE} AS d FROM v_local), "
    "fe AS (SELECT *, regexp_extract(href, '/([^/]+)\\.zim$', 1) AS stem FROM f), fv AS (SELECT *, regexp_replace(stem, '_\\d{4}-\\d{2}$', '') AS base, nullif(regexp_extract(stem, '_(\\d{4}-\\d{2})$', 1), '') AS v FROM fe), "
    "lv AS (SELECT *, regexp_replace(name, '_\\d{4}-\\d{2}$', '') AS base, nullif(regexp_extract(name, '_(\\d{4}-\\d{2})$', 1), '') AS v FROM l), "
    "c AS (SELECT lv.name, href, feed_pos, coalesce(fv.v, CASE WHEN regexp_matches(updated, '^\\d{4}-\\d{2}') THEN left(updated, 7) ELSE '0' END) AS rank FROM lv JOIN fv USING (base) WHERE CASE WHEN lv.v IS NOT NULL AND fv.v IS NOT NULL THEN fv.v > lv.v ELSE left(updated, 7) > left(d, 7) END)"
)


@query("K3_find_updates", f"WITH {_FOUND} SELECT name, href, feed_pos FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank DESC, feed_pos) = 1")
def _(spark, d):
    feed = view(spark, d, "v_feed").selectExpr("feed_pos", f"{_HREF} AS href", f"{_UPDATED} AS updated")
    return C.find_updates(feed, view(spark, d, "v_local").selectExpr(f"{_NAME} AS name", f"{_DATE} AS date"))


@query("K4_download_link", "SELECT feed_pos, CASE WHEN feed_pos % 2 = 0 THEN href ELSE concat('http://m/', feed_pos) END AS href FROM v_feed")
def _(spark, d):
    links = F.expr("array(named_struct('_rel', 'alternate', '_href', 'http://x/page', '_type', 'text/html'), CASE WHEN feed_pos % 2 = 0 THEN named_struct('_rel', '', '_href', href, '_type', '') ELSE named_struct('_rel', 'http://opds-spec.org/acquisition/open', '_href', concat('http://m/', feed_pos), '_type', '') END)")
    return view(spark, d, "v_feed").select("feed_pos", C.download_link(links).alias("href"))


_UPD = "u AS (SELECT DISTINCT concat('http://h/', CAST(c_custkey AS VARCHAR(20)), '.zim?x=1') AS url, CASE WHEN c_custkey % 2 = 0 THEN md5(concat(CAST(c_custkey AS VARCHAR(20)), '1-URGENT')) END AS claim FROM customer)"


@query("K5_updates_to_queue", f"WITH {_UPD} SELECT url, claim FROM u WHERE NOT EXISTS (SELECT 1 FROM v_transfers t WHERE t.url = u.url AND t.status IN ('queued', 'downloading', 'seeding')) AND NOT EXISTS (SELECT 1 FROM v_transfers t WHERE t.url = u.url AND t.status IN ('complete', 'seeding') AND (u.claim IS NULL OR t.digest = u.claim))")
def _(spark, d):
    u = table(spark, d, "customer").selectExpr("concat('http://h/', c_custkey, '.zim?x=1') AS url", "CASE WHEN c_custkey % 2 = 0 THEN md5(concat(c_custkey, '1-URGENT')) END AS claim").distinct()
    return C.updates_to_queue(u, view(spark, d, "v_transfers")).select("url", "claim")


@query("K6_detect_drift", "WITH p AS (SELECT id, digest, last_value(CASE WHEN status IN ('complete', 'seeding') THEN digest END IGNORE NULLS) OVER (PARTITION BY url ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM v_transfers) SELECT id, coalesce(lower(digest) <> lower(previous), false) AS drift FROM p WHERE digest IS NOT NULL")
def _(spark, d):
    return G.last_digest(view(spark, d, "v_transfers")).where("digest is not null").select("id", F.coalesce(F.lower("digest") != F.lower("previous"), F.lit(False)).alias("drift"))


@query("K7_verify_claims", "SELECT id, CASE WHEN digest IS NULL OR id % 5 = 0 THEN 'unverified' WHEN id % 7 = 0 THEN 'mismatch' ELSE 'verified' END AS verdict FROM v_transfers")
def _(spark, d):
    t = view(spark, d, "v_transfers")
    return C.verify_claims(t.select("id", F.upper("digest").alias("claim")), t.where("id % 5 <> 0").select("id", F.expr("CASE WHEN id % 7 = 0 THEN md5(digest) ELSE digest END").alias("measured")))


@query("K8_record_integrity", "SELECT t.id, l.hash AS content, coalesce(t.digest, l.name) AS publisher FROM v_transfers t JOIN v_listing l ON l.seq = t.id")
def _(spark, d):
    return C.record_integrity(view(spark, d, "v_transfers"), view(spark, d, "v_listing").select(F.col("seq").alias("id"), "hash", "name"))


@query("K9_skip_unchanged", "SELECT c.name, CASE WHEN s.file_size IS NULL THEN 'keep' WHEN c.index_status = 'ready' AND s.file_size = c.file_size THEN 'skip' ELSE 'index' END AS decision FROM v_catalog c LEFT JOIN v_snapshot s ON c.name = s.name")
def _(spark, d):
    return C.index_or_skip(view(spark, d, "v_catalog"), view(spark, d, "v_snapshot"))
