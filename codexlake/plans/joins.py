"""Queries over sources, joins, aggregates and windows (S, J, A, W)."""

from pyspark.sql import functions as F

from codexlake.cluster import scratch
from codexlake.operators import ledger as G
from codexlake.operators import library as B
from codexlake.operators.catalog import download_link
from codexlake.operators.lookup import fetch_by_key
from codexlake.plans.registry import query
from codexlake.sources import reader
from codexlake.sources.views import table, view


@query("S1_read_pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE NOT contains(url, 'page=')")
def _(spark, d):
    # pages beyond the first of a listing count as another type, so that the filter has something to leave out
    kind = F.when(F.col("url").contains("page="), "application/x-listing").otherwise("TEXT/html; charset=utf-8")
    return reader.read_pages(spark, f"{d}/pages.parquet", kind).select("page_id", "url", F.length("html").cast("bigint").alias("n"))


@query("S2_pages_to_articles")
def _(spark, d):
    return reader.pages_to_articles(table(spark, d, "pages"))


@query("C1_strip_html")
def _(spark, d):
    return reader.with_text(table(spark, d, "pages")).select("page_id", "title", "text")


@query("C15_chunk_text")
def _(spark, d):
    return reader.chunks(table(spark, d, "documents"), 1000, 200)


@query("S3_read_snapshot", "SELECT 'src=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, count(DISTINCT source) AS archives FROM documents WHERE text IS NOT NULL GROUP BY source")
def _(spark, d):
    # one file for each source, written by Spark under the suffix of an archive and listed without being read
    path = scratch(spark, "snapshot")
    rows = table(spark, d, "documents").where("text is not null").select("text", F.col("source").alias("src"))
    rows.repartition("src").write.partitionBy("src").option("lineSep", "\n").text(path)
    files = reader.read_snapshot(spark, f"{path}/*", "*.txt").select(F.regexp_extract("path", r"(src=[^/]*)/[^/]+$", 1).alias("folder"), "size")
    return files.groupBy("folder").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("archives"))


@query("S4_read_feed", "SELECT concat('urn:', feed_pos) AS id, href, updated FROM v_feed")
def _(spark, d):
    # the feed is written as XML and read back
    path = scratch(spark, "feed")
    links = F.array(F.struct(F.lit("http://opds-spec.org/acquisition").alias("_rel"), F.col("href").alias("_href"), F.lit("application/zim").alias("_type")))
    entries = view(spark, d, "v_feed").select(F.concat(F.lit("urn:"), "feed_pos").alias("id"), F.lit("t").alias("title"), "updated", links.alias("link"))
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return reader.read_feed(spark, path).select("id", download_link(F.col("links")).alias("href"), "updated")


@query("S5_write_articles", "SELECT id, archive, title FROM v_articles")
def _(spark, d):
    path = scratch(spark, "articles")
    rows = view(spark, d, "v_articles").select("id", "archive", "title")
    reader.write_articles(rows, path)
    # a second run over some archives replaces these only
    reader.write_articles(rows.where("archive <= 'src3'"), path)
    return spark.read.schema("id bigint, title string, archive string").parquet(path).select("id", "archive", "title")


@query("S6_fetch_by_key", "SELECT a.id, a.title FROM v_articles a JOIN v_entity_links l ON a.path = l.path AND a.archive_id = l.archive_id WHERE l.qid = 7")
def _(spark, d):
    a, l = view(spark, d, "v_articles"), view(spark, d, "v_entity_links").where("qid = 7")
    names = view(spark, d, "v_archives").select(F.col("id").alias("archive_id"), F.col("name").alias("archive"))
    return fetch_by_key(a, l.join(names, "archive_id").select("archive", "path")).select("id", "title")


@query("S7_list_archives", "SELECT id, name, language, indexed_entries, index_status FROM v_archives")
def _(spark, d):
    return B.list_archives(view(spark, d, "v_archives"))


@query("S8_redact", "SELECT id, '[redacted]' AS url, CASE WHEN error IS NOT NULL THEN '[redacted]' END AS error, status FROM v_transfers")
def _(spark, d):
    return reader.redact(view(spark, d, "v_transfers"), ["url", "error"], authorised=False).select("id", "url", "error", "status")


@query("J1_articles_archives", "SELECT a.id, z.name, z.indexed_entries FROM v_articles a JOIN v_archives z ON a.archive_id = z.id")
def _(spark, d):
    return B.with_archive(view(spark, d, "v_articles"), view(spark, d, "v_archives"), "name", "indexed_entries").select("id", "name", "indexed_entries")


@query("J3_cross_language", "SELECT l.path, concat('Q', l.qid) AS qid, z.name AS archive, o.path AS other_path, a.title FROM v_entity_links l JOIN v_entity_links o ON l.qid = o.qid AND l.archive_id <> o.archive_id JOIN v_archives z ON z.id = o.archive_id LEFT JOIN v_articles a ON a.archive_id = o.archive_id AND a.path = o.path")
def _(spark, d):
    return B.cross_language(view(spark, d, "v_entity_links"), view(spark, d, "v_archives"), view(spark, d, "v_articles"))


@query("J4_embeddable_archives", "SELECT name FROM v_archives z WHERE embed_enabled AND index_status = 'ready' AND EXISTS (SELECT 1 FROM v_articles a WHERE a.archive_id = z.id AND NOT EXISTS (SELECT 1 FROM v_vectors v WHERE v.id = a.id))")
def _(spark, d):
    return B.embeddable_archives(view(spark, d, "v_archives"), view(spark, d, "v_articles"), view(spark, d, "v_vectors"))


@query("J5_orphan_links", "SELECT l.path FROM v_entity_links l WHERE NOT EXISTS (SELECT 1 FROM v_articles a WHERE a.path = l.path AND a.id % 3 = 0)")
def _(spark, d):
    return B.without_match(view(spark, d, "v_entity_links"), view(spark, d, "v_articles").where("id % 3 = 0"), "path", "path").select("path")


@query("J6_adopt_missing", "SELECT seq, name FROM v_listing l WHERE NOT EXISTS (SELECT 1 FROM v_transfers t WHERE t.digest = l.hash)")
def _(spark, d):
    return B.without_match(view(spark, d, "v_listing"), view(spark, d, "v_transfers"), "hash", "digest").select("seq", "name")


@query("J7_collection_members", "SELECT r_regionkey AS id, CASE r_regionkey WHEN 4 THEN '' ELSE (SELECT string_agg(name, ',' ORDER BY p) FROM (SELECT unnest([CAST(r_regionkey * 2 + 2 AS INT), 99999, CAST(r_regionkey + 1 AS INT)]) AS i, unnest([0, 1, 2]) AS p) x JOIN v_archives z ON z.id = x.i) END AS names FROM region")
def _(spark, d):
    sets = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.expr("CASE WHEN r_regionkey = 4 THEN array() ELSE array(int(r_regionkey * 2 + 2), 99999, int(r_regionkey + 1)) END").alias("ids"))
    return B.collection_members(sets, view(spark, d, "v_archives"))


@query("J8_names_to_ids", "SELECT s.name, z.id, z.id IS NULL AS unknown FROM (SELECT concat('src', c_custkey) AS name FROM customer) s LEFT JOIN v_archives z ON z.name = s.name")
def _(spark, d):
    return B.names_to_ids(table(spark, d, "customer").select(F.concat(F.lit("src"), "c_custkey").alias("name")), view(spark, d, "v_archives"))


#: One candidate for each ledger row; the first of those that reach an entry has it, and rows with a digest always do. Every third digest is blanked, so that hashes and names compete.
_MATCHED = "tl AS (SELECT id, name, url, CASE WHEN id % 3 <> 0 THEN digest END AS digest FROM v_transfers), li AS (SELECT seq, hash, lower(name) AS k, max(seq) OVER (PARTITION BY hash) = seq AS last_h, max(seq) OVER (PARTITION BY lower(name)) = seq AS last_n FROM v_listing), cand AS (SELECT t.id, l.seq, l.hash, 1 AS bound FROM tl t JOIN li l ON l.hash = t.digest AND last_h UNION ALL SELECT t.id, coalesce(a.seq, b.seq), coalesce(a.hash, b.hash), 0 FROM tl t LEFT JOIN li a ON a.k = lower(t.name) AND a.last_n LEFT JOIN li b ON b.k = lower(t.url) AND b.last_n WHERE t.digest IS NULL AND coalesce(a.seq, b.seq) IS NOT NULL)"


@query("J9_match_listing", f"WITH {_MATCHED} SELECT id, seq FROM cand QUALIFY bound = 1 OR row_number() OVER (PARTITION BY hash ORDER BY id) = 1")
def _(spark, d):
    ledger = view(spark, d, "v_transfers").withColumn("digest", F.expr("CASE WHEN id % 3 <> 0 THEN digest END"))
    return G.match_listing(ledger, view(spark, d, "v_listing"))


@query("J10_update_by_id", "SELECT t.id, coalesce(l.progress, 0.0) AS progress, coalesce(l.state, 'unknown') AS state FROM v_transfers t LEFT JOIN v_listing l ON l.seq = t.id")
def _(spark, d):
    return G.apply_live(view(spark, d, "v_transfers"), view(spark, d, "v_listing").select(F.col("seq").alias("id"), "progress", "state"))


@query("A1_library_summary", "SELECT count(*) AS archives, CAST(sum(indexed_entries) AS BIGINT) AS entries FROM v_archives")
def _(spark, d):
    return B.library_summary(view(spark, d, "v_archives"))


@query("A2_id_bounds", "SELECT archive, min(id) AS lo, max(id) AS hi FROM v_articles GROUP BY archive")
def _(spark, d):
    return B.id_bounds(view(spark, d, "v_articles"))


@query("A3_embedded_count", "SELECT archive, count(*) AS n, count(v.id) AS embedded FROM v_articles a LEFT JOIN v_vectors v ON v.id = a.id GROUP BY archive")
def _(spark, d):
    return B.embedded_count(view(spark, d, "v_articles"), view(spark, d, "v_vectors"))


@query("A4_flag_presence", "SELECT label, CASE WHEN count(*) FILTER (WHERE vec_id % 4 = 0) > 0 THEN 'present' WHEN count(*) FILTER (WHERE vec_id % 2 = 0) > 0 THEN 'present_invalid' ELSE 'absent' END AS flag FROM embeddings GROUP BY label")
def _(spark, d):
    return B.flag_presence(table(spark, d, "embeddings"), "label", F.expr("vec_id % 4 = 0"), F.expr("vec_id % 2 = 0"))


@query("A5_integrity_report", "SELECT name, count(digest) AS with_digest, count(*) FILTER (WHERE status = 'error') AS drifted FROM v_transfers GROUP BY ROLLUP (name) HAVING count(digest) > 0 OR count(*) FILTER (WHERE status = 'error') > 0")
def _(spark, d):
    return B.integrity_report(view(spark, d, "v_transfers"))


@query("A6_wait_stats", "SELECT event_type AS site, count(*) AS n, max(CAST(value AS BIGINT)) AS most, coalesce(sum(CAST(value AS BIGINT)) // count(*), 0)::BIGINT AS mean FROM events GROUP BY ROLLUP (event_type)")
def _(spark, d):
    # DuckDB rounds half away when it casts, Spark cuts off: round first
    return B.wait_stats(table(spark, d, "events").withColumn("value", F.rint("value")), "event_type", "value")


@query("A8_progress", "SELECT archive, count(*) FILTER (WHERE id % 3 = 0) * 1.0::DOUBLE / count(*) AS progress FROM v_articles GROUP BY archive")
def _(spark, d):
    return B.progress(view(spark, d, "v_articles"), "archive", F.expr("id % 3 = 0"))


@query("A9_duplicate_active", "SELECT name, count(*) AS n FROM v_transfers WHERE status IN ('queued', 'downloading') GROUP BY name HAVING count(*) > 1")
def _(spark, d):
    return G.duplicate_active(view(spark, d, "v_transfers"))


_PREV = "last_value(CASE WHEN status IN ('complete', 'seeding') THEN digest END IGNORE NULLS) OVER (PARTITION BY url ORDER BY updated_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("W1_latest_digest", f"SELECT id, {_PREV} AS previous FROM v_transfers")
def _(spark, d):
    return G.last_digest(view(spark, d, "v_transfers")).select("id", "previous")


@query("W2_newest_duplicate", "SELECT name, max(id) AS id FROM v_transfers t WHERE status = 'error' AND NOT EXISTS (SELECT 1 FROM v_transfers a WHERE a.name = t.name AND a.status IN ('queued', 'downloading')) GROUP BY name")
def _(spark, d):
    return G.newest_duplicate(view(spark, d, "v_transfers")).select("name", "id")


@query("W3_failure_streak", "WITH l AS (SELECT branch, max(CASE WHEN ok = 1 THEN seq END) AS last FROM v_outcomes GROUP BY branch) SELECT l.branch, count(o.seq) AS failures, count(o.seq) >= 3 AS degraded FROM l LEFT JOIN v_outcomes o ON o.branch = l.branch AND o.ok = 0 AND (l.last IS NULL OR o.seq > l.last) GROUP BY l.branch")
def _(spark, d):
    return G.failure_streak(view(spark, d, "v_outcomes"))


@query("W4_error_streak", "WITH e AS (SELECT name AS key, id AS seq, error AS message FROM v_transfers WHERE error IS NOT NULL), c AS (SELECT *, CASE WHEN coalesce(lag(message) OVER (PARTITION BY key ORDER BY seq), '') <> message THEN 1 ELSE 0 END AS c FROM e), g AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM c), s AS (SELECT key, seq, CASE WHEN regexp_matches(message, '(^|[^\\p{L}\\p{N}])(401|403)([^\\p{L}\\p{N}]|$)') THEN 0 ELSE row_number() OVER (PARTITION BY key, g ORDER BY seq) END AS streak FROM g) SELECT key, seq, streak, streak >= 3 AS give_up FROM s")
def _(spark, d):
    e = view(spark, d, "v_transfers").where("error is not null").select(F.col("name").alias("key"), F.col("id").alias("seq"), F.col("error").alias("message"))
    return G.error_streak(e)
