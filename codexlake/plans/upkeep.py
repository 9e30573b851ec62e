"""Queries over embedding upkeep and the transfer ledger (E, L)."""

from pyspark.sql import functions as F

from codexlake.operators import embedding as E
from codexlake.operators import ledger as G
from codexlake.plans.registry import query
from codexlake.sources.views import table, view

_BACK = "b AS (SELECT a.archive, a.id, row_number() OVER (PARTITION BY a.archive ORDER BY a.id) AS fifo FROM v_articles a JOIN v_archives z ON z.name = a.archive WHERE embed_enabled AND index_status = 'ready' AND NOT EXISTS (SELECT 1 FROM v_vectors v WHERE v.id = a.id))"


def _backlog(spark, d):
    return E.backlog(view(spark, d, "v_articles"), view(spark, d, "v_archives"), view(spark, d, "v_vectors"))


@query("E1_backlog", "SELECT a.archive, a.id, row_number() OVER (PARTITION BY a.archive ORDER BY a.id) AS fifo FROM v_articles a JOIN v_archives z ON z.name = a.archive WHERE embed_enabled AND index_status = 'ready' AND NOT EXISTS (SELECT 1 FROM v_vectors v WHERE v.id = a.id) AND (a.id % 3 <> 0 OR a.id % 20 < 10)")
def _(spark, d):
    # every third article was claimed within the last twenty minutes
    a = view(spark, d, "v_articles").withColumn("embed_at", F.expr("CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(id % 20), 0) END"))
    waiting = E.backlog(a, view(spark, d, "v_archives"), view(spark, d, "v_vectors"), as_of=F.expr("TIMESTAMP '2024-01-01 00:20:00'"))
    return waiting.withColumn("fifo", F.col("fifo").cast("bigint"))


@query("E3_assign_batches", f"WITH {_BACK} SELECT archive, id, (fifo - 1) // 8 AS batch FROM b WHERE fifo <= 100000")
def _(spark, d):
    return E.batches(_backlog(spark, d), 8).select("archive", "id", "batch")


@query("E4_validate_vectors", "SELECT label AS batch, count(*) FILTER (WHERE label <> 3 OR k > 0) = count(*) AND label <> 5 AS accepted FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) GROUP BY label")
def _(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select(F.col("label").alias("batch"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("index"))
    got = e.where("batch <> 3 or index > 0").withColumn("index", F.when(F.col("batch") == 5, F.col("index") + 1).otherwise(F.col("index")))
    return E.check_batches(e, got)


@query("E5_dimension_check", "SELECT len(embedding) AS dimension, count(*) AS n, len(embedding) = 64 AS fits FROM embeddings GROUP BY len(embedding)")
def _(spark, d):
    return E.dimension_check(table(spark, d, "embeddings"), 64)


@query("E6_apply_vectors", "SELECT a.id, CASE WHEN v.id IS NOT NULL THEN v.embedding[1] WHEN a.id % 2 = 0 THEN 7.0 END::DOUBLE AS first, CASE WHEN v.id IS NOT NULL THEN 'm1' WHEN a.id % 2 = 0 THEN 'm0' END AS model, CASE WHEN v.id IS NOT NULL THEN '2024-05-01' WHEN a.id % 2 = 0 THEN '2020-01-01' END AS at FROM v_articles a LEFT JOIN v_vectors v ON v.id = a.id")
def _(spark, d):
    # every other article has a vector of an older model
    old = view(spark, d, "v_articles").withColumns({"embedding": F.expr("CASE WHEN id % 2 = 0 THEN array(7.0F) END"), "model": F.expr("CASE WHEN id % 2 = 0 THEN 'm0' END"), "embed_at": F.expr("CASE WHEN id % 2 = 0 THEN TIMESTAMP '2020-01-01' END")})
    out = E.apply_vectors(old, view(spark, d, "v_vectors"), "m1", F.expr("TIMESTAMP '2024-05-01'"))
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"), "model", F.date_format("embed_at", "yyyy-MM-dd").alias("at"))


@query("E7_drop_poison", "WITH l AS (SELECT branch, max(CASE WHEN ok = 1 THEN seq END) AS last FROM v_outcomes GROUP BY branch), p AS (SELECT o.branch FROM v_outcomes o JOIN l ON l.branch = o.branch WHERE ok = 0 AND (last IS NULL OR seq > last) GROUP BY o.branch HAVING count(*) >= 3) SELECT DISTINCT branch AS id FROM v_outcomes WHERE branch NOT IN (SELECT branch FROM p)")
def _(spark, d):
    o = view(spark, d, "v_outcomes").select(F.col("branch").alias("id"), "seq", "ok")
    return o.select("id").distinct().join(E.poison(o), "id", "left_anti")


@query("E9_embed_articles", "WITH w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(coalesce(content_preview, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM v_articles), c AS (SELECT id, CAST(CAST('0x' || substring(md5(w), 1, 12) AS BIGINT) % 64 AS INT) AS k, count(*) AS c FROM w GROUP BY ALL), n AS (SELECT id, sqrt(CAST(sum(c * c) AS DOUBLE)) AS norm FROM c GROUP BY id) SELECT c.id, k, round(c / norm, 9) AS share FROM c JOIN n ON n.id = c.id")
def _(spark, d):
    # one row for each component that is not zero
    v = E.hashing_vectors(view(spark, d, "v_articles"), "content_preview")
    return v.select("id", F.posexplode("embedding").alias("k", "share")).where("share <> 0").withColumn("share", F.round("share", 9))


@query("L1_transition_allowed", "SELECT a.status AS source, b.status AS target, concat(a.status, '>', b.status) IN ('queued>downloading', 'queued>error', 'queued>cancelled', 'downloading>complete', 'downloading>seeding', 'downloading>error', 'downloading>cancelled', 'downloading>queued', 'error>queued', 'seeding>complete') AS ok FROM (SELECT DISTINCT status FROM v_transfers) a, (SELECT DISTINCT status FROM v_transfers) b")
def _(spark, d):
    s = view(spark, d, "v_transfers").select("status").distinct()
    return s.select(F.col("status").alias("source"), F.explode(F.array(*[F.lit(x) for x in G.TRANSITIONS])).alias("target")).withColumn("ok", G.allowed(F.col("source"), F.col("target")))


@query("L2_apply_transitions", "WITH RECURSIVE c AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, to_) AS n, to_ FROM (SELECT *, ['queued', 'downloading', 'error', 'seeding', 'complete', 'cancelled'][CAST(floor(l_quantity % 6) AS INT) + 1] AS to_ FROM lineitem)), t AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'downloading' WHEN 2 THEN 'complete' WHEN 3 THEN 'seeding' WHEN 4 THEN 'error' ELSE 'cancelled' END AS status FROM orders), r AS (SELECT id, status, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS rejected FROM t UNION ALL SELECT r.id, CASE WHEN ok THEN to_ ELSE r.status END, x.n, applied + CAST(ok AS BIGINT), rejected + CAST(NOT ok AS BIGINT) FROM r JOIN (SELECT c.id, c.n, c.to_ FROM c) x ON x.id = r.id AND x.n = r.n + 1, LATERAL (SELECT concat(r.status, '>', x.to_) IN ('queued>downloading', 'queued>error', 'queued>cancelled', 'downloading>complete', 'downloading>seeding', 'downloading>error', 'downloading>cancelled', 'downloading>queued', 'error>queued', 'seeding>complete') AS ok) o) SELECT id, status, applied, rejected FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM r) WHERE k = 1 AND n > 0")
def _(spark, d):
    t = view(spark, d, "v_transfers")
    names = F.array(*[F.lit(x) for x in G.TRANSITIONS])
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.element_at(names, (F.col("l_quantity") % 6 + 1).cast("int")).alias("to"))
    return G.apply_transitions(t.select("id", "status"), c)


_REQ = "r AS (SELECT c_custkey AS req, concat('t', CAST(c_custkey % 400 AS VARCHAR(20))) AS name, concat('http://h/', CAST(c_custkey % 700 AS VARCHAR(20)), '.zim?x=1') AS url FROM customer)"


@query("L3_admit", f"WITH {_REQ}, f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM v_transfers t WHERE t.status IN ('queued', 'downloading') AND t.url = r.url) AND NOT EXISTS (SELECT 1 FROM v_transfers t WHERE t.status IN ('queued', 'downloading') AND t.name = r.name)), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY req) AS u FROM f), m AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY req) AS m FROM u WHERE u = 1) SELECT req, name, url FROM m WHERE m = 1")
def _(spark, d):
    r = table(spark, d, "customer").selectExpr("c_custkey AS req", "concat('t', c_custkey % 400) AS name", "concat('http://h/', c_custkey % 700, '.zim?x=1') AS url")
    return G.admit(view(spark, d, "v_transfers"), r).select("req", "name", "url")


@query("L4_name_conflicts", "SELECT id FROM v_transfers t WHERE status IN ('queued', 'downloading', 'complete', 'seeding') AND EXISTS (SELECT 1 FROM v_transfers o WHERE o.name = t.name AND o.id <> t.id AND o.status IN ('queued', 'downloading', 'complete', 'seeding'))")
def _(spark, d):
    return G.name_conflicts(view(spark, d, "v_transfers")).select("id")


@query("L4_path_owner", "SELECT id FROM (SELECT id, status, id % 700 AS p FROM v_transfers WHERE id % 5 <> 0) t WHERE status IN ('queued', 'downloading', 'complete', 'seeding') AND EXISTS (SELECT 1 FROM v_transfers o WHERE o.id % 5 <> 0 AND o.id % 700 = t.p AND o.id <> t.id AND o.status IN ('queued', 'downloading', 'complete', 'seeding'))")
def _(spark, d):
    t = view(spark, d, "v_transfers").withColumn("file_path", F.expr("CASE WHEN id % 5 <> 0 THEN concat('/z/', id % 700) END"))
    return G.name_conflicts(t, "file_path").select("id")


@query("L5_requeue_candidates", "WITH n AS (SELECT name, max(id) AS id FROM v_transfers t WHERE status = 'error' AND NOT EXISTS (SELECT 1 FROM v_transfers a WHERE a.name = t.name AND a.status IN ('queued', 'downloading')) GROUP BY name), e AS (SELECT id, error = lag(error) OVER o AND error = lag(error, 2) OVER o AS third FROM v_transfers WHERE error IS NOT NULL WINDOW o AS (PARTITION BY name ORDER BY id)) SELECT t.id FROM v_transfers t JOIN n ON n.id = t.id JOIN e ON e.id = t.id WHERE NOT coalesce(third, false) AND regexp_matches(error, '(?i)connect|timeout|refused|unreachable|connection') AND NOT regexp_matches(error, '(^|[^\\p{L}\\p{N}])(401|403)([^\\p{L}\\p{N}]|$)')")
def _(spark, d):
    t = view(spark, d, "v_transfers")
    return G.requeue(t, G.as_of_last(t)).select("id")


#: The listing's rows that name a ledger id, all of them; and what each row then calls for.
_MATCH = "m AS (SELECT seq AS id, CAST(progress AS DOUBLE) AS progress, state FROM v_listing), x AS (SELECT max(updated_at) + INTERVAL 1 DAY AS as_of FROM v_transfers)"
_DIRECT = "lower(trim(regexp_replace({}, '[?#].*$', ''))) LIKE '%.zim'"
_ACTION = f"CASE WHEN t.status = 'queued' AND m.state IS NOT NULL THEN 'bind' WHEN t.status = 'downloading' AND m.progress >= 0.999 AND m.state IN ('uploading', 'stalledUP', 'pausedUP', 'forcedUP') THEN 'finish' WHEN t.status IN ('downloading', 'seeding') AND m.state IN ('error', 'missingFiles') THEN 'settle' WHEN t.status IN ('downloading', 'seeding') AND m.state IS NOT NULL THEN 'refresh' WHEN t.status = 'downloading' AND NOT {_DIRECT.format('t.url')} AND t.updated_at < as_of - INTERVAL 10 MINUTE THEN 'error' WHEN t.status = 'seeding' AND t.updated_at < as_of - INTERVAL 10 MINUTE THEN 'done' ELSE 'keep' END"


@query("L6_seeding_action", f"WITH {_MATCH} SELECT t.id, CASE WHEN m.state IN ('error', 'missingFiles') THEN 'settle' WHEN m.state IS NOT NULL THEN 'refresh' WHEN t.updated_at < as_of - INTERVAL 10 MINUTE THEN 'done' ELSE 'keep' END AS action FROM v_transfers t LEFT JOIN m ON m.id = t.id, x WHERE t.status = 'seeding'")
def _(spark, d):
    t = view(spark, d, "v_transfers")
    m = view(spark, d, "v_listing").select(F.col("seq").alias("id"), F.col("progress").cast("double"), "state")
    return G.reconcile_actions(t.where("status = 'seeding'"), m, G.as_of_last(t))


_SHOWN = "SELECT seq AS id, CAST(progress AS DOUBLE) AS progress, (seq % 7) / 2.0 AS ratio, CASE WHEN seq % 4 = 0 THEN seq % 5 + 1 ELSE seq % 5 END AS num_seeds, CASE WHEN seq % 3 = 0 THEN 5 ELSE 0 END AS dlspeed, CASE WHEN seq % 11 = 0 THEN 2 ELSE 0 END AS upspeed, seq * 100000 AS remaining FROM v_listing"
_HELD = "SELECT *, CASE WHEN id % 9 = 0 THEN NULL ELSE (id % 100) / 100.0 END AS progress, (id % 7) / 2.0 AS ratio, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 5 END AS num_seeds, 3 AS speed_bps, 4 AS eta_secs, 5 AS up_speed_bps FROM v_transfers"
_CHANGED = f"o AS ({_HELD}), s AS ({_SHOWN}), w AS (SELECT o.*, s.id AS sid, s.progress AS p, s.ratio AS r, s.num_seeds AS ns, dlspeed, upspeed, remaining, coalesce(abs(s.progress - coalesce(o.progress, 0)) >= 0.01 OR s.ratio <> coalesce(o.ratio, 0) OR s.num_seeds <> coalesce(o.num_seeds, 0) OR dlspeed <> 0 OR upspeed <> 0, false) AS wr FROM o LEFT JOIN s ON s.id = o.id)"


def _held_and_shown(spark, d):
    held = view(spark, d, "v_transfers").selectExpr("*", *_HELD[len("SELECT *, ") : -len(" FROM v_transfers")].replace("100.0", "100.0D").replace("2.0", "2.0D").split(", "))
    shown = view(spark, d, "v_listing").selectExpr(*_SHOWN[len("SELECT ") : -len(" FROM v_listing")].replace("2.0", "2.0D").split(", "))
    return held, shown


@query("L7_stats_changed", f"WITH {_CHANGED} SELECT id FROM w WHERE wr")
def _(spark, d):
    held, shown = _held_and_shown(spark, d)
    three = ("progress", "ratio", "num_seeds")
    both = held.select("id", *(F.col(c).alias(f"old_{c}") for c in three)).join(shown.select("id", "dlspeed", "upspeed", *(F.col(c).alias(f"new_{c}") for c in three)), "id")
    return G.stats_changed(both).select("id")


@query("L8_apply_stats", f"WITH {_CHANGED} SELECT id, CASE WHEN wr THEN p ELSE progress END::DOUBLE AS progress, CASE WHEN wr THEN dlspeed * 1024 ELSE speed_bps END::BIGINT AS speed_bps, CASE WHEN NOT wr THEN eta_secs WHEN dlspeed > 0 THEN remaining // (dlspeed * 1024) END::BIGINT AS eta_secs, CASE WHEN wr THEN r ELSE ratio END::DOUBLE AS ratio, CASE WHEN wr THEN upspeed * 1024 ELSE up_speed_bps END::BIGINT AS up_speed_bps, CASE WHEN wr THEN ns ELSE num_seeds END::BIGINT AS num_seeds, CASE WHEN wr OR (sid IS NOT NULL AND updated_at < TIMESTAMP '1995-01-01 00:00:00' - INTERVAL 60 SECOND) THEN TIMESTAMP '1995-01-01 00:00:00' ELSE updated_at END AS updated_at FROM w")
def _(spark, d):
    held, shown = _held_and_shown(spark, d)
    return G.apply_stats(held, shown, F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")).select("id", *G.STATS, "updated_at")


#: Matching as in J9, with names for digests that are not listed; direct downloads take no part in it.
_RECONCILE = (
    f"tl AS (SELECT id, name, url, digest FROM v_transfers WHERE NOT {_DIRECT.format('url')}), li AS (SELECT *, lower(name) AS k, max(seq) OVER (PARTITION BY hash) = seq AS last_h, max(seq) OVER (PARTITION BY lower(name)) = seq AS last_n FROM v_listing), "
    "hit AS (SELECT t.id, t.name, t.url, l.seq, l.hash FROM tl t LEFT JOIN li l ON l.hash = t.digest AND last_h), cand AS (SELECT id, seq, hash, 1 AS bound FROM hit WHERE seq IS NOT NULL UNION ALL SELECT t.id, coalesce(a.seq, b.seq), coalesce(a.hash, b.hash), 0 FROM hit t LEFT JOIN li a ON a.k = lower(t.name) AND a.last_n LEFT JOIN li b ON b.k = lower(t.url) AND b.last_n WHERE t.seq IS NULL AND coalesce(a.seq, b.seq) IS NOT NULL), "
    "met AS (SELECT id, seq, hash FROM cand QUALIFY bound = 1 OR row_number() OVER (PARTITION BY hash ORDER BY id) = 1), m AS (SELECT met.id, met.seq, CAST(progress AS DOUBLE) AS progress, state FROM met JOIN v_listing l ON l.seq = met.seq), x AS (SELECT max(updated_at) + INTERVAL 1 DAY AS as_of FROM v_transfers)"
)


@query("L9_reconcile", f"WITH {_RECONCILE} SELECT t.id, m.seq, {_ACTION} AS action FROM v_transfers t LEFT JOIN m ON m.id = t.id, x UNION ALL SELECT NULL, seq, 'adopt' FROM v_listing l WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.hash = l.hash OR met.seq = l.seq) AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.digest = l.hash)")
def _(spark, d):
    t = view(spark, d, "v_transfers")
    return G.reconcile(t, view(spark, d, "v_listing"), G.as_of_last(t))


@query("L10_interrupted_to_queued", f"SELECT id, CASE WHEN w THEN 'queued' ELSE status END AS status, CASE WHEN NOT w THEN '/z/' || id END AS file_path, CASE WHEN NOT w THEN 'e' || id END AS error FROM (SELECT *, status = 'downloading' AND {_DIRECT.format('url')} AS w FROM v_transfers)")
def _(spark, d):
    t = view(spark, d, "v_transfers").withColumns({"file_path": F.concat(F.lit("/z/"), "id"), "error": F.concat(F.lit("e"), "id")})
    return G.requeue_interrupted(t).select("id", "status", "file_path", "error")


@query("L11_drain_cancelled", "SELECT id, CASE WHEN status = 'cancelled' THEN NULL ELSE digest END AS digest FROM v_transfers")
def _(spark, d):
    return G.drain_cancelled(view(spark, d, "v_transfers")).select("id", "digest")
