"""Queries over the streaming jobs (R), each checked against the batch form of its rule."""

from pyspark.sql import functions as F

from codexlake.cluster import scratch
from codexlake.plans.registry import query
from codexlake.sources.versions import versions
from codexlake.sources.views import table, view
from codexlake.streaming import jobs as S

#: Pages of an arriving file, if there are more than all cores take at once.
FILE_PAGES = 20_000


@query("R1_stream_ingest", "SELECT url AS path, max(page_id) AS page_id FROM pages GROUP BY url")
def _(spark, d):
    # the pages arrive in three micro-batches, each of so many files that all cores parse; urls that come again take the later page
    folder, pages = scratch(spark, "ingest"), table(spark, d, "pages")
    files = 3 * max(spark.sparkContext.defaultParallelism, pages.count() // (3 * FILE_PAGES))
    pages.repartition(files, "page_id").write.parquet(f"{folder}/in")
    there = len(spark.read.schema(pages.schema).parquet(f"{folder}/in").inputFiles())
    S.ingest_pages(S.pages(spark, f"{folder}/in", -(-there // 3)), f"{folder}/articles")
    return S.read_latest(spark, f"{folder}/articles").select("path", "page_id")


#: Failures of a branch counted from the first within a week; the second locks, a success clears. One row after the other.
_BURST = "WITH RECURSIVE e AS (SELECT user_id AS branch, event_id AS seq, epoch_us(ts) AS t, event_type NOT IN ('error', 'view') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT branch, seq, n, CAST(CASE WHEN ok THEN 0 ELSE 1 END AS BIGINT) AS c, CASE WHEN ok THEN 0 ELSE t END AS f FROM e WHERE n = 1 UNION ALL SELECT e.branch, e.seq, e.n, CAST(CASE WHEN ok THEN 0 WHEN c > 0 AND t - f <= 604800000000 THEN c + 1 ELSE 1 END AS BIGINT), CASE WHEN ok THEN 0 WHEN c > 0 AND t - f <= 604800000000 THEN f ELSE t END FROM r JOIN e ON e.branch = r.branch AND e.n = r.n + 1) SELECT branch, seq FROM r WHERE c = 2"


@query("R2_stream_failures", _BURST)
def _(spark, d):
    return S.run_available(S.failure_bursts(S.outcomes(S.events(spark, d)), 2, 60 * 24 * 7))


_RUN = "WITH g AS (SELECT branch, seq, ok, sum(ok) OVER (PARTITION BY branch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM v_outcomes) SELECT branch, seq, CAST(sum(1 - ok) OVER (PARTITION BY branch, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures, sum(1 - ok) OVER (PARTITION BY branch, g ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 3 AS degraded FROM g"


@query("R3_stream_degradation", _RUN)
def _(spark, d):
    return S.run_available(S.degradation(S.outcomes(S.events(spark, d))))


#: Every third type of event reads as an access error; a day without an error starts a key anew.
_MESSAGE = "CASE WHEN event_type LIKE '%c%' THEN concat(event_type, ' 403') ELSE event_type END"


@query("R4_stream_retry_guard", f"WITH m AS (SELECT user_id AS key, event_id AS seq, ts, {_MESSAGE} AS message FROM events), c AS (SELECT *, CASE WHEN lag(message) OVER o IS DISTINCT FROM message OR epoch_us(ts) - lag(epoch_us(ts)) OVER o > 86400000000 THEN 1 ELSE 0 END AS c FROM m WINDOW o AS (PARTITION BY key ORDER BY seq)), g AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM c), s AS (SELECT key, seq, CASE WHEN message LIKE '% 403' THEN 0 ELSE row_number() OVER (PARTITION BY key, g ORDER BY seq) END AS streak FROM g) SELECT key, seq, streak, streak >= 3 AS give_up FROM s")
def _(spark, d):
    e = S.events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.expr(_MESSAGE).alias("message"))
    return S.run_available(S.retry_guard(e, idle_minutes=24 * 60))


_DELTA = "WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT key, seq, n, v AS last, true AS sent FROM e WHERE n = 1 UNION ALL SELECT e.key, e.seq, e.n, CASE WHEN abs(e.v - r.last) >= 10.0 THEN e.v ELSE r.last END, abs(e.v - r.last) >= 10.0 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1) SELECT key, seq, last AS value FROM r WHERE sent"


@query("R5_stream_stats_delta", _DELTA)
def _(spark, d):
    return S.run_available(S.stats_delta(S.events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value"), 10.0))


@query("R6_stream_drift", "SELECT user_id AS key, event_id AS seq, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type, false) AS drift FROM events")
def _(spark, d):
    return S.run_available(S.drift(S.events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("digest"))))


@query("R7_stream_missing", "SELECT user_id AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY user_id HAVING epoch_ms(max(ts)) + 600000 < (SELECT epoch_ms(max(ts)) - 60000 FROM events)")
def _(spark, d):
    gone = S.run_available(S.missing(S.events(spark, d).select(F.col("user_id").alias("key"), "ts")))
    return gone.select("key", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("R8_stream_wait_stats", "WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS site, CAST(trunc(value) AS BIGINT) AS v FROM events) SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, site, count(*) AS n, max(v) AS most, coalesce(sum(v) // count(*), 0)::BIGINT AS mean FROM e WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY GROUPING SETS ((w, site), (w))")
def _(spark, d):
    return S.run_available(S.window_stats(S.events(spark, d))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("R9_stream_dedup_events", "SELECT event_id FROM events")
def _(spark, d):
    # every event comes twice
    return S.run_available(S.distinct_events(S.events(spark, d).unionByName(S.events(spark, d))).select("event_id"))


@query("R9_stream_snapshots", "SELECT name, file_size, CAST(2 AS BIGINT) AS versions FROM v_snapshot")
def _(spark, d):
    # three snapshots: the catalog, the same in another order, and the one that followed
    folder = scratch(spark, "snapshots")
    for k, (name, by) in enumerate((("v_catalog", "name"), ("v_catalog", "file_size"), ("v_snapshot", "name"))):
        view(spark, d, name).select("name", "file_size").repartition(1 + k % 2, by).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        S.keep_snapshots(spark.readStream.schema("name string, file_size bigint").parquet(f"{folder}/in"), f"{folder}/out")
    return S.read_latest(spark, f"{folder}/out", "name string, file_size bigint").withColumn("versions", F.lit(len(versions(spark, f"{folder}/out"))).cast("bigint"))
