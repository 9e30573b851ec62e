"""Structured Streaming jobs over tables that arrive as files.

Each job is a function of a streaming DataFrame; `run_available` drives one through all files that are
there into a Parquet sink, with its checkpoint beside it, and may be called again when more arrive.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codexlake.cluster import scratch, settle, ship
from codexlake.functions.text import access_error
from codexlake.sources.reader import pages_to_articles
from codexlake.sources.versions import latest, read_version, versions, write_snapshot, write_version

#: Where Spark's setting names what holds the state of streams, and the one that lies on disk.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time as a UTC timestamp."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path.replace("events.parquet", "events.parque[t]")).withColumn("ts", F.col("ts").cast("timestamp"))


def outcomes(stream: DataFrame) -> DataFrame:
    return stream.select(F.col("user_id").alias("branch"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type").isin("error", "view"), 0).otherwise(1).alias("ok"))


def run_available(job: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a job over all that is there and return what its sink holds. State lies in RocksDB, which timers need."""
    spark = job.sparkSession
    ship(spark)
    folder = folder or scratch(spark, "stream")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = job.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(job.schema).parquet(f"{folder}/out")


def window_stats(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes", site: str = "event_type", value: str = "value") -> DataFrame:
    """(start, site, n, most, mean): rows, greatest and whole mean value per window and site, when the watermark has passed the window.

    A null site is the total of the window: each row counts for its site and once more for that, as streams have no rollup.
    """
    both = stream.withWatermark("ts", late).select("ts", F.explode(F.array(F.col(site), F.lit(None).cast("string"))).alias("site"), F.col(value).cast("bigint").alias("v"))
    w = both.groupBy(F.window("ts", every), "site").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"), F.sum("v").alias("total"))
    return w.select(F.col("window.start").alias("start"), "site", "n", "most", F.call_function("div", F.coalesce("total", F.lit(0)), F.col("n")).alias("mean"))


def distinct_events(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _per_key(stream: DataFrame, key: str, out: str, state: str, step: Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]) -> DataFrame:
    """A stateful job: step(key, rows in order, state) gives rows and the next state."""

    def run(k: tuple, parts, held: GroupState):
        rows = pd.concat(list(parts)).sort_values("seq")
        found, after = step(k, rows, held.get if held.exists else None)
        held.update(after)
        yield found

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


class _Bursts(StatefulProcessor):
    """Failures of a key counted from the first within a window; the state goes with a success, or by a timer when the window has passed."""

    def __init__(self, limit: int, minutes: int):
        self.limit, self.window = limit, minutes * 60 * 10**6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("burst", "count bigint, first bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        data = pd.concat(list(rows)).sort_values("seq")
        count, first = self.state.get() if self.state.exists() else (0, 0)
        hits = []
        for seq, ts, ok in zip(data["seq"], data["ts"].astype("datetime64[us]").astype("int64"), data["ok"], strict=True):
            if ok:
                count, first = 0, 0
            elif count and ts - first <= self.window:
                count += 1
                if count == self.limit:
                    hits.append(seq)
            else:
                count, first = 1, int(ts)
        held = (count, first) if count else None
        _hold(self.handle, self.state, held, (first + self.window) // 1000 + 1)
        yield pd.DataFrame({"branch": [key[0]] * len(hits), "seq": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _hold(handle, state, value: tuple | None, until_ms: int) -> None:
    """Keep a state until a time of the events, or let it go; a key has one timer at most."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    if value is None:
        state.clear()
    else:
        state.update(value)
        handle.registerTimer(until_ms)


def failure_bursts(stream: DataFrame, limit: int = 5, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """(branch, seq): the failures that lock a branch: the fifth within 15 minutes of the first; a success clears, a lock ends 15 minutes after its first failure.

    What is held of a branch goes when the watermark passes the end of its window, so idle branches cost nothing.
    """
    return stream.withWatermark("ts", late).groupBy("branch").transformWithStateInPandas(_Bursts(limit, minutes), "branch bigint, seq bigint", "append", "EventTime")


def degradation(stream: DataFrame, limit: int = 3) -> DataFrame:
    """(branch, seq, failures, degraded) at each row: failures since the last success."""

    def step(key, rows, state):
        n = state[0] if state else 0
        counts = []
        for ok in rows["ok"]:
            n = 0 if ok else n + 1
            counts.append(n)
        out = pd.DataFrame({"branch": rows["branch"].to_numpy(), "seq": rows["seq"].to_numpy(), "failures": counts})
        return out.assign(degraded=out["failures"] >= limit), (n,)

    return _per_key(stream, "branch", "branch bigint, seq bigint, failures bigint, degraded boolean", "failures bigint", step)


class _Guard(StatefulProcessor):
    """How often in a row a key has had its last message; forgotten after an idle time, by a timer."""

    def __init__(self, give_up: int, idle_minutes: int):
        self.give_up, self.idle = give_up, idle_minutes * 60 * 10**6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("streak", "n bigint, message string, seen bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        data = pd.concat(list(rows)).sort_values("seq")
        n, last, seen = self.state.get() if self.state.exists() else (0, None, 0)
        streaks = []
        for message, exempt, ts in zip(data["message"], data["exempt"], data["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            # by the rows' own times, so that the answer does not depend on when the timer runs
            n = n + 1 if message == last and ts - seen <= self.idle else 1
            last, seen = message, int(ts)
            streaks.append(0 if exempt else n)
        _hold(self.handle, self.state, (n, last, seen), (seen + self.idle) // 1000 + 1)
        out = pd.DataFrame({"key": data["key"].to_numpy(), "seq": data["seq"].to_numpy(), "streak": streaks})
        yield out.assign(give_up=out["streak"] >= self.give_up)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def retry_guard(stream: DataFrame, give_up: int = 3, idle_minutes: int = 100, late: str = "10 minutes") -> DataFrame:
    """(key, seq, streak, give_up) at each error (key, seq, ts, message): how often in a row this message came.

    Access errors (401, 403) have no streak and are never given up; others are at the third. A key without an error for
    `idle_minutes` starts anew, and what is held of it goes when the watermark has passed that time.
    """
    told = stream.select("key", "seq", "ts", "message", access_error("message").alias("exempt")).withWatermark("ts", late)
    return told.groupBy("key").transformWithStateInPandas(_Guard(give_up, idle_minutes), "key bigint, seq bigint, streak bigint, give_up boolean", "append", "EventTime")


def stats_delta(stream: DataFrame, least: float = 1.0) -> DataFrame:
    """(key, seq, value): values (key, seq, value) that differ by `least` and more from the last that was let through."""

    def step(key, rows, state):
        last = state[0] if state else None
        out = []
        for seq, v in zip(rows["seq"], rows["value"], strict=True):
            if last is None or abs(v - last) >= least:
                last = float(v)
                out.append((key[0], seq, last))
        return pd.DataFrame(out, columns=["key", "seq", "value"]), (last if last is not None else 0.0,)

    return _per_key(stream, "key", "key bigint, seq bigint, value double", "last double", step)


def drift(stream: DataFrame) -> DataFrame:
    """(key, seq, drift) at each observation (key, seq, digest): whether the digest differs from the one before."""

    def step(key, rows, state):
        last = state[0] if state else None
        out = []
        for seq, d in zip(rows["seq"], rows["digest"], strict=True):
            out.append((key[0], seq, last is not None and d is not None and d.lower() != last.lower()))
            last = d if d is not None else last
        return pd.DataFrame(out, columns=["key", "seq", "drift"]), (last,)

    return _per_key(stream, "key", "key bigint, seq bigint, drift boolean", "last string", step)


def missing(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """(key, last_seen) of keys (key, ts) unseen for more than some minutes of event time."""

    def run(k: tuple, parts, held: GroupState):
        if held.hasTimedOut:
            seen = held.get[0]
            held.remove()
            yield pd.DataFrame({"key": [k[0]], "last_seen": [pd.Timestamp(seen, unit="us")]})
            return
        seen = max(int(p["ts"].astype("datetime64[us]").astype("int64").max()) for p in parts)
        seen = max(seen, held.get[0] if held.exists else seen)
        held.update((seen,))
        held.setTimeoutTimestamp(max(seen // 1000, held.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "last_seen": pd.Series([], dtype="datetime64[us]")})

    return stream.withWatermark("ts", "1 minute").groupBy("key").applyInPandasWithState(run, "key bigint, last_seen timestamp", "seen bigint", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_latest(stream: DataFrame, path: str, keys: list[str], order: str, buckets: int = 16, keep: int = 2) -> None:
    """Keep the latest row per key at a path, in buckets by the hash of the key.

    A micro-batch rewrites only the buckets that its keys fall into, as one version; one that runs again writes its own
    version again. The number of buckets stays what it was when the table was begun. Versions older than the last
    `keep` are removed. Read the result with `read_latest`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, names = batch.sparkSession, batch.columns
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")
        # the batch is used twice, and what made it may be dear
        fresh = settle(latest(batch, keys, order).withColumn("part", bucket))
        touched = {r.part for r in fresh.select("part").distinct().collect()}
        if not touched:
            return
        before = [v for v in versions(spark, path) if v < number]
        old = read_version(spark, path, batch.schema, before[-1], touched) if before else batch.limit(0)
        both = latest(fresh.select(*names).unionByName(old.select(*names)), keys, order).withColumn("part", bucket)
        write_version(both.repartition("part"), path, number, touched, keep)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The newest whole version that `upsert_latest` left at a path; with a schema, no version at all gives no rows."""
    return read_version(spark, path, schema)


def pages(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Page files (page_id, url, html) of a folder as a stream, new files as they arrive."""
    reader = spark.readStream.schema("page_id bigint, url string, html string")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def ingest_pages(stream: DataFrame, path: str, buckets: int = 16) -> None:
    """Turn arriving pages into articles and keep the latest of each path, by page_id; see `upsert_latest`."""
    upsert_latest(pages_to_articles(stream), path, ["path"], "page_id", buckets)


def keep_snapshots(stream: DataFrame, path: str) -> None:
    """Each micro-batch is a whole snapshot: it becomes the next version at a path, and one equal to the last does nothing; see `write_snapshot`."""
    stream.writeStream.foreachBatch(lambda batch, number: write_snapshot(batch, path, number)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
