"""The transfer ledger: states, guarded changes, retries and matching with a listing. Times are parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.functions.text import COMPLETE_STATES, FATAL_STATES, access_error, eta_seconds, is_direct, kib_to_bytes, retryable_error

#: Which states follow which.
TRANSITIONS = {
    "queued": ("downloading", "error", "cancelled"), "downloading": ("complete", "seeding", "error", "cancelled", "queued"),
    "error": ("queued",), "seeding": ("complete",), "complete": (), "cancelled": (),
}
ACTIVE, LIVE, SETTLED = ("queued", "downloading"), ("queued", "downloading", "complete", "seeding"), ("complete", "seeding")


def as_of_last(ledger: DataFrame):
    """A day after the last change, as a one-row frame."""
    return ledger.agg((F.max("updated_at") + F.expr("INTERVAL 1 DAY")).alias("as_of"))


def stale(ledger: DataFrame, as_of: DataFrame, statuses: list[str], minutes: int = 10) -> DataFrame:
    return ledger.where(F.col("status").isin(statuses)).join(F.broadcast(as_of)).where(F.col("updated_at") < F.col("as_of") - F.expr(f"INTERVAL {minutes} MINUTE")).drop("as_of")


def allowed(source, target):
    """Whether one state may follow another."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[source], target), F.lit(False))


def apply_transitions(ledger: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, status, applied, rejected): commands (id, seq, to) in order; each applies only where the state then allows it."""
    steps = commands.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "to"))).alias("steps"))
    start = F.struct(F.col("status").alias("status"), F.lit(0).cast("bigint").alias("applied"), F.lit(0).cast("bigint").alias("rejected"))

    def step(s, c):
        ok = allowed(s["status"], c["to"])
        return F.struct(F.when(ok, c["to"]).otherwise(s["status"]).alias("status"), (s["applied"] + ok.cast("bigint")).alias("applied"), (s["rejected"] + (~ok).cast("bigint")).alias("rejected"))

    return ledger.join(steps, "id").select("id", F.aggregate("steps", start, step).alias("r")).select("id", "r.status", "r.applied", "r.rejected")


def admit(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (req, name, url) whose url and name have no active row; of several, the first of a url and of a name."""
    active = ledger.where(F.col("status").isin(*ACTIVE))
    free = requests.join(active.select("url").distinct(), "url", "left_anti").join(active.select("name").distinct(), "name", "left_anti")
    first = free.withColumn("u", F.row_number().over(Window.partitionBy("url").orderBy("req"))).where("u = 1")
    return first.withColumn("m", F.row_number().over(Window.partitionBy("name").orderBy("req"))).where("m = 1").drop("u", "m")


def name_conflicts(ledger: DataFrame, column: str = "name") -> DataFrame:
    """Live rows whose name, or another column such as the file's path, another live row has too. Nulls conflict with nothing."""
    live = ledger.where(F.col("status").isin(*LIVE))
    twice = live.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return live.join(twice, column, "left_semi")


def newest_duplicate(ledger: DataFrame) -> DataFrame:
    """Of failed rows, the newest per name, where no active row has the name."""
    active = ledger.where(F.col("status").isin(*ACTIVE)).select("name")
    failed = ledger.where("status = 'error'").join(active, "name", "left_anti")
    return failed.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("id")))).where("r = 1").drop("r")


def error_streak(errors: DataFrame) -> DataFrame:
    """(key, seq, streak, give_up): how many times in a row a key has had this message; access errors never count."""
    w = Window.partitionBy("key").orderBy("seq")
    changed = (F.coalesce(F.lag("message").over(w), F.lit("")) != F.col("message")).cast("int")
    island = errors.withColumn("c", changed).withColumn("g", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("key", "g").orderBy("seq"))
    streak = F.when(access_error("message"), 0).otherwise(run).cast("bigint")
    return island.select("key", "seq", streak.alias("streak"), (streak >= 3).alias("give_up"))


def failure_streak(outcomes: DataFrame) -> DataFrame:
    """(branch, failures, degraded): failures since the last success; three make a branch degraded."""
    last = outcomes.groupBy("branch").agg(F.max(F.when(F.col("ok") == 1, F.col("seq"))).alias("last"))
    since = outcomes.join(last, "branch").where("ok = 0 and (last is null or seq > last)").groupBy("branch").agg(F.count(F.lit(1)).alias("failures"))
    out = last.select("branch").join(since, "branch", "left").select("branch", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))
    return out.withColumn("degraded", F.col("failures") >= 3)


def last_digest(ledger: DataFrame) -> DataFrame:
    """(id, previous): for each row, the digest of the latest other settled row of its url before it."""
    w = Window.partitionBy("url").orderBy("updated_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("status").isin(*SETTLED), F.col("digest"))
    return ledger.withColumn("previous", F.last(seen, ignorenulls=True).over(w))


def listing_candidates(ledger: DataFrame, listing: DataFrame, category: str = "") -> DataFrame:
    """(id, seq): listing rows that may be what a ledger row has just added: the same name, upper and lower case alike, and the category that additions get.

    A row without a category fits only where additions get none. A listing without a column `category` has none.
    """
    given = F.col("category") if "category" in listing.columns else F.lit(None).cast("string")
    fits = F.when(given.isNull(), F.lit(category == "")).otherwise(F.lower(given) == category.lower())
    named = listing.where(fits).select("seq", F.lower("name").alias("_name"))
    return ledger.select("id", F.lower("name").alias("_name")).join(named, "_name").select("id", "seq")


def match_listing(ledger: DataFrame, listing: DataFrame, by_name_too: bool = False) -> DataFrame:
    """(id, seq): the listing row of each ledger row, in the order of the ledger's ids.

    A row with a digest matches by hash only; one without takes the last listing row of its name or, failing that, of
    its url, upper and lower case alike, unless an earlier ledger row has taken it by either way. With `by_name_too` a
    row whose digest is not listed goes by name as well. Listing rows of one hash are one entry, and those without a
    hash one for each name. Every ledger row reaches one entry at most, so the first of those that reach an entry
    decides, and it is found by an aggregate that a hot name does not burden.
    """
    key = F.lower("name")
    listed = listing.select("seq", "hash", key.alias("_key"), F.when(F.col("hash") != "", F.concat(F.lit("h"), "hash")).otherwise(F.concat(F.lit("n"), key)).alias("_who"))
    by_hash = listed.where("hash <> ''").groupBy("hash").agg(F.max("seq").alias("seq"), F.first("_who").alias("_who"))
    by_name = listed.groupBy("_key").agg(F.max(F.struct("seq", "_who")).alias("_last"))
    row = ["id", F.lower("name").alias("_name"), F.lower("url").alias("_url")]
    # rows without a digest stay out of the join by it, where all of them would meet in one task
    hashed = ledger.where("digest is not null").join(by_hash, F.col("digest") == F.col("hash"), "left" if by_name_too else "inner").select(*row, "seq", "_who")
    bound = hashed.where("seq is not null")
    free = ledger.where("digest is null").select(*row)
    if by_name_too:
        free = free.unionByName(hashed.where("seq is null").select("id", "_name", "_url"))
    # rows of one name and url reach the same entry, so the first of them stands for all; a missing name or url is replaced
    # by the other, which changes no answer and leaves no nulls to be joined
    ways = free.groupBy("_name", "_url").agg(F.min("id").alias("id")).select("id", F.coalesce("_name", "_url").alias("_name"), F.coalesce("_url", "_name").alias("_url")).where("_name is not null")
    named = ways.join(by_name.toDF("_name", "_named"), "_name", "left").join(by_name.toDF("_url", "_linked"), "_url", "left")
    named = named.select("id", F.coalesce("_named", "_linked").alias("_at")).where("_at is not null").select("id", "_at.seq", "_at._who", F.lit(False).alias("bound"))
    known = bound.groupBy("_who").agg(F.min("id").alias("id"), F.max("seq").alias("seq")).withColumn("bound", F.lit(True))
    first = known.unionByName(named).groupBy("_who").agg(F.min(F.struct("id", "bound", "seq")).alias("f"))
    return bound.select("id", "seq").unionByName(first.where("not f.bound").select("f.id", "f.seq"))


def duplicate_active(ledger: DataFrame) -> DataFrame:
    """(name, n) of names with several active rows."""
    return ledger.where(F.col("status").isin(*ACTIVE)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def active_work(ledger: DataFrame) -> DataFrame:
    """How many rows (n) still need the transfer client."""
    s = F.col("status")
    return ledger.where(s.isin("queued", "seeding") | ((s == "downloading") & ~is_direct("url")) | ((s == "cancelled") & F.col("digest").isNotNull())).agg(F.count(F.lit(1)).alias("n"))


def apply_live(ledger: DataFrame, live: DataFrame) -> DataFrame:
    """(id, progress, state): what the listing (id, progress, state) says of each row, 0 and unknown where it says nothing."""
    said = live.select("id", F.col("progress").cast("double").alias("_p"), F.col("state").alias("_s"))
    return ledger.join(said, "id", "left").select("id", F.coalesce("_p", F.lit(0.0)).alias("progress"), F.coalesce("_s", F.lit("unknown")).alias("state"))


#: The columns of a ledger row that the transfer client's figures fill.
STATS = {"progress": "double", "speed_bps": "bigint", "eta_secs": "bigint", "ratio": "double", "up_speed_bps": "bigint", "num_seeds": "bigint"}


def changed(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Whether fresh figures (progress, ratio, num_seeds, dlspeed, upspeed) differ enough from a row's to be written. Unknown old ones count as 0."""
    known = {k: F.coalesce(v, F.lit(0)) for k, v in old.items()}
    return (
        (F.abs(new["progress"] - known["progress"]) >= 0.01) | (new["ratio"] != known["ratio"]) | (new["num_seeds"] != known["num_seeds"])
        | (new["dlspeed"] != 0) | (new["upspeed"] != 0)
    )


def apply_stats(ledger: DataFrame, stats: DataFrame, now: Column, idle_seconds: int = 60) -> DataFrame:
    """The ledger with the client's figures (id, progress, ratio, num_seeds, dlspeed and upspeed in KiB/s, remaining bytes).

    Rows whose figures changed by the rule of `changed` get all of STATS and the time `now`. A row that the client shows
    unchanged keeps its figures, and gets the time only if it is older than `idle_seconds`. All others keep all they have.
    Columns of STATS that the ledger lacks start as null; `stats` has one row for an id.
    """
    rows = ledger.withColumns({c: F.col(c).cast(kind) if c in ledger.columns else F.lit(None).cast(kind) for c, kind in STATS.items()})
    seen = stats.select("id", F.struct(F.col("progress").cast("double").alias("progress"), F.col("ratio").cast("double").alias("ratio"), "num_seeds", "dlspeed", "upspeed", "remaining").alias("_new"))
    new = {c: F.col(f"_new.{c}") for c in ("progress", "ratio", "num_seeds", "dlspeed", "upspeed", "remaining")}
    rows = rows.join(seen, "id", "left").withColumn("_write", F.coalesce(changed({c: F.col(c) for c in ("progress", "ratio", "num_seeds")}, new), F.lit(False)))
    fresh = {"progress": new["progress"], "speed_bps": kib_to_bytes(new["dlspeed"]), "eta_secs": eta_seconds(new["remaining"], kib_to_bytes(new["dlspeed"])), "ratio": new["ratio"], "up_speed_bps": kib_to_bytes(new["upspeed"]), "num_seeds": new["num_seeds"]}
    due = F.col("_write") | (F.col("_new").isNotNull() & (F.col("updated_at") < now - F.expr(f"INTERVAL {idle_seconds} SECOND")))
    written = {c: F.when(F.col("_write"), v.cast(STATS[c])).otherwise(F.col(c)) for c, v in fresh.items()}
    return rows.withColumns(written | {"updated_at": F.when(due, now).otherwise(F.col("updated_at"))}).drop("_new", "_write")


def requeue_interrupted(ledger: DataFrame) -> DataFrame:
    """The ledger after a restart: direct downloads under way are queued again, without the path and error that they had."""
    again = (F.col("status") == "downloading") & is_direct("url")
    cleared = {c: F.when(~again, F.col(c)) for c in ("file_path", "error") if c in ledger.columns}
    return ledger.withColumns(cleared | {"status": F.when(again, "queued").otherwise(F.col("status"))})


def drain_cancelled(ledger: DataFrame) -> DataFrame:
    """The ledger with the digests of cancelled rows let go."""
    return ledger.withColumn("digest", F.when(F.col("status") != "cancelled", F.col("digest")))


def reconcile_actions(ledger: DataFrame, matched: DataFrame, as_of: DataFrame, grace_minutes: int = 10) -> DataFrame:
    """(id, action) per ledger row from its status and whether the listing has it; matched has id, progress and state."""
    row = ledger.join(matched, "id", "left").join(F.broadcast(as_of))
    here = F.col("state").isNotNull()
    done = (F.col("progress") >= 0.999) & F.col("state").isin(*COMPLETE_STATES)
    old = F.col("updated_at") < F.col("as_of") - F.expr(f"INTERVAL {grace_minutes} MINUTE")
    action = (
        F.when((F.col("status") == "queued") & here, "bind").when((F.col("status") == "downloading") & here & done, "finish")
        .when(F.col("status").isin("downloading", "seeding") & here & F.col("state").isin(*FATAL_STATES), "settle").when(F.col("status").isin("downloading", "seeding") & here, "refresh")
        .when((F.col("status") == "downloading") & ~is_direct("url") & old, "error").when((F.col("status") == "seeding") & old, "done").otherwise("keep")
    )
    return row.select("id", action.alias("action"))


def reconcile(ledger: DataFrame, listing: DataFrame, as_of: DataFrame, grace_minutes: int = 10) -> DataFrame:
    """(id, seq, action): `reconcile_actions` for each ledger row by the listing row that it matches, and `adopt` for each listing row that none knows.

    Matching is that of `match_listing` with names for digests that are not listed; direct downloads match nothing. A
    listing row is adopted if no ledger row has its hash as digest and none matched it; its id is null.
    """
    met = match_listing(ledger.where(~is_direct("url")), listing, by_name_too=True)
    told = listing.select("seq", F.col("progress").cast("double").alias("progress"), "state")
    actions = reconcile_actions(ledger, met.join(told, "seq"), as_of, grace_minutes).join(met, "id", "left").select("id", "seq", "action")
    taken = met.join(listing.select("seq", "hash"), "seq")
    new = listing.join(taken.select("seq"), "seq", "left_anti").join(taken.where("hash <> ''").select("hash"), "hash", "left_anti")
    new = new.join(ledger.where(~is_direct("url")).select(F.col("digest").alias("hash")), "hash", "left_anti")
    return actions.unionByName(new.select(F.lit(None).cast(ledger.schema["id"].dataType).alias("id"), "seq", F.lit("adopt").alias("action")))


def stats_changed(rows: DataFrame) -> DataFrame:
    """Rows (old_ and new_ of progress, ratio and num_seeds, dlspeed, upspeed) that differ enough to be written."""
    three = ("progress", "ratio", "num_seeds")
    return rows.where(changed({c: F.col(f"old_{c}") for c in three}, {c: F.col(f"new_{c}") for c in three} | {c: F.col(c) for c in ("dlspeed", "upspeed")}))


def requeue(ledger: DataFrame, as_of: DataFrame) -> DataFrame:
    """Failed rows to try again: stale, with a passing error, the newest of their name, none active of it, and not the third and more in a row with one message."""
    told = ledger.where("error is not null").select(F.col("name").alias("key"), F.col("id").alias("seq"), F.col("error").alias("message"))
    hopeless = error_streak(told).where("give_up").select(F.col("seq").alias("id"))
    fit = stale(ledger, as_of, ["error"]).where(retryable_error("error") & ~access_error("error"))
    return newest_duplicate(ledger).join(fit.select("id"), "id", "left_semi").join(hopeless, "id", "left_anti")
