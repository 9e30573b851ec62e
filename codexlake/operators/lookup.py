"""Lookups: newest rows, nearest ids, deterministic random picks, oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one span share a bucket when targets are sought.
SPAN = 1 << 16


def recent(df: DataFrame, at: str, n: int = 500) -> DataFrame:
    return df.orderBy(F.desc(at), "id").limit(min(n, 500))


def fetch_by_key(articles: DataFrame, keys: DataFrame) -> DataFrame:
    """Articles of given (archive, path) keys."""
    return articles.join(keys, ["archive", "path"])


def seek(targets: DataFrame, at: str, ids: DataFrame) -> DataFrame:
    """For each target the least id from it on, else the greatest up to it. Equal targets are sought once; a null target finds nothing."""
    wanted = targets.select(F.col(at).cast("long").alias("_sought")).where("_sought is not null").distinct()
    found = _nearest(wanted, "_sought", ids)
    return targets.withColumn("_sought", F.col(at).cast("long")).join(found, "_sought", "left").drop("_sought")


def _nearest(targets: DataFrame, at: str, ids: DataFrame) -> DataFrame:
    """`seek` for distinct targets.

    Ids and targets are laid in spans; within a span a window finds the next id, and the spans' own
    bounds, a row each, answer for targets whose span has none ahead.
    """
    span = lambda c: F.expr(f"{c} div {SPAN}")
    marked = ids.select(F.col("id").alias("_v"), F.col("id").alias("_id")).withColumn("_t", F.lit(0))
    names = targets.columns
    tagged = targets.select(F.struct(*names).alias("_row"), F.col(at).cast("long").alias("_v")).withColumn("_t", F.lit(1))
    both = marked.withColumn("_row", F.lit(None).cast(tagged.schema["_row"].dataType)).select("_v", "_id", "_t", "_row").unionByName(tagged.withColumn("_id", F.lit(None).cast("long")))
    both = both.withColumn("_s", span("_v"))
    ahead = F.last("_id", ignorenulls=True).over(Window.partitionBy("_s").orderBy(F.desc("_v"), "_t").rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_near", ahead).where("_t = 1")
    spans = ids.withColumn("_s", span("id")).groupBy("_s").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"))
    last = ids.agg(F.max("id").alias("_last"))
    steps = spans.withColumn("_next", F.lead("_lo").over(Window.orderBy("_s")))
    wanted = near.where("_near is null").select("_s").distinct()
    # spans without ids of their own look for the next span that has some
    order = steps.select("_s", "_lo", F.lit(0).alias("_q")).unionByName(wanted.select("_s", F.lit(None).cast("long").alias("_lo"), F.lit(1).alias("_q")))
    following = order.withColumn("_next", F.last("_lo", ignorenulls=True).over(Window.orderBy(F.desc("_s"), "_q").rowsBetween(Window.unboundedPreceding, -1))).where("_q = 1")
    later = order.where("_q = 0").select(F.col("_s").alias("_own"))
    fixed = following.join(later, F.col("_s") == F.col("_own"), "left").select("_s", F.col("_next"), F.col("_own"))
    skip = steps.select("_s", F.col("_next").alias("_after"))
    fixed = fixed.join(skip, "_s", "left").select("_s", F.when(F.col("_own").isNotNull(), F.col("_after")).otherwise(F.col("_next")).alias("_next"))
    return near.join(fixed, "_s", "left").join(F.broadcast(last)).select("_row.*", F.coalesce("_near", "_next", "_last").alias("id"))


def random_pick(scope: DataFrame, seed: int) -> DataFrame:
    """One id of the scope: the first from low + seed mod width on. An empty scope is an error."""
    b = scope.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    b = b.withColumn("lo", F.coalesce("lo", F.raise_error(F.lit("the scope is empty")).cast("long")))
    target = b.select((F.col("lo") + F.lit(seed) % (F.col("hi") - F.col("lo") + 1)).alias("at"), "hi")
    # the greatest id is at or beyond every target, so the least id from it on exists
    return scope.join(F.broadcast(target), scope["id"] >= F.col("at")).agg(F.min("id").alias("id"))


def fifo_take(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n oldest ids of each group."""
    return df.withColumn("fifo", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("fifo") <= n)
