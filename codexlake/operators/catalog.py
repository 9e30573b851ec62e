"""The archive catalog: reindexing, snapshot differences, newer versions in a feed, drift of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.cluster import settle
from codexlake.functions.text import base_name, catalog_name, version
from codexlake.sources.versions import read_version, versions, write_version


def reindex(old: DataFrame, new: DataFrame, spans: int | None = None, top: DataFrame | None = None) -> DataFrame:
    """Articles after a run: all columns of the new extraction, with the old id and embedding where (archive, path) was known; others go.

    New rows get ids after the greatest, in order of (archive, path). Rows are ranged by (archive, path),
    numbered within each range and shifted by the ranges' totals, so an archive of any size is shared by
    many tasks; there are as many ranges as shuffle partitions unless given. An empty catalog starts at 0; `top`, one row,
    has the greatest id if `old` is not all of the catalog.
    """
    spans = spans or int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = old.select("archive", "path", F.col("id").alias("old_id"), "embedding")
    both = new.join(kept, ["archive", "path"], "left")
    top = old.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")) if top is None else top
    cols = [*new.columns, "embedding"]
    fresh = settle(both.where("old_id is null").select(*cols).repartitionByRange(spans, "archive", "path").withColumn("span", F.spark_partition_id()))
    totals = fresh.groupBy("span").agg(F.count(F.lit(1)).alias("t"))
    base = totals.select("span", (F.sum("t").over(Window.orderBy("span")) - F.col("t")).alias("base"))
    numbered = fresh.withColumn("n", F.row_number().over(Window.partitionBy("span").orderBy("archive", "path")))
    numbered = numbered.join(F.broadcast(base), "span").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("base") + F.col("n"))
    return both.where("old_id is not null").select(F.col("old_id").alias("id"), *cols).unionByName(numbered.select("id", *cols))


def merge_reindex(path: str, new: DataFrame, links: DataFrame, run_ts: Column) -> int:
    """Write the articles of the archives that a run extracted, their links and a stamp of the run, as one version; its number.

    Of these archives, articles that the run did not find go, and links (archive, path, ...) without an article; their ids
    and vectors are as in `reindex`. Other archives' files are not read, but for their greatest id, nor written. `new`
    needs archive, path and title; rows of no archive at all change nothing. Readers see the articles' newest version, and the
    tables beside it by that number, so a run that fails in between leaves the last version as it was.
    """
    spark = new.sparkSession
    part = F.md5(F.col("archive").cast("binary"))
    new = settle(new)
    archives = settle(new.select("archive").distinct().withColumn("part", part))
    touched = {r.part for r in archives.select("part").collect()}
    there = versions(spark, f"{path}/articles")
    number = there[-1] + 1 if there else 0
    if not touched:
        return number - 1
    kinds = f"id bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in new.schema)}, embedding array<float>"
    old = read_version(spark, f"{path}/articles", kinds, parts=touched)
    top = read_version(spark, f"{path}/articles", "id bigint").agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top"))
    articles = settle(reindex(old, new, top=top).withColumn("part", part))
    kept = links.join(articles.select("archive", "path"), ["archive", "path"], "left_semi").withColumn("part", part)
    for name, rows in (("links", kept), ("archives", archives.withColumn("updated_at", run_ts)), ("articles", articles)):
        write_version(rows.repartition("part"), f"{path}/{name}", number, touched)
    return number


def orphan_links(links: DataFrame, articles: DataFrame) -> DataFrame:
    return links.join(articles, ["archive_id", "path"], "left_anti")


def snapshot_diff(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(name, change, index_status): added, removed, changed, unreadable or same. A changed size makes an archive pending; an unknown size changes nothing."""
    c = catalog.select("name", F.col("file_size").alias("old"), "index_status")
    s = snapshot.select("name", F.col("file_size").alias("new"), F.lit(True).alias("seen"))
    both = c.join(s, "name", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("seen").isNull(), "removed").when(F.col("new").isNull(), "unreadable").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    both = both.withColumn("change", change)
    return both.select("name", "change", F.when(F.col("change").isin("added", "changed"), "pending").otherwise(F.col("index_status")).alias("index_status"))


def index_or_skip(catalog: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(name, decision): ready and of the same size is skipped, an unknown size keeps, others are indexed."""
    s = snapshot.select("name", F.col("file_size").alias("new"))
    d = F.when(F.col("new").isNull(), "keep").when((F.col("index_status") == "ready") & (F.col("new") == F.col("file_size")), "skip").otherwise("index")
    return catalog.join(s, "name", "left").select("name", d.alias("decision"))


def find_updates(feed: DataFrame, local: DataFrame) -> DataFrame:
    """(name, href, feed_pos): for each local archive (name and, if known, date) the newest newer entry of its base name.

    If both names carry a date these are compared; else the month of the feed's `updated` with that of the local date, and
    without either the entry is not newer. Entries rank by the date in their name, else by the month of `updated`; of
    equals the first in the feed is taken. Entries whose link names no archive are passed over.
    """
    month = F.left("updated", F.lit(7))
    shape = month.rlike("^[^-]{4}-[^-]{2}$")
    stamped = F.struct(*(F.when(shape, F.coalesce(F.substring(month, at, n).try_cast("int"), F.lit(0))).otherwise(0).alias(c) for c, at, n in (("year", 1, 4), ("month", 6, 2))))
    f = feed.withColumn("stem", catalog_name("href")).withColumn("base", F.lower(base_name("stem"))).withColumn("v", version("stem"))
    f = f.select("base", "href", "feed_pos", "v", month.alias("u"), F.coalesce("v", stamped).alias("rank"))
    date = F.left(F.col("date").cast("string"), F.lit(7)) if "date" in local.columns else F.lit(None).cast("string")
    mine = local.select("name", F.lower(base_name("name")).alias("base"), version("name").alias("own"), date.alias("at"))
    newer = F.when(F.col("v").isNotNull() & F.col("own").isNotNull(), F.col("v") > F.col("own")).otherwise(F.col("u") > F.col("at"))
    # the greatest rank, and of these the least place in the feed; found by an aggregate, so a hot base is no task's burden
    best = F.max_by(F.struct("href", "feed_pos"), F.struct("rank", -F.col("feed_pos")))
    return mine.join(f, "base").where(newer).groupBy("name").agg(best.alias("b")).select("name", "b.href", "b.feed_pos")


def download_link(links):
    """href of the first link that is an acquisition, ends in .zim or says so in its type."""
    hit = F.filter(links, lambda x: x["_rel"].contains("acquisition") | x["_href"].endswith(".zim") | x["_type"].contains("zim"))
    return F.get(hit, F.lit(0))["_href"]


def updates_to_queue(updates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Updates (url, claim) without a live row of the url, and without a settled one of the claimed digest, or any if none is claimed."""
    live = ledger.where("status in ('queued', 'downloading', 'seeding')").select("url").distinct()
    settled = ledger.where("status in ('complete', 'seeding')")
    free = updates.join(live, "url", "left_anti")
    named = free.where("claim is not null").join(settled.select("url", F.col("digest").alias("claim")).distinct(), ["url", "claim"], "left_anti")
    bare = free.where("claim is null").join(settled.select("url").distinct(), "url", "left_anti")
    return named.unionByName(bare)


def verify_claims(claims: DataFrame, observed: DataFrame) -> DataFrame:
    """(id, verdict): a claim that differs from what was measured is a mismatch; without either it is unverified."""
    v = F.when(F.col("claim").isNull() | F.col("measured").isNull(), "unverified").when(F.lower("claim") == F.lower("measured"), "verified").otherwise("mismatch")
    return claims.join(observed, "id", "left").select("id", v.alias("verdict"))


def record_integrity(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, content, publisher): the hash that the listing (id, hash, name) found, beside the ledger's claim or, without one, the listed name."""
    seen = listing.select("id", F.col("hash").alias("content"), F.col("name").alias("_name"))
    return ledger.join(seen, "id").select("id", "content", F.coalesce("digest", "_name").alias("publisher"))
