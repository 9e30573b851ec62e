"""Archives and their articles: joins, summaries and reports. Tables and columns are parameters; nothing is read here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexlake.cluster import bounded, settle

#: Characters of a preview that a search result carries.
SHOWN = 600
#: Links of an entity that meet as many others in one group, about.
BLOCK = 10_000
#: Pairs of links that one task is given, about, and how many tasks there are at most.
TASK_PAIRS, MOST_TASKS = 1 << 18, 4096


def list_archives(archives: DataFrame) -> DataFrame:
    """The archives by name with what a listing shows of each."""
    return archives.orderBy("name").select("id", "name", "language", "indexed_entries", "index_status")


def result_projection(articles: DataFrame) -> DataFrame:
    """What a search result carries of an article: its snippet, and its preview cut to SHOWN characters. Articles without a column snippet have none."""
    snippet = F.col("snippet") if "snippet" in articles.columns else F.lit(None).cast("string")
    return articles.select("id", "archive_id", "path", "title", snippet.alias("snippet"), F.left("content_preview", F.lit(SHOWN)).alias("content_preview"), "language", "archive")


def with_archive(articles: DataFrame, archives: DataFrame, *columns: str) -> DataFrame:
    """Articles with columns of their archive (archive_id = id); articles of unknown archives go."""
    named = archives.select(F.col("id").alias("archive_id"), *columns)
    return articles.join(named, "archive_id")


def cross_language(links: DataFrame, archives: DataFrame, articles: DataFrame) -> DataFrame:
    """(path, qid, archive, other_path, title): for each entity link, the links of the same entity in other archives.

    Links (archive_id, path, qid) meet by entity, so an entity in n archives gives n (n - 1) rows: it is the
    answer's own size. A link whose article is missing keeps a null title. Names and titles are joined to the links
    before these meet, so no pair is shuffled or sorted. The links of an entity with many are dealt to blocks of about
    BLOCK; every block of the one side meets every one of the other in a group of its own. The other side's links lie
    in one list for each group and archive, so a link passes its own archive over at once and goes through the other
    lists. Groups are dealt to as many tasks as their pairs ask for, not as their few bytes do.
    """
    links = links.where("qid is not null").select("archive_id", "path", "qid")
    counts = settle(links.groupBy("qid").agg(F.count(F.lit(1)).alias("c")).withColumn("_blocks", F.ceil(F.col("c") / BLOCK).cast("int")))
    many = F.broadcast(counts.where("_blocks > 1").select("qid", "_blocks"))
    size = counts.agg(F.sum(F.col("c") * F.col("c")).alias("pairs"), F.sum(F.col("_blocks").cast("long") * F.col("_blocks")).alias("groups")).first()
    tasks = max(1, min(2 * (size.groups or 0), (size.pairs or 0) // TASK_PAIRS, MOST_TASKS))
    names = bounded(archives.select(F.col("id").alias("_other"), F.col("name").alias("archive")))
    titles = articles.select(F.col("archive_id").alias("_other"), F.col("path").alias("other_path"), "title")
    other = links.select(F.col("archive_id").alias("_other"), F.col("path").alias("other_path"), "qid").join(titles, ["_other", "other_path"], "left").join(names, "_other")

    def dealt(side: DataFrame, path: str, own: str, met: str) -> DataFrame:
        at = side.join(many, "qid", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn(own, F.pmod(F.xxhash64(path), "_blocks").cast("int"))
        return at.withColumn(met, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks").repartition(tasks, "qid", "_i", "_j")

    # an entity is spelled before the links meet, once for each list and not for each pair
    lists = dealt(other, "other_path", "_j", "_i").groupBy("qid", "_i", "_j", "_other", "archive").agg(F.collect_list(F.struct("other_path", "title")).alias("_list"), F.concat(F.lit("Q"), F.first("qid")).alias("_named"))
    # joined where they lie and not broadcast: what Spark takes for small may not be
    met = dealt(links, "path", "_i", "_j").join(lists.hint("merge"), ["qid", "_i", "_j"]).where("archive_id <> _other")
    return met.select("path", F.col("_named").alias("qid"), "archive", F.inline("_list"))


def embeddable_archives(archives: DataFrame, articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Names of ready archives with embedding enabled that have an article without a vector."""
    bare = articles.join(vectors.select("id"), "id", "left_anti").select(F.col("archive_id").alias("id"))
    return archives.where("embed_enabled and index_status = 'ready'").join(bare, "id", "left_semi").select("name")


def without_match(rows: DataFrame, known: DataFrame, on: str, key: str) -> DataFrame:
    """Rows whose `on` is not among the `key`s of a table; null keys match nothing. Orphaned links and listing rows to adopt are found so."""
    return rows.join(known.where(F.col(key).isNotNull()).select(F.col(key).alias(on)), on, "left_anti")


def collection_members(collections: DataFrame, archives: DataFrame) -> DataFrame:
    """(id, names): names of a collection's archives in the order of its array `ids`, with commas; unknown ids are passed over."""
    members = archives.select(F.col("id").alias("member"), "name")
    placed = collections.select("id", F.posexplode_outer("ids").alias("pos", "member")).join(members, "member", "left")
    held = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name")))).alias("m"))
    return held.select("id", F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("names"))


def names_to_ids(wanted: DataFrame, archives: DataFrame) -> DataFrame:
    """(name, id, unknown) of each wanted name."""
    return wanted.join(archives.select("name", "id"), "name", "left").select("name", "id", F.col("id").isNull().alias("unknown"))


def required_ids(wanted: DataFrame, archives: DataFrame, shown: int = 20) -> DataFrame:
    """(name, id) of each wanted name; names that no archive has are an error that lists the first of them."""
    unknown = [r.name for r in wanted.select("name").distinct().join(archives.select("name"), "name", "left_anti").orderBy("name").limit(shown).collect()]
    if unknown:
        raise ValueError(f"no such archives: {', '.join(map(str, unknown))}")
    return wanted.join(archives.select("name", "id"), "name").select("name", "id")


def set_difference(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(key, side): which keys were removed, added or are in both. One full join over the distinct keys of either side."""
    a, b = old.select(key).distinct().withColumn("_a", F.lit(True)), new.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("both").alias("side"))


def library_summary(archives: DataFrame) -> DataFrame:
    """How many archives there are, and how many entries they index together."""
    return archives.agg(F.count(F.lit(1)).alias("archives"), F.sum("indexed_entries").alias("entries"))


def id_bounds(articles: DataFrame) -> DataFrame:
    return articles.groupBy("archive").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))


def embedded_count(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """(archive, n, embedded): articles, and those of them with a vector."""
    marked = articles.join(vectors.select("id", F.lit(1).alias("_has")), "id", "left")
    return marked.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.count("_has").alias("embedded"))


def flag_presence(rows: DataFrame, key: str, valid: Column, some: Column) -> DataFrame:
    """(key, flag): present where a row is valid, present_invalid where one is only there, else absent."""
    seen = rows.groupBy(key).agg(F.bool_or(valid).alias("_valid"), F.bool_or(some).alias("_some"))
    return seen.select(key, F.when(F.col("_valid"), "present").when(F.col("_some"), "present_invalid").otherwise("absent").alias("flag"))


def integrity_report(ledger: DataFrame) -> DataFrame:
    """(name, with_digest, drifted) of names that have a digest or a failed row, and under a null name the totals."""
    return ledger.where("name is not null").rollup("name").agg(F.count("digest").alias("with_digest"), F.count_if(F.col("status") == "error").alias("drifted")).where("with_digest > 0 or drifted > 0")


def wait_stats(waits: DataFrame, site: str, value: str) -> DataFrame:
    """(site, n, most, mean) per site and, with a null site, of all; the mean is whole and 0 where there is none."""
    named = waits.select(F.col(site).alias("site"), F.col(value).cast("bigint").alias("v"))
    return named.rollup("site").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"), F.expr("coalesce(sum(v) div count(1), 0)").alias("mean"))


def progress(rows: DataFrame, key: str, done: Column) -> DataFrame:
    """(key, progress): the share of a key's rows that are done."""
    return rows.groupBy(key).agg((F.count_if(done) / F.count(F.lit(1))).alias("progress"))
