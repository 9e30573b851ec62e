"""A stored index of titles by their grams, and the title arms over it.

Similarity keeps each title under its rarest grams only. Grams are ordered by how many titles have them. Two sets of a
and b grams have a similarity above t only if they share more than t (a + b) / (1 + t) grams, so the first that they
share stands early in both: as many places before the end as are to be shared. A title lies under the places that any
partner can need, a query asks for the same of its own, and a pair that meets is dropped by its sizes and places before
its grams are compared. Containment and prefixes go by the grams of the plain title, the query's rarest one first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.cluster import settle
from codexlake.functions.text import trigrams
from codexlake.sources.inverted import ROWS_A_PART, Inverted, open_inverted, write_inverted

#: The least similarity that the stored places serve.
LEAST = 0.3


def shared_least(a: Column, b: Column, least: float) -> Column:
    """How many grams sets of these sizes must share to be more alike than `least`; a rounding more is never asked for."""
    return (F.floor((a + b) * (least / (1 + least)) - 1e-9) + 1).cast("int")


def raw_grams(title: Column) -> Column:
    """structs (gram, start): the distinct three-character pieces of a title, and its first one and two characters; `start` tells whether it begins so."""
    n = F.length(title)
    inner = F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(title, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_compact(F.array_distinct(F.concat(inner, F.array(F.when(n >= 1, F.left(title, F.lit(1))), F.when(n >= 2, F.left(title, F.lit(2)))))))
    return F.transform(pieces, lambda g: F.struct(g.alias("gram"), F.startswith(title, g).alias("start")))


@dataclass(frozen=True)
class GramIndex:
    """Titles stored under grams: `similar` (gram, id, size, place), `raw` (gram, id, start, title_lower), `titles` (id, g, title_lower).

    Equal titles are stored once, under their smallest id; `copies` names the ids of each.
    """

    similar: Inverted
    raw: Inverted
    titles: str

    def copies(self) -> DataFrame:
        """(first, id) of every title."""
        return self.similar.spark.read.parquet(f"{self.titles}-copies")


def write_gram_index(titles: DataFrame, path: str, rows_a_part: int = ROWS_A_PART) -> None:
    """Store the titles (id, title_lower); null titles have no grams and are found by nothing."""
    named = titles.where("title_lower is not null").select("id", "title_lower")
    once = settle(named.groupBy("title_lower").agg(F.min("id").alias("first")))
    # merged, as copies of a title may be many: a join by shuffle splits them, and sizes are not guessed
    named.join(once.hint("merge"), "title_lower").select("first", "id").write.mode("overwrite").parquet(f"{path}/titles-copies")
    kept = settle(once.select(F.col("first").alias("id"), "title_lower", trigrams("title_lower").alias("g")))
    each = kept.select("id", F.explode("g").alias("gram"))
    counted = settle(each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    placed = each.join(counted, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    rows = placed.select("id", F.size("g").alias("size"), F.posexplode("g").alias("place", "x")).where(F.col("place") < F.col("size") - F.floor(F.col("size") * LEAST - 1e-9))
    # order is by all titles' counts, which the index keeps; parts follow from what it holds
    write_inverted(rows.select(F.col("x.gram").alias("gram"), "id", "size", "place"), "gram", f"{path}/similar", known=counted, rows_a_part=rows_a_part)
    raw = kept.select("id", "title_lower", F.explode(raw_grams(F.col("title_lower"))).alias("x")).select("x.gram", "id", "x.start", "title_lower")
    write_inverted(raw, "gram", f"{path}/raw", rows_a_part=rows_a_part)
    kept.write.mode("overwrite").parquet(f"{path}/titles")


def open_gram_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(open_inverted(spark, f"{path}/similar"), open_inverted(spark, f"{path}/raw"), f"{path}/titles")


def candidates(queries: DataFrame, index: GramIndex, least: float = LEAST) -> DataFrame:
    """(query_id, id) that sizes and places of a shared rare gram leave in reach; each once for each such gram."""
    least = max(least, LEAST)
    each = queries.select("query_id", trigrams("q").alias("g")).where(F.size("g") > 0).select("query_id", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    counted = index.similar.counts(each.select("gram").distinct())
    # grams that no title has stand first
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "gram")) - 1
    asked = each.join(counted.select("gram", "df"), "gram", "left").withColumn("pq", place).where(F.col("df").isNotNull() & (F.col("pq") < F.col("nq") - F.floor(F.col("nq") * least - 1e-9)))
    held = index.similar.rows(counted)
    need = shared_least(F.col("nq"), F.col("size"), least)
    met = held.join(asked, "gram").where((need <= F.least("nq", "size")) & (F.col("pq") <= F.col("nq") - need) & (F.col("place") <= F.col("size") - need))
    return met.select("query_id", "id")


def similar_indexed(queries: DataFrame, index: GramIndex, least: float = LEAST) -> DataFrame:
    """(query_id, id, sim) of all titles more alike than `least`, LEAST at least."""
    least = max(least, LEAST)
    return compared(candidates(queries, index, least).distinct(), queries, index).where(F.col("sim") > least)


def compared(found: DataFrame, queries: DataFrame, index: GramIndex) -> DataFrame:
    """(query_id, id, sim) of pairs (query_id, id): grams are cut once for each query, and those of titles are stored."""
    kept = index.similar.spark.read.parquet(index.titles).select("id", "g")
    both = found.join(kept, "id").join(queries.select("query_id", trigrams("q").alias("h")), "query_id")
    n = F.size(F.array_intersect("g", "h"))
    union = F.size("g") + F.size("h") - F.col("n")
    return both.withColumn("n", n).select("query_id", "id", F.when(union > 0, F.col("n") / union).otherwise(F.lit(0.0)).alias("sim"))


def _scored(hits: DataFrame, queries: DataFrame, index: GramIndex, weight: float) -> DataFrame:
    return compared(hits.select("query_id", "id"), queries, index).select("query_id", "id", (F.lit(weight) * F.col("sim")).alias("score"))


def prefix_indexed(queries: DataFrame, index: GramIndex, weight: float) -> DataFrame:
    """(query_id, id, score) of titles that start with the query, found under its first three characters, or as many as it has."""
    q = queries.select("query_id", F.lower("q").alias("q")).where("q <> ''").withColumn("gram", F.left("q", F.lit(3)))
    held = index.raw.rows(index.raw.counts(q.select("gram").distinct())).where("start")
    return _scored(held.join(q, "gram").where(F.startswith("title_lower", "q")), queries, index, weight)


def contains_indexed(queries: DataFrame, index: GramIndex, weight: float) -> DataFrame:
    """(query_id, id, score) of titles that contain the query of three characters and more, found under its rarest gram; a gram that no title has settles it."""
    q = queries.select("query_id", F.lower("q").alias("q")).where("length(q) >= 3")
    grams = q.select("query_id", "q", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - 2), lambda i: F.substring("q", i, F.lit(3))))).alias("gram"))
    counted = index.raw.counts(grams.select("gram").distinct())
    rarest = grams.join(counted.select("gram", "df"), "gram", "left").groupBy("query_id", "q").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("x")).where("x.df > 0")
    rarest = rarest.select("query_id", "q", "x.gram")
    held = index.raw.rows(counted)
    return _scored(held.join(rarest, "gram").where(F.col("title_lower").contains(F.col("q"))), queries, index, weight)
