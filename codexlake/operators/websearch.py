"""The query language of full-text search: words, quoted phrases, `or`, and a minus before what must not occur.

A query is clauses between `or`s; a clause is items that must all occur, or must not. An item is a word or
a phrase, cut by the same tokenizer as the articles, so that a hyphenated word is a phrase of its parts.
Everything is joins and aggregates over a batch of queries; only multi-item scores reach an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.cluster import bounded, settle, ship
from codexlake.functions.text import tokens
from codexlake.sources.inverted import ROWS_A_PART, Inverted, open_inverted, write_inverted


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, clause, item, barred, k, token, width): a row for each token of each item. Queries that are null or without words give none."""
    quoted = F.regexp_extract_all(F.lower(F.coalesce("q", F.lit(""))), F.lit(r'(-?"[^"]*"?|[^\s"]+)'), F.lit(1))
    items = queries.select("query_id", F.posexplode(quoted).alias("item", "text"))
    items = items.withColumn("clause", F.sum((F.col("text") == "or").cast("int")).over(Window.partitionBy("query_id").orderBy("item")))
    items = items.where("text <> 'or'").select("query_id", "clause", "item", F.col("text").startswith("-").alias("barred"), tokens("text").alias("t")).where(F.size("t") > 0)
    return items.select("query_id", "clause", "item", "barred", F.size("t").alias("width"), F.posexplode("t").alias("k", "token"))


def write_index(posted: DataFrame, path: str, rows_a_part: int = ROWS_A_PART) -> None:
    """Store postings by token, with the number of postings of each token; see `inverted`."""
    write_inverted(posted, "token", path, rows_a_part=rows_a_part)


def open_index(spark: SparkSession, path: str) -> Inverted:
    return open_inverted(spark, path)


def met(terms: DataFrame, posted: DataFrame) -> DataFrame:
    """Postings of the terms' tokens with the terms. A batch's terms are broadcast as far as they are bounded, so that neither all postings nor a hot token's are shuffled."""
    return posted.join(bounded(terms), "token")


def met_rarest_first(terms: DataFrame, posted: DataFrame, counted: DataFrame) -> DataFrame:
    """Postings with the terms, of documents that have the rarest wanted token of a clause; a clause with a token that no document has is dropped.

    The rarest tokens' postings name the documents, and those of the clause's other tokens are looked up by token
    and document, so a frequent token costs no more than the documents that are still in question.
    """
    wanted = terms.where("not barred").join(counted.select("token", "df"), "token", "left")
    rarest = wanted.groupBy("query_id", "clause").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("x")).where("x.df > 0").select("query_id", "clause", F.col("x.token").alias("token"))
    named = posted.select("token", "id").join(rarest, "token").select("query_id", "clause", "id").distinct()
    return posted.join(named.join(terms, ["query_id", "clause"]), ["token", "id"])


def matches(terms: DataFrame, posted: DataFrame | Inverted) -> DataFrame:
    """(query_id, id) of the documents that satisfy a clause of the parsed query: all its items and none of the barred. A clause of barred items only matches nothing."""
    if isinstance(posted, Inverted):
        counted = posted.counts(terms.select("token").distinct())
        return _satisfied(terms, met_rarest_first(terms, posted.rows(counted), counted))
    return _satisfied(terms, met(terms, posted))


def _satisfied(terms: DataFrame, hits: DataFrame) -> DataFrame:
    key = ["query_id", "clause", "item", "barred", "id"]
    words = hits.where("width = 1").select(*key)
    starts = hits.where("width > 1").select(*key, "k", "width", F.explode("positions").alias("p")).groupBy(*key, "width", (F.col("p") - F.col("k")).alias("start")).agg(F.countDistinct("k").alias("n"))
    found = words.union(starts.where("n = width").select(*key))
    need = terms.where("not barred").groupBy("query_id", "clause").agg(F.countDistinct("item").alias("need"))
    held = found.groupBy("query_id", "clause", "id").agg(F.countDistinct(F.when(~F.col("barred"), F.col("item"))).alias("met"), F.max("barred").alias("hit"))
    return held.where("not hit").join(bounded(need), ["query_id", "clause"]).where("met = need").select("query_id", "id").distinct()


def ranked(terms: DataFrame, posted: DataFrame | Inverted, best: int | None = None, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score) of the matching documents by cover density.

    A query of one word scores the sum of its occurrences' weights, natively. Of others, every minimal
    window that satisfies the query is a cover; one of n entries counts n / (sum of 1 / weight), divided
    by one plus the words between. These documents reach an Arrow function, one at a time.

    With `best`, documents of queries of several words that cannot be among so many best of their query are left
    out: covers end at different hits, and none counts more than the greatest weight among them, so hits times
    that weight bound a score. The documents of the greatest bounds are scored first, and of the others only those whose
    bound reaches the last of these scores. `within` keeps those of the matching (query_id, id) that are to be scored.
    """
    ship(terms.sparkSession)
    shape = terms.where("not barred").groupBy("query_id").agg(F.count(F.lit(1)).alias("words"), F.collect_list(F.struct("clause", "item", "k", "token")).alias("query"))
    rows = _answers(terms, posted, within).join(bounded(shape), "query_id")
    single = rows.where("words = 1").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.size("positions")).alias("score"))
    several = rows.where("words > 1").select("query_id", "id", "token", "weight", "query", "positions")
    if best is None:
        return single.unionByName(_densities(several))
    several = settle(several)
    bounds = several.groupBy("query_id", "id").agg((F.sum(F.size("positions")) * F.max("weight")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "id"))
    bounds = settle(bounds.withColumn("place", place))
    key = ["query_id", "id"]
    first = settle(_densities(several.join(bounds.where(F.col("place") <= best).select(*key), key, "left_semi")))
    last = first.groupBy("query_id").agg(F.min("score").alias("last"))
    rest = bounds.where(F.col("place") > best).join(last, "query_id").where("bound >= last - 1e-8").select(*key)
    return single.unionByName(first).unionByName(_densities(several.join(rest, key, "left_semi")))


def _answers(terms: DataFrame, posted: DataFrame | Inverted, within: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, token, weight, positions): the wanted tokens' postings of the documents that match each query."""
    wanted = terms.where("not barred").select("query_id", "token").distinct()
    within = within or (lambda found: found)
    if isinstance(posted, Inverted):
        counted = settle(posted.counts(terms.select("token").distinct()))
        rows = posted.rows(counted)
        found = settle(within(_satisfied(terms, met_rarest_first(terms, rows, counted))))
        return rows.join(found.join(wanted, "query_id"), ["token", "id"]).select("query_id", "id", "token", "weight", "positions")
    # narrowed once, for both uses
    rows = settle(posted.join(bounded(terms.select("token").distinct()), "token", "left_semi"))
    return met(wanted, rows).join(within(_satisfied(terms, met(terms, rows))), ["query_id", "id"]).select("query_id", "id", "token", "weight", "positions")


def _densities(rows: DataFrame) -> DataFrame:
    """(query_id, id, score) by cover density of documents' postings with their queries."""
    several = rows.select("query_id", "id", "token", "weight", "query", F.explode("positions").alias("pos"))
    several = several.groupBy("query_id", "id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("pos", "token", "weight"))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [density([(h["pos"], h["token"], h["weight"]) for h in hits], items_of(q)) for q, hits in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], names=["query_id", "id", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in several.schema}
    return several.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def items_of(query: list[dict]) -> list[list[tuple[str, ...]]]:
    """Clauses of items, each a tuple of tokens, from the rows of a parsed query."""
    out: dict[int, dict[int, list]] = {}
    for r in query:
        out.setdefault(r["clause"], {}).setdefault(r["item"], []).append((r["k"], r["token"]))
    return [sorted({tuple(t for _, t in sorted(item)) for item in items.values()}) for items in out.values()]


def density(hits: list[tuple[int, str, float]], clauses: list[list[tuple[str, ...]]]) -> float:
    """Cover density of sorted (position, token, weight) hits."""
    total, lo = 0.0, 0
    held: dict[str, dict[int, int]] = {}

    def has(item: tuple[str, ...]) -> bool:
        first = held.get(item[0])
        if not first or len(item) == 1:
            return bool(first)
        return any(all(p + k in held.get(t, ()) for k, t in enumerate(item)) for p in first)

    def satisfied() -> bool:
        return any(all(has(i) for i in items) for items in clauses)

    for at, (pos, token, _) in enumerate(hits):
        held.setdefault(token, {})[pos] = 1
        while lo <= at and satisfied():
            first = hits[lo]
            del held[first[1]][first[0]]
            if not held[first[1]]:
                del held[first[1]]
            if not satisfied():
                window = hits[lo : at + 1]
                total += len(window) / sum(1 / h[2] for h in window) / (1 + (pos - first[0] + 1 - len(window)))
            lo += 1
    return total
