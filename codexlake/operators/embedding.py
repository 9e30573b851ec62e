"""Upkeep of article vectors: what lacks one, batches, checks of what comes back, and a hashing vectoriser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexlake.cluster import ship
from codexlake.functions.text import embed_text


def backlog(articles: DataFrame, archives: DataFrame, vectors: DataFrame, most: int = 100_000, as_of: Column | None = None, minutes: int = 10) -> DataFrame:
    """(archive, id, fifo): per ready and enabled archive its oldest articles without a vector, at most `most`.

    With `as_of`, articles that another run claimed (embed_at) within the last `minutes` are left to it.
    """
    if as_of is not None:
        articles = articles.where(F.col("embed_at").isNull() | (F.col("embed_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTE")))
    fit = archives.where("embed_enabled and index_status = 'ready'").select(F.col("name").alias("archive"))
    bare = articles.join(fit, "archive", "left_semi").join(vectors.select("id"), "id", "left_anti")
    return bare.withColumn("fifo", F.row_number().over(Window.partitionBy("archive").orderBy("id"))).where(F.col("fifo") <= most).select("archive", "id", "fifo")


def batches(waiting: DataFrame, size: int) -> DataFrame:
    return waiting.withColumn("batch", F.expr(f"(fifo - 1) div {size}"))


def check_batches(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(batch, accepted): as many vectors as asked for, with indices exactly 0 to n - 1."""
    asked = requests.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    got = responses.groupBy("batch").agg(F.count(F.lit(1)).alias("m"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.countDistinct("index").alias("k"))
    fine = (F.col("m") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("k") == F.col("n"))
    return asked.join(got, "batch", "left").select("batch", F.coalesce(fine, F.lit(False)).alias("accepted"))


def poison(failures: DataFrame, most: int = 3) -> DataFrame:
    """Ids (id, seq, ok) that failed `most` times and more since they last succeeded."""
    last = failures.groupBy("id").agg(F.max(F.when(F.col("ok") == 1, F.col("seq"))).alias("last"))
    return failures.join(last, "id").where("ok = 0 and (last is null or seq > last)").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).select("id")


def hashing_vectors(df: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Term counts hashed to a fixed size, scaled to length one: a vectoriser that needs no model. Texts without words get none."""
    words = df.select("id", F.explode(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("w"))
    counts = words.groupBy("id", F.pmod(F.conv(F.left(F.md5(F.col("w").cast("binary")), F.lit(12)), 16, 10).cast("bigint"), F.lit(size)).cast("int").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("embedding"))


def embed_articles(waiting: DataFrame, vectorise: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64) -> DataFrame:
    """(id, embedding, error) of texts (id, text) by a function that turns a list of texts into as many vectors.

    It is called in the tasks, with `batch` texts at a time. A call that fails, or whose answer has not one finite vector
    of `size` numbers for each text, gives its rows no vector and says why; the other calls go on. Null texts are empty.
    """
    ship(waiting.sparkSession)
    rows = waiting.select("id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.slice(lo, batch)
                try:
                    found = np.array(vectorise(part.column(1).to_pylist()), np.float64)
                    if found.shape != (len(part), size) or not np.isfinite(found).all():
                        raise ValueError(f"expected {len(part)} finite vectors of {size}, got shape {found.shape}")
                    vectors, error = list(found), None
                except Exception as e:  # whatever the user's function raises is that batch's answer
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * len(part), pa.string())], names=["id", "embedding", "error"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>, error string")


def embed_backlog(articles: DataFrame, archives: DataFrame, vectors: DataFrame, failures: DataFrame, vectorise: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64, most: int = 100_000) -> DataFrame:
    """(id, embedding, error) of one run over the backlog, without articles that failed three times (failures: id, seq, ok) since they last succeeded."""
    left = backlog(articles, archives, vectors, most).join(poison(failures), "id", "left_anti").select("id")
    snippet = F.col("snippet") if "snippet" in articles.columns else F.lit("")
    return embed_articles(articles.join(left, "id").select("id", embed_text(snippet, "content_preview").alias("text")), vectorise, size, batch)


def require_dimension(vectors: DataFrame, size: int) -> None:
    """An error unless all stored vectors have this dimension; no vectors have any."""
    other = [r.dimension for r in dimension_check(vectors.where("embedding is not null"), size).where("not fits").orderBy("dimension").collect()]
    if other:
        raise ValueError(f"vectors of {size} numbers are asked for, but there are some of {', '.join(map(str, other))}")


def dimension_check(vectors: DataFrame, size: int) -> DataFrame:
    """(dimension, n, fits): how many vectors have each dimension, and whether it is the one asked for."""
    return vectors.groupBy(F.size("embedding").cast("bigint").alias("dimension")).agg(F.count(F.lit(1)).alias("n")).withColumn("fits", F.col("dimension") == size)


def apply_vectors(articles: DataFrame, vectors: DataFrame, model: str, now: Column | None = None) -> DataFrame:
    """The articles with the new vectors (id, embedding), the model that made them and the time; articles without a new one keep what they have.

    Columns embedding, model and embed_at that the articles lack start as null. `vectors` has one row for an id.
    """
    kinds = {"embedding": vectors.schema["embedding"].dataType.simpleString(), "model": "string", "embed_at": "timestamp"}
    rows = articles.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in articles.columns})
    new = vectors.where("embedding is not null").select("id", F.col("embedding").alias("_new"))
    stamps = {"model": F.lit(model), "embed_at": now if now is not None else F.lit(None).cast("timestamp")}
    rows = rows.join(new, "id", "left").withColumns({c: F.when(F.col("_new").isNotNull(), v).otherwise(F.col(c)) for c, v in stamps.items()})
    return rows.withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
