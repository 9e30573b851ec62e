"""Two-pass external shuffle of a table into shards.

Pass 1 scatters the rows uniformly into memory-sized buckets by a seeded hash; pass 2 permutes each
bucket with Fisher-Yates and writes it. The buckets laid end to end are one random permutation of
all rows; dealing it out in turn gives shards whose row counts are at most one apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexlake.cluster import scratch, settle
from codexlake.llm.common import only, prepare, table, utf8

#: Text bytes a bucket should hold: what one task keeps in memory.
BUCKET_BYTES = 12 << 20
#: Rows equal in id and text that may share a bucket; more of them are spread over all buckets.
MOST_COPIES = 1000
#: Bytes a row counts besides its text, so that many tiny rows fill a bucket too.
ROW_BYTES = 64
#: Buckets that one task of the second pass takes, about.
TASK_BUCKETS = 8
#: Buckets under one window when offsets are summed; totals of such runs are summed in turn.
RUN = 4096


def numbered_copies(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """The rows (doc_id, text) with a column copy: 0, but for rows that come more than `most` times, which are numbered.

    Rows equal in id and text are interchangeable, so those of one kind are counted and laid out anew from the count,
    block by block in many tasks; the numbers are the same in any two evaluations.
    """
    name = F.xxhash64("doc_id", "text")
    hot = settle(docs.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("name"))
    if hot.isEmpty():
        return docs.withColumn("copy", F.lit(0).cast("long"))
    named = docs.withColumn("name", name)
    blocks = named.join(hot, "name", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}")))).repartition("block", "doc_id")
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * most, F.least((F.col("block") + 1) * most, F.col("n")) - 1)))
    return named.join(hot, "name", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("copy")).unionByName(copies.select("doc_id", "text", "copy"))


def scatter(docs: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """Pass 1: a bucket for every row (doc_id, text), from its id, text and copy alone, so that any two evaluations of the input agree."""
    return numbered_copies(only(docs, "doc_id", "text")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("copy")), F.lit(n_buckets))).drop("copy")


def bucket_offsets(scattered: DataFrame) -> DataFrame:
    """Rows that come before each bucket: sums within runs of buckets, then over the runs' totals."""
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.expr(f"bucket div {RUN}"))
    totals = sizes.groupBy("run").agg(F.sum("n").alias("t"))
    before = totals.select("run", (F.sum("t").over(Window.orderBy("run")) - F.col("t")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    return sizes.withColumn("inner", inner).join(before, "run").select("bucket", (F.col("base") + F.col("inner")).alias("offset"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of n places, the same whenever a task is run again."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), bucket])).shuffle(order)
    return order


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (doc_id, text, size, text_crc32, shard, slot) in their shuffled order.

    A null text counts as none: size 1, crc32 0. Null and repeated ids are rows like any other; rows equal
    in id and text are interchangeable. A text larger than a bucket is a bucket's row like others. An
    empty table gives no rows. Columns other than doc_id and text are not carried. Rows are dealt to as
    many tasks as hold TASK_BUCKETS buckets each, so a task's share does not grow with the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = only(docs, "doc_id", "text")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("b")).first().b or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    scattered = scatter(docs, n_buckets, seed)
    offsets = bucket_offsets(scattered)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_buckets // TASK_BUCKETS))

    def permute(group: pa.Table) -> pa.Table:
        bucket, offset = group["bucket"][0].as_py(), group["offset"][0].as_py()
        place = offset + np.arange(len(group))
        # the order before is the data's own, whatever order the rows were fetched in
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        out = group.select(["doc_id", "text"]).take(fisher_yates(len(group), seed, bucket))
        raw, off = utf8(out["text"])
        view = memoryview(raw)
        crc = np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)), np.int64, len(out))
        for name, values in (("size", np.diff(off) + 1), ("text_crc32", crc), ("shard", (place % n_shards).astype(np.int32)), ("slot", place // n_shards)):
            out = out.append_column(name, pa.array(values))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return (
        scattered.repartition(tasks, "bucket").join(offsets, "bucket").groupBy("bucket")
        .applyInArrow(permute, f"doc_id {kinds['doc_id']}, text string, size bigint, text_crc32 bigint, shard int, slot bigint")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards as Parquet folders shard=0, shard=1, ... below the path. A shard without rows has no folder; odd rows as in `shuffle_into_shards`."""
    shuffle_into_shards(docs, n_shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> Iterator:
    """One shard's rows in slot order; none of a shard that has no rows."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").toLocalIterator()


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` dealt to eight shards, written and read back; an empty table gives no rows."""
    path = scratch(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.read.schema(f"doc_id {kind}, text string, size bigint, text_crc32 bigint, slot bigint, shard int").parquet(path).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
