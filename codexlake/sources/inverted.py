"""Stored inverted indexes: rows under keys (tokens, grams), in parts of which a batch of queries reads only those of its keys.

A row's part is the hash of its key, so that a key is found without a look-up; a key of very many rows goes on in the
parts that follow, its rows dealt by id. The number of parts follows from the number of rows. Beside the rows lie the
counts of each key, in the same parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import settle

#: Rows that a part should hold, the most of a key in one part, and the most parts.
ROWS_A_PART, MOST_PARTS = 200_000, 1 << 14


@dataclass(frozen=True)
class Inverted:
    """An index at a path: `rows` by key and part, `counts` by key."""

    spark: SparkSession
    path: str
    key: str
    parts: int

    def home(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def counts(self, keys: DataFrame) -> DataFrame:
        """The counts of the distinct keys; only their parts are read."""
        wanted = keys.select(self.home(F.col(self.key)).alias("part")).distinct().collect()
        there = self.spark.read.parquet(f"{self.path}/counts").where(F.col("part").isin([r.part for r in wanted]))
        return there.join(keys, self.key, "left_semi").drop("part")

    def rows(self, counted: DataFrame) -> DataFrame:
        """The rows of all parts that may hold these counted keys; the parts' numbers, and nothing else, reach the driver."""
        at = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
        parts = counted.select(self.home(F.col(self.key)).alias("home"), at.alias("s")).select(((F.col("home") + F.col("s")) % self.parts).alias("part")).distinct().collect()
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("part").isin([r.part for r in parts])).drop("part")


def write_inverted(rows: DataFrame, key: str, path: str, counts: dict[str, Column] | None = None, known: DataFrame | None = None, rows_a_part: int = ROWS_A_PART) -> None:
    """Store rows (with columns `key` and id) under their keys. `counts` are further aggregates of each key; `known` are counts made before (key, df)."""
    spark = rows.sparkSession
    counted = known if known is not None else rows.groupBy(key).agg(F.count(F.lit(1)).alias("df"), *(c.alias(n) for n, c in (counts or {}).items()))
    counted = settle(counted.withColumn("splits", F.ceil(F.col("df") / rows_a_part).cast("int")))
    total = counted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = int(min(MOST_PARTS, max(1, -(-total // rows_a_part))))
    index = Inverted(spark, path, key, parts)
    spark.createDataFrame([(key, parts)], "key string, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    counted = counted.withColumn("splits", F.least("splits", F.lit(parts)))
    counted.withColumn("part", index.home(F.col(key))).repartition(parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")
    # only keys of several parts are looked up
    hot = counted.where("splits > 1").select(key, "splits")
    salted = rows.join(hot, key, "left").withColumn("part", (index.home(F.col(key)) + F.pmod(F.xxhash64("id"), F.coalesce("splits", F.lit(1))).cast("int")) % parts).drop("splits")
    salted.repartition(parts, "part").sortWithinPartitions("part", key, "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")


def open_inverted(spark: SparkSession, path: str) -> Inverted:
    about = spark.read.schema("key string, parts int").parquet(f"{path}/about").first()
    return Inverted(spark, path, about.key, about.parts)
