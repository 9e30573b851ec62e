"""A table in parts, of which a change rewrites only the parts that it touches.

Rows lie under `data/version=N/part=P`. A manifest for each version names the version that holds each part, so a
version is there once its manifest is whole, readers of an older one are not disturbed, and a version that is written
again after a failure replaces itself. There are as many manifest rows as parts; only these reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.cluster import delete_path


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions at a path, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(hadoop.Path(f"{path}/manifest/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def manifest(spark: SparkSession, path: str, version: int) -> dict[str, int]:
    """Which version holds each part."""
    rows = spark.read.schema("part string, held bigint").parquet(f"{path}/manifest/version={version}")
    return {r.part: r.held for r in rows.collect()}


def read_version(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None, parts: set[str] | None = None) -> DataFrame:
    """The newest whole version, or a given one; of all parts or of some. With a schema, nothing at all gives no rows."""
    there = versions(spark, path)
    held = manifest(spark, path, there[-1] if version is None else version) if there else {}
    files = [f"{path}/data/version={v}/part={p}" for p, v in sorted(held.items()) if parts is None or p in parts]
    if not files and schema:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*files)


def write_version(rows: DataFrame, path: str, version: int, touched: set[str], keep: int = 2) -> None:
    """Make `rows`, with a string column `part`, all that the touched parts hold; other parts stay where they lie.

    The version before is the newest whole one below `version`. Parts that are touched and have no rows go. What
    only versions older than the last `keep` hold is removed.
    """
    spark = rows.sparkSession
    before = [v for v in versions(spark, path) if v < version]
    held = manifest(spark, path, before[-1]) if before else {}
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={version}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = {f.getPath().getName().split("=", 1)[1] for f in store.globStatus(hadoop.Path(f"{path}/data/version={version}/part=*")) or []}
    held = {p: v for p, v in held.items() if p not in touched} | {p: version for p in written}
    spark.createDataFrame(list(held.items()), "part string, held bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    old, kept = [*before, version][:-keep], [*before, version][-keep:]
    if old:
        used = {x for v in kept for x in manifest(spark, path, v).items()}
        for v in old:
            for p, at in set(manifest(spark, path, v).items()) - used:
                delete_path(spark, f"{path}/data/version={at}/part={p}")
            delete_path(spark, f"{path}/manifest/version={v}")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is greatest by `order`, then by all columns; combined before the shuffle, so a hot key is no task's burden."""
    best = F.max_by(F.struct(*rows.columns), F.struct(order, *rows.columns))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("row")).select("row.*")


def digest(rows: DataFrame) -> str:
    """A digest of all rows in whatever order: how many there are, and sums of two hashes of each. Repeated rows count."""
    named = rows.select(*(F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).alias(f"h{seed}") for seed in (1, 2)))
    r = named.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in named.columns)).first()
    return f"{r.n}:{r.h1}:{r.h2}"


def write_snapshot(rows: DataFrame, path: str, version: int, buckets: int = 16) -> bool:
    """Make the rows all that the table holds, as a version; if the newest version below it has the same rows, nothing is written. Whether it was."""
    spark = rows.sparkSession
    now = digest(rows)
    before = [v for v in versions(spark, path) if v < version]
    if before and spark.read.schema("digest string").parquet(f"{path}/digest/version={before[-1]}").first().digest == now:
        return False
    spark.createDataFrame([(now,)], "digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/digest/version={version}")
    touched = set(manifest(spark, path, before[-1])) if before else set()
    part = F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(buckets)).cast("string")
    write_version(rows.withColumn("part", part).repartition("part"), path, version, touched | {str(k) for k in range(buckets)})
    return True
