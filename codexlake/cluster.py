"""Session helpers: package shipping, shared scratch space and durable cuts of lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: How often the driver is asked to collect, at most.
SWEEP_SECONDS = 4
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per Spark application.

    The zip is served by Spark's own file server, so executors need no shared folder for it.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codexlake-")) / "codexlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. Where it is unset, a local session gets one of its own; a cluster is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codexlake-ckpt-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, for tables that a result still reads; `release` removes it, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_release_at_exit)
    _SCRATCH.append((spark, path))
    return path


def release() -> None:
    """Remove all scratch folders. Results that read them must have been written or collected before."""
    while _SCRATCH:
        delete_path(*_SCRATCH.pop())


def _release_at_exit() -> None:
    # the session may be gone by then
    with contextlib.suppress(Exception):
        release()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: later steps read only the columns that they need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows with a broadcast hint if they are `most` at most, else as they are. They are counted, as what Spark expects of a computed table may be far off."""
    return broadcast(df) if df.limit(most + 1).count() <= most else df


_SWEPT = [0.0]


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; survives the loss of executors.

    Spark deletes shuffle files once the driver's collector finds nothing that refers to them. On a driver
    with little to collect that may be long after a cut, so it is asked for every few seconds here.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if time.monotonic() - _SWEPT[0] > SWEEP_SECONDS:
        df.sparkSession.sparkContext._jvm.System.gc()
        _SWEPT[0] = time.monotonic()
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
