"""Where intermediate results are made durable."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting for deleting what a query shuffled when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder; on a cluster a folder of one
    machine would be lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="impactlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What the queries run inside shuffle is deleted as each ends, not when the driver's memory is next cleaned."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Compute once, keep on shared storage, and cut the lineage there."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        kept = df.select("*").checkpoint(eager=True)  # a query of its own: when one is planned decides what it deletes
    kept._kept_at = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    return kept


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute once and keep as Parquet on shared storage: for tables whose plain rows would fill the disk."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def is_kept(df: DataFrame) -> bool:
    """Whether this is a table that `durable` or `stored` gave back, as it stands."""
    return getattr(df, "_kept_at", None) is not None


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `durable` or `stored` gave back and nothing reads any more; others are left alone."""
    for df in tables:
        if is_kept(df):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
