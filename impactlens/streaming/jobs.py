"""Score new papers, fill caches and keep subscriber state as files arrive.

Every batch writes to a folder named by its id and replaces it on a retry, so a batch that ran
twice leaves the same result as one that ran once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from impactlens.operators import subscribers

CACHE = "key STRING, payload STRING"
EVENTS = "email STRING, action STRING, at TIMESTAMP_NTZ, seq BIGINT"


def written_batches(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Ids of the batches written in full so far (those before `before`, for a batch that is run again)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("batch=")))
    return sorted(b for b in found if before is None or b < before)


def _read(spark: SparkSession, path: str, schema: str, batches: list[int]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/batch={b}" for b in batches])


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_arrivals(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Apply a model to newly landed papers; results in <path>/batch=<id>."""

    def each(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _run(stream, checkpoint, each)


def fill_cache(
    stream: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Compute what the cache does not hold yet, each key once; `stream` is (key, text)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _read(spark, path, CACHE, written_batches(spark, path, batch_id))
        wanted = batch.groupBy("key").agg(F.min("text").alias("text")).join(known.select("key"), "key", "left_anti")
        compute(wanted).select("key", "payload").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _run(stream, checkpoint, each)


def _open_events(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest snapshot: the events that can still matter."""
    return _read(spark, path, EVENTS, written_batches(spark, path, before)[-1:])


def current_subscribers(spark: SparkSession, path: str) -> DataFrame:
    """(email, created_at) of every address seen; null created_at is inactive."""
    return subscribers.fold(_open_events(spark, path)).select("email", "created_at")


def keep_subscribers(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep, for each address, its last unsubscribe and the subscribes after it, as one snapshot per batch.

    Nothing older can matter again, and nothing else is needed: events may come late and in any
    order. A batch reads the newest snapshot before it and no earlier ones. The last unsubscribe is
    found map-side, so one busy address does not hold up a batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = subscribers.valid_events(batch).select("email", "action", F.col("at").cast("timestamp_ntz").alias("at"), "seq")
        events = _open_events(spark, path, batch_id).unionByName(new)
        subscribers.open_events(events).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _run(stream, checkpoint, each)
