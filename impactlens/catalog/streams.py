"""Queries that run the streaming jobs over the given tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.digest import _EVENTS
from impactlens.catalog.registry import query
from impactlens.storage import new_path
from impactlens.streaming import jobs


def _stream(spark, sf, name):
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _files(spark, sf, name, key, batches=3):
    """The table as a stream of three batches, dealt by a hash of the key: rows come in no order of time.

    A file is about as much as a task reads of the table, so no task writes a whole batch.
    """
    rows, path = V.table(spark, sf, name), new_path(spark, "landing")
    each = -(-rows.rdd.getNumPartitions() // batches)
    rows.repartition(batches * each, F.xxhash64(key)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("t1_score_arrivals", "SELECT o_orderkey AS paper_id, round(o_totalprice / 5000, 6) AS score FROM orders")
def t1(spark, sf):
    out = new_path(spark, "scores")
    score = lambda b: b.select(F.col("o_orderkey").alias("paper_id"), F.round(F.col("o_totalprice") / 5000, 6).alias("score"))
    jobs.score_arrivals(_stream(spark, sf, "orders"), score, out, new_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select("paper_id", "score")


@query("t2_fill_cache", "SELECT sha256(text) AS key, CAST(any_value(length(text)) AS VARCHAR) AS payload FROM documents GROUP BY 1")
def t2(spark, sf):
    out = new_path(spark, "cache")
    texts = _files(spark, sf, "documents", "doc_id").select(F.sha2("text", 256).alias("key"), "text")
    compute = lambda b: b.select("key", F.length("text").cast("string").alias("payload"))
    jobs.fill_cache(texts, compute, out, new_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select("key", "payload")


@query(
    "t3_subscriber_stream",
    f"WITH {_EVENTS} SELECT email, min(\"at\") AS created_at FROM marked WHERE era = last_era AND action = 'subscribe' GROUP BY 1",
)
def t3(spark, sf):
    out = new_path(spark, "subscribers")
    log = V.subscription_events(_files(spark, sf, "events", "event_id"))
    jobs.keep_subscribers(log, out, new_path(spark, "ck")).awaitTermination()
    return jobs.current_subscribers(spark, out).filter(F.col("created_at").isNotNull())
