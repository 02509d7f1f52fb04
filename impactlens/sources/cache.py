"""Content-keyed caches as tables: what is known, what is still to be fetched or computed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.operators.skew import spread_join


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Each uncached key once, with one deterministic representative of its requests: the first in the order of the columns."""
    others = [c for c in requests.columns if c != key]
    first = requests.groupBy(key).agg(F.min(F.struct(*others)).alias("_first")) if others else None
    wanted = first.select(key, "_first.*") if others else requests.select(key).distinct()
    return wanted.join(cache.filter(F.col("payload").isNotNull()).select(key), key, "left_anti")


def hits(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests answered from the cache. An entry without a readable payload is a miss."""
    return spread_join(requests, cache.filter(F.col("payload").isNotNull()).select(key, "payload"), key)


def append(computed: DataFrame, path: str, namespace: str) -> None:
    """Add computed (key, payload, fetched_at) rows to the cache table."""
    (
        computed.select(F.lit(namespace).alias("namespace"), "key", "payload", "fetched_at")
        .write.mode("append").partitionBy("namespace").parquet(path)
    )
