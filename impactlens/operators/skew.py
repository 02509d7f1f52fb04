"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.storage import new_path

# Rows of one key a task takes on; a key with more is split into slots of about this size, at any
# size of the table.
ROWS_PER_TASK = 1_000_000
# Entries of lists shuffled at once: work with more is done in rounds, each of which clears its disk.
ENTRIES_AT_ONCE = 1 << 31


def dealt_out(df: DataFrame) -> DataFrame:
    """Rows that fewer tasks than there are cores would read, dealt to all of them; a larger input as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def count_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, cnt); counted map-side first, so a hot key costs nothing here."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def hot_keys(counts: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """(key, _slots) of the hot keys in a (key, cnt) table, or None if no key is hot.

    It is written as a table, so that its size is known where it is joined: Spark broadcasts it below
    spark.sql.autoBroadcastJoinThreshold and else joins it as any other table.
    """
    slots = F.ceil(F.col("cnt") / rows_per_task).cast("int").alias("_slots")
    hot = counts.filter(F.col(key).isNotNull() & (F.col("cnt") > rows_per_task)).select(key, slots)
    path = new_path(counts.sparkSession, "hot-keys")
    hot.write.parquet(path)
    hot = counts.sparkSession.read.schema(hot.schema).parquet(path)
    return hot if hot.limit(1).count() else None


def assign_slot(df: DataFrame, hot: DataFrame | None, key: str, slot: str = "_slot") -> DataFrame:
    """Put each row of a hot key into one of its slots; the hash makes retries repeatable.

    Without hot keys the rows are left as they are, and slot_keys names the plain key.
    """
    if hot is None:
        return df
    others = [c for c in df.columns if c != key] or [key]
    # a null key matches nothing wherever it lands, so those rows are spread over all partitions
    spread = F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slots = F.when(F.col(key).isNull(), spread).otherwise(F.coalesce(F.col("_slots"), F.lit(1)))
    return df.join(hot, key, "left").withColumn(slot, F.pmod(F.hash(*others), slots)).drop("_slots")


def fan_out(df: DataFrame, hot: DataFrame | None, key: str, slot: str = "_slot") -> DataFrame:
    """Copy the rows of hot keys into every slot of the key."""
    if hot is None:
        return df
    return (
        df.join(hot, key, "left")
        .withColumn(slot, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1)))
        .drop("_slots")
    )


def spread_join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, **limits
) -> DataFrame:
    """spread_join on several keys. The right side must have no null keys (they would match nulls)."""
    packed = F.struct(*keys).alias("_key")
    return spread_join(
        left.select("*", packed),
        right.select(packed, *[c for c in right.columns if c not in keys]),
        "_key",
        how,
        None if counts is None else counts.select(packed, "cnt"),
        **limits,
    ).drop("_key")


def slot_keys(hot: DataFrame | None, key: str, slot: str = "_slot") -> list[str]:
    return [key] if hot is None else [key, slot]


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join in which no task gets many more than `rows_per_task` rows of one left key.

    Every left row sits in exactly one slot and meets all right rows of its key there, so
    inner, left, left_semi and left_anti joins give the plain result. Pass `counts` (key, cnt) of
    the left side where they are known already; otherwise they are counted first.
    """
    hot = hot_keys(count_keys(left, key) if counts is None else counts, key, rows_per_task)
    return assign_slot(left, hot, key).join(fan_out(right, hot, key), slot_keys(hot, key), how).drop("_slot")
