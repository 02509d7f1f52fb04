"""Subscriber state folded from a log of subscribe and unsubscribe events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from impactlens.functions import columns as C
from impactlens.operators.skew import ROWS_PER_TASK, spread_join
from impactlens.storage import durable


def valid_events(log: DataFrame) -> DataFrame:
    """Events with a normalised, valid address."""
    return log.withColumn("email", C.normalise_email(F.col("email"))).filter(C.valid_email(F.col("email")))


def rejected_events(log: DataFrame) -> DataFrame:
    """Events whose address is not one, kept for inspection."""
    return log.withColumn("email", C.normalise_email(F.col("email"))).filter(~C.valid_email(F.col("email")))


def _since_end(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(email, _last, cnt) of every address, and the events with the time of its last unsubscribe, `_last`."""
    events = durable(events.select("email", "action", F.struct("at", "seq").alias("_when")))
    last = durable(
        events.groupBy("email").agg(
            F.max(F.when(F.col("action") == "unsubscribe", F.col("_when"))).alias("_last"), F.count(F.lit(1)).alias("cnt")
        )
    )
    ended = last.filter(F.col("_last").isNotNull()).drop("cnt")
    return last, spread_join(events, ended, "email", "left", counts=last)


def fold(events: DataFrame) -> DataFrame:
    """(email, unsubscribed, created_at) per address in the events.

    created_at is the first subscribe after the last unsubscribe, null if there is none;
    `unsubscribed` tells whether an unsubscribe occurs at all. Two combinable aggregations: an
    address with very many events costs no more than others.
    """
    last, dated = _since_end(events)
    later = dated.filter((F.col("action") == "subscribe") & (F.col("_last").isNull() | (F.col("_when") > F.col("_last"))))
    first = later.groupBy("email").agg(F.min("_when").alias("_first"))
    return last.join(first, "email", "left").select(
        "email", F.col("_last").isNotNull().alias("unsubscribed"), F.col("_first.at").alias("created_at")
    )


def open_events(events: DataFrame) -> DataFrame:
    """The (email, action, at, seq) events that decide the state whatever comes later: the last
    unsubscribe of each address and its subscribes after that."""
    _, dated = _since_end(events)
    after = F.col("_last").isNull() | (F.col("_when") > F.col("_last"))
    kept = dated.filter(((F.col("action") == "subscribe") & after) | ((F.col("action") == "unsubscribe") & (F.col("_when") == F.col("_last"))))
    return kept.select("email", "action", "_when.at", "_when.seq").distinct()


def subscribers(log: DataFrame) -> DataFrame:
    """(email, created_at) of the active subscribers; the first of several subscribes counts."""
    return fold(valid_events(log)).filter(F.col("created_at").isNotNull()).select("email", "created_at")


def active_list(log: DataFrame) -> DataFrame:
    return subscribers(log).select("email").orderBy("email")


def unsubscribe_replies(log: DataFrame, rows_per_slice: int = ROWS_PER_TASK) -> DataFrame:
    """(seq, email, at, reply): what each unsubscribe event answered, 'Unsubscribed' or 'Not found'.

    An address is active exactly if its previous event was a subscribe. The log is cut into time
    slices; a slice sees its own events and takes over the last action before it, so a busy
    address is shared among tasks.
    """
    events = durable(valid_events(log).select("seq", "email", "action", "at"))
    at = F.unix_micros(F.col("at").cast("timestamp"))
    slices = events.count() // rows_per_slice + 1
    # slices of the time line; the number of a slice is its place in it, and stays with the durable rows
    sliced = durable(events.repartitionByRange(slices, at, "seq").withColumn("_slice", F.spark_partition_id()))
    ends = sliced.groupBy("email", "_slice").agg(F.max_by("action", F.struct("at", "seq")).alias("_end"))
    carried = ends.select(
        "email", "_slice", F.lag("_end").over(W.partitionBy("email").orderBy("_slice")).alias("_carried")
    )
    previous = F.lag("action").over(W.partitionBy("email", "_slice").orderBy("at", "seq"))
    return (
        sliced.withColumn("_previous", previous)
        .filter(F.col("action") == "unsubscribe")
        .join(carried, ["email", "_slice"], "left")
        .select(
            "seq", "email", "at",
            F.when(F.coalesce("_previous", "_carried") == "subscribe", "Unsubscribed").otherwise("Not found").alias("reply"),
        )
    )
