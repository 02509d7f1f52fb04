"""Exact positions, ranks and quantiles without sorting a whole group in one task.

Values are first counted per group, so ties, however many rows they cover, are a single counted
row. The distinct values are dealt to sorted ranges of a size one task handles; windows run inside
one range, and per-range totals give the offset. One path for every size and every orderable type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from impactlens.operators.skew import ROWS_PER_TASK, spread_join
from impactlens.storage import durable


def ordered_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    rows_per_range: int = ROWS_PER_TASK,
) -> DataFrame:
    """(by..., value, cnt, before, total) per distinct non-null value.

    `before` counts the rows of the group with a smaller value. Rows with a null group key are left
    out. `weight` names a column of multiplicities if the input is counted already.
    """
    by = list(by)
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = durable(df.dropna(subset=[*by, value]).groupBy(*by, value).agg(size.alias("cnt")))
    none = F.lit(0).cast("long")
    ranges = counts.count() // rows_per_range + 1
    # the number of a range is its place in the order, and stays with the rows once they are durable
    ranged = durable(counts.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id()))
    # one row per group and range that holds it
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("cnt").alias("_in"))
        .withColumn(
            "_offset",
            F.sum("_in").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
        )
        .withColumn("total", F.sum("_in").over(W.partitionBy(*by)))
        .drop("_in")
    )
    ascending = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce("_offset", none) + F.coalesce(F.sum("cnt").over(ascending), none)
    return ranged.join(offsets, [*by, "_range"]).select(*by, value, "cnt", before.alias("before"), "total")


def average_rank(descending: bool = False) -> Column:
    """Rank with ties averaged, over the columns of ordered_counts."""
    half = (F.col("cnt").cast("double") + 1) / 2
    if descending:
        return F.col("total") - F.col("before") - F.col("cnt") + half
    return F.col("before") + half


def quantiles(
    df: DataFrame, value: str, at: dict[str, float], by: Sequence[str] = (), **options: int
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of `at`, and `n`."""
    by = list(by)
    counts = ordered_counts(df, value, by, **options)
    aggs: list[Column] = [F.first("total").alias("n")]
    for name, q in at.items():
        position = (F.col("total") - 1) * F.lit(float(q))
        for end, where in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            inside = (F.col("before") <= where) & (where < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{end}"))
    grouped = counts.groupBy(*by).agg(*aggs)
    for name, q in at.items():
        position = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        grouped = grouped.withColumn(name, lo + (position - F.floor(position)) * (hi - lo))
    return grouped.select(*by, "n", *at)


def with_average_rank(
    df: DataFrame, value: str, name: str, descending: bool = False, **options: int
) -> DataFrame:
    """Every row with its tie-averaged rank over the whole table, and `total`. Null values get null.

    Reads `df` twice: hand it over durable if it is costly to compute.
    """
    counts = ordered_counts(df, value, **options)
    ranks = counts.select(value, average_rank(descending).alias(name), "total")
    return spread_join(df, ranks, value, "left", counts=counts.select(value, "cnt"))
