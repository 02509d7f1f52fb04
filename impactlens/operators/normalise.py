"""Field and year baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.operators.ordering import quantiles
from impactlens.operators.skew import spread_join
from impactlens.storage import durable

EPSILON = 0.1  # fixed value: added to the median


def field_year_medians(df: DataFrame, target: str = "y12", approximate: bool = False) -> DataFrame:
    """(primary_cat, pub_year, median, n); null fields or years form no group.

    `approximate` trades exactness for a sketch and is never the default.
    """
    keyed = df.select("primary_cat", "pub_year", target).dropna()
    if approximate:
        return keyed.groupBy("primary_cat", "pub_year").agg(
            F.percentile_approx(target, 0.5, 10_000).cast("double").alias("median"), F.count(F.lit(1)).alias("n")
        )
    return quantiles(keyed, target, {"median": 0.5}, ("primary_cat", "pub_year"))


def normalise_by_field(df: DataFrame, target: str = "y12") -> DataFrame:
    """Add pub_year and `<target>_normalized` = target / (field-year median + 0.1), 0.0 without field or year."""
    df = df.withColumn("pub_year", F.year("published"))
    group = F.struct("primary_cat", "pub_year")
    medians = durable(field_year_medians(df, target).select(group.alias("_group"), "median", F.col("n").alias("cnt")))
    keyed = df.withColumn("_group", F.when(F.col("primary_cat").isNotNull() & F.col("pub_year").isNotNull(), group))
    ratio = F.col(target).cast("double") / (F.coalesce("median", F.lit(1.0)) + EPSILON)
    return (
        spread_join(keyed, medians.drop("cnt"), "_group", "left", counts=medians)
        .withColumn(f"{target}_normalized", F.when(F.col("_group").isNull(), F.lit(0.0)).otherwise(ratio))
        .drop("_group", "median")
    )


def field_weighted_impact(df: DataFrame, target: str = "y12") -> DataFrame:
    """Add fwci = citations / mean citations of the same field and year (null where that mean is 0)."""
    df = df.withColumn("pub_year", F.year("published"))
    group = F.struct("primary_cat", "pub_year")
    means = durable(
        df.dropna(subset=["primary_cat", "pub_year"])
        .groupBy(group.alias("_group"))
        .agg(F.avg(target).alias("expected"), F.count(F.lit(1)).alias("cnt"))
    )
    return (
        spread_join(df.withColumn("_group", group), means.drop("cnt"), "_group", "left", counts=means)
        .withColumn("fwci", F.col(target).cast("double") / F.nullif(F.col("expected"), F.lit(0.0)))
        .drop("_group")
    )


def dataset_summary(df: DataFrame, *measures: str) -> DataFrame:
    """One row: paper count and the mean of each measure."""
    return df.agg(F.count(F.lit(1)).alias("n_papers"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
