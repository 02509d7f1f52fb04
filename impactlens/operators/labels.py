"""Citation labels from yearly counts."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from impactlens.functions import columns as C


def cites_in_year(counts: Column, year: Column) -> Column:
    """Citations entered for a year: the last entry wins, a missing entry or count is 0."""
    entries = F.filter(counts, lambda c: c["year"] == year)
    last = F.try_element_at(entries, F.lit(-1))["cited_by_count"]
    return F.when(year == 0, F.lit(0)).otherwise(F.coalesce(last, F.lit(0))).cast("long")


def mature(published: Column, as_of: str, horizon: int) -> Column:
    """True once the whole days since publication reach the horizon (12 months = 365 days).

    Compared against one constant, so the condition can be pushed into the scan.
    """
    days = ceil(horizon * 365 / 12)
    return published <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def calendar_label(counts: Column, published: Column, as_of: str, horizon: int = 12) -> Column:
    """Citations of the submission year and the ceil(horizon/12) years after it.

    Null without counts or before maturity; counts that miss those years give 0.
    """
    year = F.year(published)
    total = cites_in_year(counts, year)
    for offset in range(1, ceil(horizon / 12) + 1):
        total = total + cites_in_year(counts, year + offset)
    return F.when((F.coalesce(F.size(counts), F.lit(0)) > 0) & mature(published, as_of, horizon), total)


def prorated_label(counts: Column, published: Column, as_of: str, horizon: int) -> Column:
    """Citations within `horizon` months, each year's count spread evenly over its open months.

    The submission year is open from the submission month on, later years for twelve months.
    """
    year, open_months = F.year(published), F.lit(13) - F.month(published)
    total = cites_in_year(counts, year) * F.least(F.lit(1.0), F.lit(float(horizon)) / open_months)
    for offset in range(1, ceil(horizon / 12) + 1):
        left = F.lit(float(horizon)) - open_months - 12 * (offset - 1)
        share = F.least(F.greatest(left, F.lit(0.0)), F.lit(12.0)) / 12
        total = total + cites_in_year(counts, year + offset) * share
    return F.when((F.coalesce(F.size(counts), F.lit(0)) > 0) & mature(published, as_of, horizon), total)


def enrich(papers: DataFrame, works: DataFrame, key: str = "paper_key") -> DataFrame:
    """Each paper with its work; one join instead of one request per paper."""
    return papers.join(works, key, "left")


def label_papers(
    papers: DataFrame, works: DataFrame, as_of: str, horizon: int = 12, name: str = "y12", key: str = "paper_key"
) -> DataFrame:
    """Enrich, label, and keep the labelled papers (0 is a label, null is not)."""
    labelled = enrich(papers, works, key).withColumn(
        name, calendar_label(F.col("counts_by_year"), F.col("published"), as_of, horizon)
    )
    return drop_unlabelled(labelled, name)


def label_from_long_counts(
    papers: DataFrame, yearly: DataFrame, as_of: str, horizon: int = 12, name: str = "y12", key: str = "paper_id"
) -> DataFrame:
    """As label_papers, straight from (key, year, cited_by_count) rows: the aggregate needs no arrays.

    Copies of a paper get the same label. Of several rows for one year the last by `entry` wins, if
    there is such a column, else the one with the largest count.
    """
    ready = papers.filter(mature(F.col("published"), as_of, horizon)).withColumn("_first", F.year("published"))
    order = F.struct("entry", "cited_by_count") if "entry" in yearly.columns else F.col("cited_by_count")
    counted = F.col("year").between(F.col("_first"), F.col("_first") + ceil(horizon / 12))
    labels = (
        yearly.join(ready.select(key, "_first").distinct(), key)
        .groupBy(key, "_first", "year")  # the join has brought a key together: no further shuffle
        .agg(F.max_by(F.coalesce("cited_by_count", F.lit(0)), order).alias("_c"))
        .groupBy(key, "_first")
        .agg(F.sum(F.when(counted, F.coalesce("_c", F.lit(0))).otherwise(0)).cast("long").alias(name))
    )
    return ready.join(labels, [key, "_first"]).select(*papers.columns, name)


def drop_unlabelled(df: DataFrame, name: str = "y12") -> DataFrame:
    return df.filter(F.col(name).isNotNull())


def with_horizons(df: DataFrame, as_of: str, horizons: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """y{h}_calendar and y{h}_prorated for each horizon; the suffix says how yearly counts were cut."""
    counts, published = F.col("counts_by_year"), F.col("published")
    return df.withColumns(
        {
            **{f"y{h}_calendar": calendar_label(counts, published, as_of, h) for h in horizons},
            **{f"y{h}_prorated": prorated_label(counts, published, as_of, h) for h in horizons},
        }
    )
