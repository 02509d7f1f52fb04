"""Build a labelled dataset: feed and works in, a partitioned table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.functions import columns as C
from impactlens.operators.labels import label_papers
from impactlens.sources.feed import category_window, dataset_columns
from impactlens.sources.tables import write_dataset
from impactlens.sources.works import one_work_per_paper


def build_dataset(
    feed: DataFrame, works: DataFrame, category: str, start: str, end: str, as_of: str, limit: int | None = None
) -> DataFrame:
    """Parsed feed entries and (paper_key, work_id, counts_by_year) works to labelled papers.

    Dates are parsed and filtered before the join, which is one join on the version-free id
    in place of one request per paper.
    """
    papers = feed.withColumn("published", C.iso_timestamp(F.col("published"))).withColumn(
        "paper_key", C.join_key(F.col("paper_id"))
    )
    chosen = category_window(papers, category, start, end, limit)
    keyed = works.withColumn("paper_key", C.join_key(F.col("paper_key")))
    return dataset_columns(label_papers(chosen, one_work_per_paper(keyed), as_of)).drop("counts_by_year", "paper_key", "updated")


def run(feed: DataFrame, works: DataFrame, path: str, **choice) -> DataFrame:
    """Build and write; returns the row count per publication year."""
    return write_dataset(build_dataset(feed, works, **choice), path)
