"""Queries over cohorts, ranks and top-k lists, and the flagship question."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.labels import _NORMALISED, labelled
from impactlens.catalog.registry import query
from impactlens.operators import cohorts, normalise, ranking
from impactlens.storage import durable

_WEEK = "strftime(date_trunc('week', published), '%Y-%m-%d')"


def _groups(key: str) -> str:
    return f"""WITH {V.PAPERS} SELECT cohort, group_size, CAST(row_number() OVER (ORDER BY cohort) - 1 AS INTEGER) AS group_id
FROM (SELECT {key} AS cohort, count(*) AS group_size FROM papers GROUP BY 1)"""


@query("w1_a7_week_groups", _groups(_WEEK))
def w1(spark, sf):
    return cohorts.cohort_sizes(cohorts.with_cohort(V.papers(spark, sf)))


@query("w2_category_groups", _groups("coalesce(primary_cat, '(none)')"))
def w2(spark, sf):
    return cohorts.cohort_sizes(cohorts.with_cohort(V.papers(spark, sf), "category"))


@query("w3_single_group", _groups("'all'"))
def w3(spark, sf):
    return cohorts.cohort_sizes(cohorts.with_cohort(V.papers(spark, sf), "none"))


_RANKS = f"""{V.RANKED}, ranks AS (
  SELECT *, CAST(rank() OVER (ORDER BY y_pred DESC) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS DOUBLE) AS impact_rank,
    count(*) OVER () AS n FROM ranked)"""
_PERCENTILE = "round(CAST(n - impact_rank + 1 AS DOUBLE) / n * 100, 9) AS impact_percentile"


@query("w4_w6_impact_rank", f"WITH {_RANKS} SELECT paper_id, y_pred, impact_rank, {_PERCENTILE} FROM ranks")
def w4(spark, sf):
    ranked = ranking.impact_rank(V.ranked(spark, sf), "y_pred")
    return ranked.select("paper_id", "y_pred", "impact_rank", F.round("impact_percentile", 9).alias("impact_percentile"))


@query(
    "w4_w6_rank_with_unscored",
    f"""WITH {V.RANKED}, partly AS (SELECT paper_id, CASE WHEN paper_id % 5 <> 0 THEN y_pred END AS y_pred FROM ranked), ranks AS (
  SELECT *, CASE WHEN y_pred IS NOT NULL THEN CAST(rank() OVER (ORDER BY y_pred DESC NULLS LAST) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS DOUBLE) END AS impact_rank,
    count(*) OVER () AS n FROM partly)
SELECT paper_id, impact_rank, {_PERCENTILE} FROM ranks""",
)
def w4_unscored(spark, sf):
    """Papers without a score have no rank, and count in the percentile of the others."""
    some = V.ranked(spark, sf).withColumn("y_pred", F.when(F.col("paper_id") % 5 != 0, F.col("y_pred")))
    ranked = ranking.impact_rank(durable(some.select("paper_id", "y_pred")), "y_pred")
    return ranked.select("paper_id", "impact_rank", F.round("impact_percentile", 9).alias("impact_percentile"))


@query(
    "w5_top_by_impact",
    f"""WITH {_RANKS} SELECT paper_id, title, primary_cat, y_pred AS predicted_citations, impact_rank, {_PERCENTILE}
FROM ranks ORDER BY impact_rank, paper_id LIMIT 50""",
)
def w5(spark, sf):
    scored = V.ranked(spark, sf).withColumnRenamed("y_pred", "predicted_citations")
    return ranking.top_by_impact(scored, 50).select(
        "paper_id", "title", "primary_cat", "predicted_citations", "impact_rank",
        F.round("impact_percentile", 9).alias("impact_percentile"),
    )


@query(
    "w10_top_daily",
    f"""WITH {V.RANKED} SELECT day, paper_id, y_pred, position FROM (
  SELECT CAST(published AS DATE) AS day, paper_id, y_pred,
    CAST(row_number() OVER (PARTITION BY CAST(published AS DATE) ORDER BY y_pred DESC, paper_id) AS INTEGER) AS position FROM ranked)
WHERE position <= 3""",
)
def w10(spark, sf):
    daily = V.ranked(spark, sf).withColumn("day", F.to_date("published"))
    return ranking.top_per_group(daily, "day", 3, "y_pred").select("day", "paper_id", "y_pred", "position")


def flagship_query(spark, sf):
    """In each weekly cohort, which three papers beat their field and year most?"""
    papers = durable(labelled(spark, sf).select("paper_id", "published", "primary_cat", "y12"))
    scored = durable(normalise.normalise_by_field(papers))
    ranked = cohorts.with_cohort(ranking.impact_rank(scored, "y12_normalized"))
    best = ranking.top_per_group(ranked, "cohort", 3, "y12_normalized")
    return best.select(
        "cohort", "position", "paper_id", "primary_cat", "y12",
        F.round("y12_normalized", 9).alias("y12_normalized"), "impact_rank",
        F.round("impact_percentile", 9).alias("impact_percentile"),
    )


query(
    "flagship_week_leaders",
    f"""WITH {_NORMALISED}, ranks AS (
  SELECT *, CAST(rank() OVER (ORDER BY y12_normalized DESC) + (count(*) OVER (PARTITION BY y12_normalized) - 1) / 2.0 AS DOUBLE) AS impact_rank,
    count(*) OVER () AS n, {_WEEK} AS cohort,
    CAST(row_number() OVER (PARTITION BY {_WEEK} ORDER BY y12_normalized DESC, paper_id) AS INTEGER) AS position FROM normalised)
SELECT cohort, position, paper_id, primary_cat, y12, round(y12_normalized, 9) AS y12_normalized, impact_rank, {_PERCENTILE}
FROM ranks WHERE position <= 3""",
)(flagship_query)
