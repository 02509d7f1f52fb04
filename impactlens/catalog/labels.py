"""Queries over labels, joins and normalised targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.registry import query
from impactlens.operators import labels, normalise
from impactlens.sources import works


def works_table(spark, sf):
    counted = works.works_from_counts(V.yearly(spark, sf), "paper_id")
    return counted.withColumn("work_id", F.concat(F.lit("W"), F.col("paper_id")))


def labelled(spark, sf):
    return labels.label_from_long_counts(V.papers(spark, sf), V.yearly(spark, sf), V.AS_OF)


@query(
    "j1_enrich_papers",
    f"""WITH {V.PAPERS}, {V.YEARLY} SELECT p.paper_id, CASE WHEN count(y.year) > 0 THEN 'W' || p.paper_id END AS work_id,
  nullif(count(y.year), 0) AS n_years FROM papers p LEFT JOIN yearly y ON y.paper_id = p.paper_id GROUP BY p.paper_id""",
)
def j1(spark, sf):
    rows = labels.enrich(V.papers(spark, sf), works_table(spark, sf), "paper_id")
    n = F.when(F.col("counts_by_year").isNotNull(), F.size("counts_by_year")).cast("long")
    return rows.select("paper_id", "work_id", n.alias("n_years"))


@query("j2_label_12m", f"WITH {V.LABELLED} SELECT paper_id, published, y12 FROM labelled")
def j2(spark, sf):
    return labels.label_papers(V.papers(spark, sf), works_table(spark, sf), V.AS_OF, key="paper_id").select(
        "paper_id", "published", "y12"
    )


@query("j2_label_12m_long", f"WITH {V.LABELLED} SELECT paper_id, published, y12 FROM labelled")
def j2_long(spark, sf):
    return labelled(spark, sf).select("paper_id", "published", "y12")


@query(
    "j2_label_12m_copies",
    f"""WITH {V.LABELLED}, copies AS (SELECT unnest([1, 2]) AS copy) SELECT paper_id, copy, y12 FROM labelled, copies
WHERE copy = 1 OR paper_id % 3 = 0""",
)
def j2_copies(spark, sf):
    """Copies of a paper and a smaller earlier row for a year change no label."""
    papers, yearly = V.papers(spark, sf), V.yearly(spark, sf)
    once = papers.withColumn("copy", F.lit(1))
    twice = once.unionByName(papers.filter("paper_id % 3 = 0").withColumn("copy", F.lit(2)))
    stale = yearly.withColumn("cited_by_count", F.col("cited_by_count") - 1).filter("paper_id % 2 = 0")
    return labels.label_from_long_counts(twice, yearly.unionByName(stale), V.AS_OF).select("paper_id", "copy", "y12")


def _horizon_sql(h: int) -> str:
    days = {6: 183, 12: 365, 24: 730}[h]
    spill = -(-h // 12)
    mature = f"p.published <= TIMESTAMP '{V.AS_OF} 00:00:00' - INTERVAL {days} DAY AND count(y.year) > 0"
    calendar = f"sum(CASE WHEN y.year BETWEEN year(p.published) AND year(p.published) + {spill} THEN y.cited_by_count ELSE 0 END)"
    open_months = "(13 - month(p.published))"
    share = f"""CASE WHEN y.year = year(p.published) THEN least(1.0::DOUBLE, {h}.0::DOUBLE / {open_months})
      WHEN y.year BETWEEN year(p.published) + 1 AND year(p.published) + {spill}
      THEN least(greatest({h}.0::DOUBLE - {open_months} - 12 * (y.year - year(p.published) - 1), 0.0::DOUBLE), 12.0::DOUBLE) / 12
      ELSE 0.0::DOUBLE END"""
    return f"""CASE WHEN {mature} THEN CAST({calendar} AS BIGINT) END AS y{h}_calendar,
  CASE WHEN {mature} THEN round(sum(CAST(y.cited_by_count AS DOUBLE) * ({share})), 6) END AS y{h}_prorated"""


@query(
    "j3_label_horizons",
    f"""WITH {V.PAPERS}, {V.YEARLY} SELECT p.paper_id, {", ".join(_horizon_sql(h) for h in (6, 12, 24))}
FROM papers p LEFT JOIN yearly y ON y.paper_id = p.paper_id GROUP BY p.paper_id, p.published""",
)
def j3(spark, sf):
    rows = labels.with_horizons(labels.enrich(V.papers(spark, sf), works_table(spark, sf), "paper_id"), V.AS_OF)
    out = ["paper_id"]
    for h in (6, 12, 24):
        out += [f"y{h}_calendar", F.round(f"y{h}_prorated", 6).alias(f"y{h}_prorated")]
    return rows.select(*out)


@query(
    "a5_field_year_median",
    f"""WITH {V.LABELLED} SELECT primary_cat, CAST(year(published) AS INTEGER) AS pub_year, CAST(median(y12) AS DOUBLE) AS median, count(*) AS n
FROM labelled GROUP BY 1, 2""",
)
def a5(spark, sf):
    return normalise.field_year_medians(labelled(spark, sf).withColumn("pub_year", F.year("published")))


_NORMALISED = f"""{V.LABELLED}, normalised AS (
  SELECT l.*, CAST(year(published) AS INTEGER) AS pub_year,
    CAST(y12 AS DOUBLE) / (CAST(median(y12) OVER (PARTITION BY primary_cat, year(published)) AS DOUBLE) + 0.1::DOUBLE) AS y12_normalized
  FROM labelled l)"""


@query(
    "a6_j5_field_normalised",
    f"WITH {_NORMALISED} SELECT paper_id, pub_year, y12, round(y12_normalized, 9) AS y12_normalized FROM normalised",
)
def a6(spark, sf):
    return normalise.normalise_by_field(labelled(spark, sf)).select(
        "paper_id", "pub_year", "y12", F.round("y12_normalized", 9).alias("y12_normalized")
    )


@query(
    "a8_dataset_summary",
    f"WITH {V.LABELLED} SELECT count(*) AS n_papers, round(avg(y12), 6) AS mean_y12, round(avg(price), 6) AS mean_price FROM labelled",
)
def a8(spark, sf):
    return normalise.dataset_summary(labelled(spark, sf), "y12", "price").select(
        "n_papers", F.round("mean_y12", 6).alias("mean_y12"), F.round("mean_price", 6).alias("mean_price")
    )


@query(
    "a15_fwci",
    f"""WITH {V.LABELLED} SELECT paper_id, round(avg(y12) OVER w, 6) AS expected, round(CAST(y12 AS DOUBLE) / nullif(avg(y12) OVER w, 0), 6) AS fwci
FROM labelled WINDOW w AS (PARTITION BY primary_cat, year(published))""",
)
def a15(spark, sf):
    return normalise.field_weighted_impact(labelled(spark, sf)).select(
        "paper_id", F.round("expected", 6).alias("expected"), F.round("fwci", 6).alias("fwci")
    )
