"""Queries over evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.registry import query
from impactlens.functions import columns as C
from impactlens.operators import cohorts, metrics
from impactlens.operators.normalise import normalise_by_field
from impactlens.storage import durable


def _weekly(spark, sf):
    return cohorts.with_cohort(V.ranked(spark, sf))


@query(
    "e1_spearman",
    f"""WITH {V.RANKED}, r AS (
  SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rt,
         rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS rp FROM ranked)
SELECT 'spearman_overall' AS metric, round(corr(rt, rp), 9) AS value, 'ok' AS status FROM r""",
)
def e1(spark, sf):
    return metrics.spearman(V.ranked(spark, sf)).withColumn("value", F.round("value", 9))


# dcg: tie-averaged by prediction; ideal: by truth. @group is the cohort expression.
_NDCG = """base AS (SELECT @group AS cohort, y_true, y_pred, paper_id FROM ranked),
k AS (SELECT unnest([10, 20, 50]) AS k),
pos AS (
  SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY y_pred DESC, paper_id) AS p,
    row_number() OVER (PARTITION BY cohort ORDER BY y_true DESC, paper_id) AS t,
    avg(y_true) OVER (PARTITION BY cohort, y_pred) AS shared, count(*) OVER (PARTITION BY cohort) AS n FROM base),
per AS (
  SELECT cohort, k, any_value(n) AS n,
    sum(CASE WHEN p <= k THEN shared / log2(1 + p) ELSE 0 END) AS dcg,
    sum(CASE WHEN t <= k THEN y_true / log2(1 + t) ELSE 0 END) AS ideal
  FROM pos, k GROUP BY 1, 2)"""
_WEEK = "strftime(date_trunc('week', published), '%Y-%m-%d')"


@query(
    "e2_ndcg_single_list",
    f"""WITH {V.RANKED}, {_NDCG.replace("@group", "'all'")}
SELECT 'ndcg' AS metric, k, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS value FROM per WHERE k = 20""",
)
def e2(spark, sf):
    return metrics.ndcg_at_k(V.ranked(spark, sf), 20).withColumn("value", F.round("value", 9))


@query(
    "e3_ndcg_per_cohort",
    f"""WITH {V.RANKED}, {_NDCG.replace("@group", _WEEK)}
SELECT cohort, k, n, round(coalesce(dcg / nullif(ideal, 0), 0), 9) AS ndcg FROM per""",
)
def e3(spark, sf):
    return metrics.ndcg_per_group(_weekly(spark, sf), ["cohort"]).select("cohort", "k", "n", F.round("ndcg", 9).alias("ndcg"))


@query(
    "e3_e4_a10_mean_ndcg",
    f"""WITH {V.RANKED}, {_NDCG.replace("@group", _WEEK)}
SELECT 'ndcg' AS metric, k, round(coalesce(avg(coalesce(dcg / nullif(ideal, 0), 0)) FILTER (n >= k), 0), 9) AS value,
  CASE WHEN count(*) FILTER (n >= k) = 0 THEN 'no cohort' ELSE 'ok' END AS status,
  count(*) FILTER (n >= k) AS n_cohorts FROM per GROUP BY k""",
)
def e4(spark, sf):
    return metrics.mean_cohort_ndcg(_weekly(spark, sf)).withColumn("value", F.round("value", 9))


@query(
    "e5_j8_precision_at_k",
    f"""WITH {V.RANKED}, k AS (SELECT unnest([10, 20, 50]) AS k), pos AS (
  SELECT row_number() OVER (ORDER BY y_pred DESC, paper_id) AS p, row_number() OVER (ORDER BY y_true DESC, paper_id) AS t FROM ranked)
SELECT 'precision' AS metric, k, CASE WHEN (SELECT count(*) FROM ranked) >= k
  THEN sum(CASE WHEN p <= k AND t <= k THEN 1 ELSE 0 END)::DOUBLE / k ELSE 0 END AS value FROM pos, k GROUP BY k""",
)
def e5(spark, sf):
    return metrics.precision_at_k(V.ranked(spark, sf))


@query(
    "e_ranking_report",
    f"""WITH {V.RANKED}, {_NDCG.replace("@group", _WEEK)},
r AS (
  SELECT rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rt,
         rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS rp FROM ranked),
top AS (SELECT row_number() OVER (ORDER BY y_pred DESC, paper_id) AS p, row_number() OVER (ORDER BY y_true DESC, paper_id) AS t FROM ranked)
SELECT 'spearman_overall' AS metric, CAST(NULL AS INTEGER) AS k, round(corr(rt, rp), 9) AS value, 'ok' AS status FROM r
UNION ALL SELECT 'ndcg', k, round(coalesce(avg(coalesce(dcg / nullif(ideal, 0), 0)) FILTER (n >= k), 0), 9),
  CASE WHEN count(*) FILTER (n >= k) = 0 THEN 'no cohort' ELSE 'ok' END FROM per GROUP BY k
UNION ALL SELECT 'precision', k, CASE WHEN (SELECT count(*) FROM ranked) >= k
  THEN sum(CASE WHEN p <= k AND t <= k THEN 1 ELSE 0 END)::DOUBLE / k ELSE 0 END, 'ok' FROM top, k GROUP BY k""",
)
def report(spark, sf):
    return metrics.ranking_report(_weekly(spark, sf)).withColumn("value", F.round("value", 9))


_E7 = {
    "cheap": "price < 100000",
    "urgent": "second_cat = '1-URGENT'",
    "early": "published < TIMESTAMP '1998-01-01'",
}


@query(
    "e7_slice_metrics",
    f"""WITH {V.RANKED}, s AS ({" UNION ALL ".join(f"SELECT '{n}' AS slice, {c} AS member, y_true, y_pred FROM ranked" for n, c in _E7.items())})
SELECT slice, member, count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg(y_pred - y_true), 6) AS bias,
  round(1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0), 6) AS r2 FROM s GROUP BY 1, 2""",
)
def e7(spark, sf):
    rows = V.ranked(spark, sf).withColumn("second_cat", F.col("categories")[1])
    slices = {n: F.expr(c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")) for n, c in _E7.items()}
    out = metrics.slice_metrics(rows, slices)
    return out.select("slice", "member", "n", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "r2")])


@query(
    "e8_r_squared",
    f"""WITH {V.RANKED} SELECT count(*) AS n,
  round(1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0), 9) AS r2 FROM ranked""",
)
def e8(spark, sf):
    return metrics.r_squared(V.ranked(spark, sf)).withColumn("r2", F.round("r2", 9))


_FIELD_RANKED = f"""{V.RANKED}, f AS (
  SELECT y_true / (CAST(median(y_true) OVER w AS DOUBLE) + 0.1::DOUBLE) AS y_true, y_pred / (CAST(median(y_true) OVER w AS DOUBLE) + 0.1::DOUBLE) AS y_pred
  FROM ranked WINDOW w AS (PARTITION BY primary_cat, year(published))),
r AS (
  SELECT *, rank() OVER (ORDER BY round(y_true, 9)) + (count(*) OVER (PARTITION BY round(y_true, 9)) - 1) / 2.0 AS rt,
    rank() OVER (ORDER BY round(y_pred, 9)) + (count(*) OVER (PARTITION BY round(y_pred, 9)) - 1) / 2.0 AS rp FROM f)"""


@query(
    "e8_field_normalised",
    f"""WITH {_FIELD_RANKED} SELECT round(1 - sum((y_pred - y_true) * (y_pred - y_true)) / nullif(var_pop(y_true) * count(*), 0), 6) AS r2,
  round(corr(rt, rp), 9) AS spearman FROM r""",
)
def e8_normalised(spark, sf):
    """R squared and Spearman of truth and prediction, both over the median truth of field and year."""
    rows = normalise_by_field(V.ranked(spark, sf).select("paper_id", "published", "primary_cat", "y_true", "y_pred"), "y_true")
    scale = F.col("y_true_normalized") / F.nullif(F.col("y_true").cast("double"), F.lit(0.0))
    rows = durable(rows.select(F.col("y_true_normalized").alias("y_true"), (F.col("y_pred") * scale).alias("y_pred")))
    ranks = metrics.spearman(rows.select(F.round("y_true", 9).alias("y_true"), F.round("y_pred", 9).alias("y_pred")))
    spearman = ranks.select("value").scalar()
    return metrics.r_squared(rows).select(F.round("r2", 6).alias("r2"), F.round(spearman, 9).alias("spearman"))


_NORM = "round(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * (1 + label * 0.01), 9)"


@query(
    "e9_norm_drift",
    f"""WITH v AS (SELECT vec_id, {_NORM} AS v FROM embeddings), base AS (SELECT v FROM v WHERE vec_id % 2 = 0), cur AS (SELECT v FROM v WHERE vec_id % 2 = 1),
edges AS (SELECT quantile_cont(v, [{", ".join(f"{i / 10}" for i in range(1, 10))}]) AS e FROM base),
b AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS c FROM base, edges GROUP BY 1),
q AS (SELECT len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS c FROM cur, edges GROUP BY 1),
s AS (SELECT greatest(coalesce(q.c, 0)::DOUBLE / (SELECT count(*) FROM cur), 0.0001) AS p,
  greatest(coalesce(b.c, 0)::DOUBLE / (SELECT count(*) FROM base), 0.0001) AS q FROM b FULL JOIN q ON b.bin = q.bin)
SELECT round(sum((p - q) * ln(p / q)), 6) AS psi FROM s""",
)
def e9_norms(spark, sf):
    """Drift of the length of the embeddings between two halves of the papers."""
    norm = F.round(C.norm(F.col("embedding")) * (1 + F.col("label") * 0.01), 9)
    rows = V.table(spark, sf, "embeddings").select("vec_id", norm.alias("v"))
    out = metrics.population_stability(rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1"), "v")
    return out.select(F.round("psi", 6).alias("psi"))


@query(
    "e9_psi_drift",
    f"""WITH {V.PAPERS}, base AS (SELECT price FROM papers WHERE published < TIMESTAMP '1998-01-01'),
cur AS (SELECT price FROM papers WHERE published >= TIMESTAMP '1998-01-01'),
edges AS (SELECT quantile_cont(price, [{", ".join(f"{i / 10}" for i in range(1, 10))}]) AS e FROM base),
b AS (SELECT len(list_filter(e, lambda x: x < price)) AS bin, count(*) AS c FROM base, edges GROUP BY 1),
q AS (SELECT len(list_filter(e, lambda x: x < price)) AS bin, count(*) AS c FROM cur, edges GROUP BY 1),
s AS (SELECT greatest(coalesce(q.c, 0)::DOUBLE / (SELECT count(*) FROM cur), 0.0001) AS p,
  greatest(coalesce(b.c, 0)::DOUBLE / (SELECT count(*) FROM base), 0.0001) AS q FROM b FULL JOIN q ON b.bin = q.bin)
SELECT round(sum((p - q) * ln(p / q)), 9) AS psi, count(*) AS n_bins FROM s""",
)
def e9(spark, sf):
    p = V.papers(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    out = metrics.population_stability(p.filter(F.col("published") < cut), p.filter(F.col("published") >= cut), "price")
    return out.withColumn("psi", F.round("psi", 9))
