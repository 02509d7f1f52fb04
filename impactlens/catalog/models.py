"""Queries over model training, prediction, intervals, ranking and explanation."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.labels import labelled, works_table
from impactlens.catalog.registry import query
from impactlens.operators import cohorts, embeddings, explain, labels, metrics
from impactlens.plans import counts, intervals, ranker, scoring, training
from impactlens.storage import durable, new_path


def full_papers(spark, sf):
    """Documents that are also labelled papers: text, metadata and 6/12/24-month labels."""
    counted = labels.with_horizons(labels.enrich(V.papers(spark, sf).drop("title", "categories"), works_table(spark, sf), "paper_id"), V.AS_OF)
    authors = V.authors(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("n_authors"))
    text = V.doc_papers(spark, sf).select("paper_id", "title", "abstract")
    return (
        counted.join(text, "paper_id").join(authors, "paper_id", "left").fillna(0, ["n_authors"])
        .withColumn("month", F.month("published"))
        .withColumnsRenamed({"y6_calendar": "y6", "y12_calendar": "y12", "y24_calendar": "y24"})
        .filter(F.col("y12").isNotNull())
        .select("paper_id", "published", "primary_cat", "title", "abstract", "month", "n_authors", "price", "y6", "y12", "y24")
    )


def _text_trained(spark, sf):
    papers = durable(full_papers(spark, sf))
    made, report = training.train_baseline(papers)
    return papers, made, report


def _meta_trained(spark, sf):
    """A model of metadata alone over all labelled papers."""
    authors = V.authors(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).cast("int").alias("n_authors"))
    rows = labelled(spark, sf).join(authors, "paper_id").withColumn("month", F.month("published"))
    papers = durable(rows.select("paper_id", "published", "primary_cat", "title", "month", "n_authors", "y12"))
    made, _ = training.train(papers, text_encoder="none")
    return papers, made


@query(
    "m7_time_split",
    f"""WITH {V.PAPERS}, t AS (SELECT *, epoch_us(published) AS s FROM papers),
q AS (SELECT CAST(floor(quantile_cont(s, 0.7)) AS BIGINT) AS v, CAST(floor(quantile_cont(s, 0.8)) AS BIGINT) AS t FROM t)
SELECT paper_id, CASE WHEN s <= v THEN 'train' WHEN s <= q.t THEN 'validation' ELSE 'test' END AS split FROM t, q""",
)
def m7(spark, sf):
    return training.split_by_time(V.papers(spark, sf)).select("paper_id", "split")


def _finite(spark, report):
    """One row per metric: whether it is a number; a missing one, as where a horizon has no test papers, is not."""
    rows = [(k, v is not None and math.isfinite(v)) for k, v in sorted(report.items())]
    return spark.createDataFrame(rows, "metric STRING, finite BOOLEAN")


def _finite_sql(*horizons: int) -> str:
    """Every metric of a horizon is a number where test papers have its label, and only there."""
    days = {6: 183, 12: 365, 24: 730}
    names = ", ".join(f"('{m}_{h}', {days[h]})" for h in horizons for m in ("mae", "rmse", "r2", "spearman"))
    return f"""WITH {V.LABELLED}, p AS (SELECT published, epoch_us(published) AS s FROM labelled JOIN documents ON doc_id = paper_id),
cut AS (SELECT CAST(floor(quantile_cont(s, 0.8)) AS BIGINT) AS t FROM p), tested AS (SELECT published FROM p, cut WHERE s > t)
SELECT metric, count(published) > 1 AS finite FROM (VALUES {names}) m(metric, days)
LEFT JOIN tested ON published <= TIMESTAMP '{V.AS_OF} 00:00:00' - to_days(days) GROUP BY 1"""


@query("m1_train_baseline", _finite_sql(12))
def m1(spark, sf):
    _, _, report = _text_trained(spark, sf)
    return _finite(spark, report)


@query("m2_m3_save_load_predict", f"WITH {V.LABELLED} SELECT l.paper_id, TRUE AS ok FROM labelled l JOIN documents ON doc_id = l.paper_id")
def m2(spark, sf):
    """Predictions before and after a round trip to disk agree."""
    papers, made, _ = _text_trained(spark, sf)
    path = new_path(spark, "artifacts")
    made.save(spark, path)
    again = training.Artifacts.load(spark, path)
    before = training.predict(papers, made).select("paper_id", "prediction")
    after = training.predict(papers, again).select("paper_id", F.col("prediction").alias("again"))
    return before.join(after, "paper_id").select("paper_id", (F.col("prediction") == F.col("again")).alias("ok"))


@query("m4_multi_horizon_hybrid", _finite_sql(6, 12, 24))
def m4(spark, sf):
    papers = durable(full_papers(spark, sf))
    vectors, _ = embeddings.embed_papers(papers, lambda: embeddings.HashEncoder(16))
    rows = papers.join(vectors, "paper_id")
    _, report = training.train(rows, {6: "y6", 12: "y12", 24: "y24"}, "hybrid")
    return _finite(spark, report)


@query("m5_e6_interval_prediction", "SELECT unnest(generate_series(1, 10))::INTEGER AS bin, TRUE AS plausible")
def m5(spark, sf):
    """Coverage of the 80 % intervals on the test dates, by prediction decile."""
    papers, made = _meta_trained(spark, sf)
    tested = training.split_by_time(papers).filter("split = 'test'")
    rows = durable(training.predict_with_uncertainty(tested, made).select("paper_id", F.col("mean").alias("y_pred"), "q10", "q90", F.col("y12").alias("y_true")))
    return metrics.interval_coverage(rows).select("bin", F.col("coverage").between(0.4, 1.0).alias("plausible"))


_COVERED = f"""WITH {V.LABELLED}, t AS (SELECT *, epoch_us(published) AS s FROM labelled),
q AS (SELECT CAST(floor(quantile_cont(s, 0.8)) AS BIGINT) AS t FROM t)
SELECT count(*) AS n, TRUE AS covers, TRUE AS ordered, TRUE AS varies, TRUE AS beats_constant FROM t, q WHERE s > q.t"""


@query("m5_paper_intervals", _COVERED)
def m5_intervals(spark, sf):
    """On the test dates: whether the share of truths inside is 0.75 to 0.85, the widths differ from paper to paper, and
    the upper ends have a lower pinball loss than the one quantile of the training dates for all."""
    rows = _split_vectors(spark, sf)
    fit, held, test = (rows.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    made = intervals.fit_intervals(fit, held)
    scored = durable(made.add_to(test).withColumn("flat", F.lit(made.high.base)))
    inside = F.avg(F.col("y12").between(F.col("q10"), F.col("q90")).cast("int")).between(0.75, 0.85)
    loss = lambda c: F.avg(F.greatest(0.9 * (F.col("y12") - F.col(c)), -0.1 * (F.col("y12") - F.col(c))))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), inside.alias("covers"), F.min(F.col("q10") <= F.col("q90")).alias("ordered"),
        (F.count_distinct(F.round(F.col("q90") - F.col("q10"), 6)) > 1).alias("varies"), (loss("q90") < loss("flat")).alias("beats_constant"),
    )


@query(
    "s10_weekly_scoring",
    f"""WITH {V.LABELLED} SELECT paper_id, primary_cat, strftime(published, '%Y-%m-%d %H:%M:%S') AS published, TRUE AS in_order FROM labelled
WHERE published >= (SELECT date_trunc('week', max(published)) FROM labelled)""",
)
def s10_scoring(spark, sf):
    """The newest week forecast by a trained model, read back from the JSON it was written to."""
    papers, made = _meta_trained(spark, sf)
    path = new_path(spark, "weekly")
    scoring.score_newest_week(papers, made, path)
    rows = spark.read.schema("paper_id LONG, published STRING, primary_cat STRING, mean DOUBLE, q10 DOUBLE, q90 DOUBLE").json(path)
    return rows.select("paper_id", "primary_cat", "published", (F.col("q10") <= F.col("q90")).alias("in_order"))


@query(
    "m5_residual_quantiles",
    f"""WITH {V.RANKED}, r AS (SELECT primary_cat, y_true - y_pred AS r FROM ranked)
SELECT coalesce(primary_cat, '') AS field, round(quantile_cont(r, 0.1), 6) AS q10, round(quantile_cont(r, 0.9), 6) AS q90
FROM r GROUP BY GROUPING SETS ((), (primary_cat))""",
)
def m5_quantiles(spark, sf):
    found = training.residual_intervals(V.ranked(spark, sf))
    return found.select(F.coalesce("field", F.lit("")).alias("field"), F.round("q10", 6).alias("q10"), F.round("q90", 6).alias("q90"))


@query(
    "e6_interval_coverage",
    f"""WITH {V.RANKED}, d AS (SELECT *, least(CAST(floor((rank() OVER (ORDER BY y_pred) - 1) * 10 / count(*) OVER ()) + 1 AS INTEGER), 10) AS bin FROM ranked)
SELECT bin, count(*) AS n, round(avg(CASE WHEN y_true BETWEEN y_pred - 40 AND y_pred + 60 THEN 1.0::DOUBLE ELSE 0 END), 9) AS coverage, 100.0::DOUBLE AS mean_width FROM d GROUP BY 1""",
)
def e6(spark, sf):
    rows = V.ranked(spark, sf).withColumns({"q10": F.col("y_pred") - 40, "q90": F.col("y_pred") + 60})
    return metrics.interval_coverage(rows).withColumn("coverage", F.round("coverage", 9))


def _meta_vectors(spark, sf):
    """Labelled papers with a small numeric vector and their weekly cohort."""
    from pyspark.ml.feature import VectorAssembler

    authors = V.authors(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).cast("double").alias("n_authors"))
    rows = cohorts.with_cohort(labelled(spark, sf)).join(authors, "paper_id").withColumns(
        {"month": F.month("published").cast("double"), "kprice": F.col("price") / 1000}
    )
    return VectorAssembler(inputCols=["n_authors", "month", "kprice"], outputCol="features").transform(rows)


def _split_vectors(spark, sf):
    """paper_id, y12, features and split; the papers are put together once, then cut by date and read from there."""
    rows = durable(_meta_vectors(spark, sf).select("paper_id", "published", F.col("y12").cast("double").alias("y12"), "features"))
    return training.split_by_time(rows).drop("published")


@query("m6_cohort_ranker", "SELECT unnest([10, 20])::INTEGER AS k, TRUE AS better")
def m6(spark, sf):
    """Whether the ranker orders monthly cohorts of the test dates better than a constant score does."""
    made = _meta_vectors(spark, sf).withColumn("cohort", F.date_format("published", "yyyy-MM"))
    rows = durable(training.split_by_time(made).select("paper_id", "cohort", "split", F.col("y12").alias("y"), "features"))
    model = ranker.train_ranker(rows.filter("split = 'train'"))
    scored = durable(
        model.score(rows.filter("split = 'test'")).select("paper_id", "cohort", F.col("y").alias("y_true"), F.col("score").alias("y_pred"))
    )
    got = metrics.mean_cohort_ndcg(scored, k_values=(10, 20)).select("k", F.col("value").alias("got"))
    plain = metrics.mean_cohort_ndcg(scored.withColumn("y_pred", F.lit(0.0)), k_values=(10, 20)).select("k", F.col("value").alias("plain"))
    return got.join(plain, "k").select("k", (F.col("got") > F.col("plain")).alias("better"))


@query(
    "m6_rank_gradients",
    f"""WITH {V.RANKED}, b AS (SELECT paper_id, primary_cat AS cohort, y_true::DOUBLE AS y, y_pred / 10 AS score FROM ranked),
p AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY score DESC, paper_id) AS p, row_number() OVER (PARTITION BY cohort ORDER BY y DESC, paper_id) AS t FROM b),
d AS (SELECT *, CASE WHEN p <= 30 THEN 1 / log2(1 + p) ELSE 0 END AS disc FROM p),
i AS (SELECT cohort, sum(y / log2(1 + t)) AS ideal FROM p WHERE t <= 30 GROUP BY 1),
pairs AS (
  SELECT a.paper_id, CASE WHEN a.y > l.y THEN 1 ELSE -1 END AS s, abs(a.y - l.y) * abs(a.disc - l.disc) / ideal AS w,
    1 / (1 + exp(CASE WHEN a.y > l.y THEN a.score - l.score ELSE l.score - a.score END)) AS doubt
  FROM d a JOIN d l ON l.cohort = a.cohort AND (l.p <= 30 OR a.p <= 30) AND a.y <> l.y JOIN i ON i.cohort = a.cohort)
SELECT paper_id, round(sum(s * doubt * w), 8) AS g, round(sum(doubt * (1 - doubt) * w), 8) AS h FROM pairs GROUP BY 1""",
)
def m6_gradients(spark, sf):
    from impactlens.operators.skew import count_keys

    rows = durable(V.ranked(spark, sf).select(
        "paper_id", F.col("primary_cat").alias("cohort"), F.col("y_true").cast("double").alias("y"), (F.col("y_pred") / 10).alias("score")
    ))
    out = ranker.gradients(rows, durable(count_keys(rows, "cohort")), ranker.ideal_dcg(rows))
    return out.select("paper_id", (F.round("g", 8) + 0.0).alias("g"), F.round("h", 8).alias("h"))


@query("m8_hurdle", "SELECT TRUE AS never_negative, TRUE AS beats_mean")
def m8(spark, sf):
    """On the test dates the hurdle model errs less than the mean of the training dates does."""
    rows = durable(training.split_by_time(_meta_vectors(spark, sf)).select("paper_id", "split", "y12", "features"))
    fit, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    mean = fit.agg(F.avg("y12").alias("m")).scalar()
    error = F.sum((F.col("prediction") - F.col("y12")) ** 2)
    return training.hurdle(fit)(test).withColumn("m", mean).select(
        (F.min("prediction") >= 0).alias("never_negative"), (error < F.sum((F.col("m") - F.col("y12")) ** 2)).alias("beats_mean")
    )


@query(
    "m8_zero_inflated",
    f"""WITH {V.LABELLED}, t AS (SELECT *, epoch_us(published) AS s FROM labelled),
q AS (SELECT CAST(floor(quantile_cont(s, 0.8)) AS BIGINT) AS t FROM t)
SELECT count(*) AS n, sum(y12)::BIGINT AS cites, TRUE AS never_negative, TRUE AS beats_hurdle FROM t, q WHERE s > q.t""",
)
def m8_inflated(spark, sf):
    """Whether the test dates are likelier under the zero-inflated model than under the hurdle with its Poisson counts."""
    rows = _split_vectors(spark, sf)
    fit, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    y, made = F.col("y12"), counts.fit_zero_inflated(fit)
    scored = made.add_to(training.hurdle(fit)(test).drop("prediction"))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("cites"), (F.min("prediction") >= 0).alias("never_negative"),
        (F.sum(made.log_chance(y)) > F.sum(counts.hurdle_log_chance(y, F.col("chance"), F.col("amount")))).alias("beats_hurdle"),
    )


_CUTS = ("1998-01-01", "1998-04-01", "1998-07-01", "1998-10-01")
_FIT_ERROR = """count(*) AS n, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / nullif(var_pop(y12) * count(*), 0), 6) AS r2"""


@query(
    "m9_rolling_retrain",
    f"""WITH {V.LABELLED}, cuts AS (SELECT unnest([{", ".join(f"TIMESTAMP '{c}'" for c in _CUTS)}]) AS c),
fits AS (SELECT c, count(*) AS n_train, regr_slope(y12, price) AS b, regr_intercept(y12, price) AS a FROM labelled JOIN cuts ON year(published) + 1 < year(c) GROUP BY 1),
errors AS (SELECT c, n_train, y12, a + b * price - y12 AS e FROM labelled JOIN fits ON published >= c AND published < c + INTERVAL 3 MONTH)
SELECT strftime(c, '%Y-%m-%d') AS cut, n_train, {_FIT_ERROR} FROM errors GROUP BY 1, 2""",
)
def m9(spark, sf):
    out = training.rolling_retrain(durable(labelled(spark, sf)), _CUTS, ["price"])
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "r2")})


@query(
    "m10_ablation",
    f"""WITH {V.LABELLED}, t AS (SELECT *, epoch_us(published) AS s, month(published)::DOUBLE AS month FROM labelled),
q AS (SELECT CAST(floor(quantile_cont(s, 0.7)) AS BIGINT) AS v, CAST(floor(quantile_cont(s, 0.8)) AS BIGINT) AS t FROM t),
fit AS (
  SELECT avg(y12) AS y, avg(price) AS p, avg(month) AS m, covar_pop(y12, price) AS yp, covar_pop(y12, month) AS ym, covar_pop(price, month) AS pm,
    var_pop(price) AS pp, var_pop(month) AS mm FROM t, q WHERE s <= v),
test AS (SELECT t.* FROM t, q WHERE s > q.t),
errors AS (
  SELECT 'price' AS features, y12, y + yp / pp * (price - p) - y12 AS e FROM test, fit
  UNION ALL SELECT 'month', y12, y + ym / mm * (month - m) - y12 FROM test, fit
  UNION ALL SELECT 'both', y12, y + ((yp * mm - ym * pm) * (price - p) + (ym * pp - yp * pm) * (month - m)) / (pp * mm - pm * pm) - y12 FROM test, fit)
SELECT features, {_FIT_ERROR} FROM errors GROUP BY 1""",
)
def m10(spark, sf):
    rows = durable(labelled(spark, sf).withColumn("month", F.month("published")))
    out = training.ablation(rows, {"price": ["price"], "month": ["month"], "both": ["price", "month"]})
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "r2")})


@query(
    "x1_background_sample",
    f"WITH {V.PAPERS} SELECT paper_id, title, price FROM papers ORDER BY sha256(CAST(paper_id AS VARCHAR)), paper_id LIMIT 100",
)
def x1(spark, sf):
    return explain.background_sample(V.papers(spark, sf)).select("paper_id", "title", "price")


_EXPLAINED = f"WITH {V.LABELLED} SELECT paper_id, TRUE AS ok FROM labelled"


@query("x2_tree_attributions", _EXPLAINED)
def x2(spark, sf):
    """Attributions plus baseline give the prediction for every paper."""
    papers, made = _meta_trained(spark, sf)
    scored = durable(training.predict(papers, made).select("paper_id", "features", "prediction"))
    phi = explain.tree_attributions(scored, made.models[12].stages[-1])
    total = F.aggregate("phi", F.col("baseline"), lambda s, v: s + v)
    return phi.join(scored.select("paper_id", "prediction"), "paper_id").select(
        "paper_id", (F.abs(total - F.col("prediction")) < 1e-6).alias("ok")
    )


@query("x2_background_attributions", _EXPLAINED)
def x2_background(spark, sf):
    """Against the background sample, attributions and the sample's mean prediction give the prediction for every paper."""
    papers, made = _meta_trained(spark, sf)
    scored = durable(training.predict(papers, made).select("paper_id", "features", "prediction"))
    sample = durable(explain.background_sample(scored))
    phi = explain.background_attributions(scored, made.models[12].stages[-1], sample)
    mean, total = sample.agg(F.avg("prediction")).scalar(), F.aggregate("phi", F.col("baseline"), lambda s, v: s + v)
    return phi.join(scored.select("paper_id", "prediction"), "paper_id").withColumn("mean", mean).select(
        "paper_id", ((F.abs(total - F.col("prediction")) < 1e-6) & (F.abs(F.col("baseline") - F.col("mean")) < 1e-6)).alias("ok")
    )


@query("x3_x4_paper_explanations", _EXPLAINED)
def x34(spark, sf):
    """Every paper is explained by at most ten features of either sign, whose sum never passes the prediction's distance."""
    papers, made = _meta_trained(spark, sf)
    scored = durable(training.predict(papers, made).select("paper_id", "title", "features", "prediction"))
    phi = explain.tree_attributions(scored, made.models[12].stages[-1])
    rows = explain.explanations(phi.join(scored.drop("features"), "paper_id"), made.feature_names, info=["title"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, f: s + f["value"])
    up, down = "top_positive_features", "top_negative_features"
    # a model of fewer than ten features is explained in full
    whole = F.abs(F.col("baseline") + total(up) + total(down) - F.col("prediction")) < 1e-6
    full = (F.size(up) == 10) | (F.size(down) == 10)
    return rows.select("paper_id", ((F.size(up) <= 10) & (F.size(down) <= 10) & (full | whole)).alias("ok"))
