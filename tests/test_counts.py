"""Count models: likelihoods, and the zero-inflated negative binomial."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from impactlens.plans import counts


def test_log_chances_against_the_gamma_function(spark):
    cases = [(y, mean, a) for y in (0, 1, 7, 300) for mean in (0.01, 2.5, 400.0) for a in (1e-3, 0.7, 20.0)]
    df = spark.createDataFrame([(float(y), m, a) for y, m, a in cases], "y DOUBLE, m DOUBLE, a DOUBLE")
    y, m, a = F.col("y"), F.col("m"), F.col("a")
    for r in df.withColumns({
        "gamma": counts.log_gamma(m), "poisson": counts.poisson_log_chance(y, m), "nb": counts.negative_binomial_log_chance(y, m, a),
        "hurdle": counts.hurdle_log_chance(y, F.lit(0.3), m),
    }).collect():
        assert r["gamma"] == pytest.approx(math.lgamma(r["m"]), abs=1e-10)
        poisson = r["y"] * math.log(r["m"]) - r["m"] - math.lgamma(r["y"] + 1)
        assert r["poisson"] == pytest.approx(poisson, abs=1e-9)
        size = 1 / r["a"]
        p = size / (size + r["m"])
        nb = math.lgamma(r["y"] + size) - math.lgamma(size) - math.lgamma(r["y"] + 1) + size * math.log(p) + r["y"] * math.log1p(-p)
        assert r["nb"] == pytest.approx(nb, abs=1e-8)
        hurdle = math.log(0.7) if r["y"] == 0 else math.log(0.3) + poisson - math.log(-math.expm1(-r["m"]))
        assert r["hurdle"] == pytest.approx(hurdle, abs=1e-9)


@pytest.fixture(scope="module")
def drawn(spark):
    """Counts drawn from a model of known coefficients."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 2))
    never = rng.uniform(size=len(x)) < 1 / (1 + np.exp(-(-0.8 + 1.2 * x[:, 0])))
    mean = np.exp(1.0 + 0.5 * x[:, 1])
    y = np.where(never, 0, rng.negative_binomial(2.0, 2.0 / (2.0 + mean)))  # a dispersion of 0.5
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    given = spark.createDataFrame(rows, "paper_id LONG, a DOUBLE, b DOUBLE, y12 DOUBLE")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(given).persist()


def test_the_model_finds_what_the_counts_were_drawn_from(spark, drawn, tmp_path):
    made = counts.fit_zero_inflated(drawn)
    assert made.dispersion == pytest.approx(0.5, abs=0.12)
    assert [made.zero.intercept, *made.zero.coefficients] == pytest.approx([-0.8, 1.2, 0.0], abs=0.25)
    assert [made.mean.intercept, *made.mean.coefficients] == pytest.approx([1.0, 0.0, 0.5], abs=0.12)
    scored = made.add_to(drawn)
    total, y, predicted = scored.agg(F.avg(made.log_chance(F.col("y12"))), F.avg("y12"), F.avg("prediction")).first()
    assert total == pytest.approx(made.log_likelihood, abs=1e-9) and predicted == pytest.approx(y, rel=0.05)
    # likelier than a Poisson count, and than any count without structural zeros of the same mean
    flat = scored.agg(F.avg(counts.negative_binomial_log_chance(F.col("y12"), F.col("prediction"), F.lit(made.dispersion)))).first()[0]
    assert total > flat + 0.01
    made.save(spark, str(tmp_path))
    again = counts.ZeroInflated.load(spark, str(tmp_path))
    assert again.dispersion == made.dispersion and again.rounds == made.rounds
    assert again.add_to(scored.withColumnRenamed("prediction", "first").drop("never_cited", "count_mean")).filter("first <> prediction").count() == 0


def test_the_same_rows_give_the_same_model(drawn):
    some = drawn.filter("paper_id < 600")
    first, second = (counts.fit_zero_inflated(some.repartition(n), max_rounds=4) for n in (3, 3))
    assert first.log_likelihood == pytest.approx(second.log_likelihood, abs=1e-12) and first.dispersion == second.dispersion


def test_odd_labels(spark, drawn):
    with pytest.raises(ValueError, match="y12"):
        counts.fit_zero_inflated(drawn.withColumn("y12", F.lit(None).cast("double")))
    few = drawn.filter("paper_id < 200")
    for value in (0.0, 3.0):  # only zeros, none
        made = counts.fit_zero_inflated(few.withColumn("y12", F.lit(value)), max_rounds=3)
        assert math.isfinite(made.log_likelihood)
        assert made.add_to(few).agg(F.avg("prediction")).first()[0] == pytest.approx(value, abs=0.2)
