"""Zero-inflated negative binomial regression of citation counts, and likelihoods to compare count models by.

A paper belongs with a chance to those that can never be cited, and has otherwise a negative binomial count whose
variance is mean + dispersion * mean^2. Each round asks how likely every zero is to be of the first kind, moves both
regressions by one weighted least squares step, and takes the dispersion with the highest likelihood of a grid
around the last. All sums over papers are aggregates; what reaches the driver are coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from impactlens.storage import durable

# Linear predictors beyond this are as good as certain, and their exponentials still numbers.
FAR = 20.0
LEAST_DISPERSION, MOST_DISPERSION = 1e-4, 1e4
# Steps of the grid of dispersions to either side, and the first width of a step in logarithms.
GRID, WIDTH = 4, 0.5


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0 to about 1e-12: Stirling's series eight further up, and the recurrence back."""
    shifted = x + 8
    part, square = 1 / shifted, 1 / (shifted * shifted)
    series = part * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    stirling = (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series
    back = x
    for i in range(1, 8):
        back = back * (x + i)
    return stirling - F.log(back)


def poisson_log_chance(y: Column, mean: Column) -> Column:
    return y * F.log(mean) - mean - log_gamma(y + 1)


def negative_binomial_log_chance(y: Column, mean: Column, dispersion: Column) -> Column:
    """ln P(y) of the negative binomial with variance mean + dispersion * mean^2."""
    size = 1 / dispersion
    return (
        log_gamma(y + size) - log_gamma(size) - log_gamma(y + 1)
        - size * F.log1p(dispersion * mean) + y * (F.log(dispersion * mean) - F.log1p(dispersion * mean))
    )


def hurdle_log_chance(y: Column, chance: Column, amount: Column) -> Column:
    """ln P(y) of the hurdle model: cited with `chance`, then a Poisson count of `amount` that is not 0."""
    cited = F.log(chance) + poisson_log_chance(y, amount) - F.log(-F.expm1(-amount))
    return F.when(y > 0, cited).otherwise(F.log1p(-chance))


def _within(eta: Column) -> Column:
    return F.greatest(F.least(eta, F.lit(FAR)), F.lit(-FAR))


def _chance(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def _inflated_log_chance(y: Column, zero: Column, mean: Column, dispersion: Column) -> Column:
    counted = negative_binomial_log_chance(y, mean, dispersion)
    return F.when(y > 0, F.log1p(-zero) + counted).otherwise(F.log(zero + (1 - zero) * F.exp(counted)))


def _likelihoods(scored: DataFrame, grid: list[float]) -> list[float]:
    """The mean log-likelihood of y, never_cited and count_mean for each dispersion of the grid, in one pass.

    What does not depend on the dispersion is worked out once for a row; a count of 0 needs no gamma function.
    """
    y, zero, mean = F.col("y"), F.col("never_cited"), F.col("count_mean")
    fixed = F.when(y > 0, F.log1p(-zero) - log_gamma(y + 1) + y * F.log(mean))
    rows = scored.select("y", "never_cited", "count_mean", fixed.alias("_fixed"))
    values = []
    for dispersion in grid:
        size, spread = 1 / dispersion, F.log1p(dispersion * mean)
        counted = F.col("_fixed") + log_gamma(y + size) - math.lgamma(size) - (y + size) * spread + y * math.log(dispersion)
        values.append(F.when(y > 0, counted).otherwise(F.log(zero + (1 - zero) * F.exp(-size * spread))))
    return list(rows.agg(*[F.avg(v).alias(f"v{i}") for i, v in enumerate(values)]).first())


@dataclass
class ZeroInflated:
    """The linear predictors of the never cited and of the logarithm of the mean, and the dispersion."""

    zero: LinearRegressionModel
    mean: LinearRegressionModel
    dispersion: float
    log_likelihood: float
    rounds: int

    def add_to(self, df: DataFrame) -> DataFrame:
        """`df` with never_cited (chance of a structural zero), count_mean and prediction, the expected count."""
        return _predicted(df, self.zero, self.mean).withColumn("prediction", (1 - F.col("never_cited")) * F.col("count_mean"))

    def log_chance(self, y: Column) -> Column:
        """ln P(y) over the columns of `add_to`."""
        return _inflated_log_chance(y, F.col("never_cited"), F.col("count_mean"), F.lit(self.dispersion))

    def save(self, spark: SparkSession, path: str) -> None:
        self.zero.write().overwrite().save(f"{path}/zero")
        self.mean.write().overwrite().save(f"{path}/mean")
        head = [(self.dispersion, self.log_likelihood, self.rounds)]
        spark.createDataFrame(head, "dispersion DOUBLE, log_likelihood DOUBLE, rounds INT").write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ZeroInflated:
        head = spark.read.parquet(f"{path}/head").first()
        return cls(LinearRegressionModel.load(f"{path}/zero"), LinearRegressionModel.load(f"{path}/mean"), *head)


def _predicted(df: DataFrame, zero: LinearRegressionModel, mean: LinearRegressionModel) -> DataFrame:
    both = mean.setPredictionCol("_mean_eta").transform(zero.setPredictionCol("_zero_eta").transform(df))
    columns = {"never_cited": _chance(_within(F.col("_zero_eta"))), "count_mean": F.exp(_within(F.col("_mean_eta")))}
    return both.withColumns(columns).drop("_zero_eta", "_mean_eta")


def fit_zero_inflated(
    rows: DataFrame, label: str = "y12", features: str = "features", penalty: float = 1e-3, max_rounds: int = 50, tol: float = 1e-5
) -> ZeroInflated:
    """The model of whole counts of 0 and more, by expectation and maximisation.

    Rows with a null or negative label are left out; without any other row it raises ValueError. It ends when the mean
    log-likelihood gains less than `tol` in a round, and returns the best round. `penalty` shrinks the standardised
    coefficients of either regression, without which a feature that separates the zeros has no finite one.
    """
    y = F.col("y")
    given = rows.select(F.col(features).alias("features"), F.col(label).cast("double").alias("y")).filter("y >= 0")
    given = durable(given.filter(F.col("features").isNotNull()))
    n, average, zeros = given.agg(F.count(F.lit(1)), F.avg("y"), F.avg((y == 0).cast("double"))).first()
    if not n:
        raise ValueError(f"no row has a {label} of 0 or more")
    # half of the zeros are taken to be structural at first
    share = min(max(zeros / 2, 1e-3), 1 - 1e-3)
    scored = given.withColumns({"never_cited": F.lit(share), "count_mean": F.lit(max(average, 1e-3) / (1 - share))})
    dispersion, width, best = 1.0, WIDTH, None

    def regression(target: str, weight: str) -> LinearRegression:
        return LinearRegression(featuresCol="features", labelCol=target, weightCol=weight, regParam=penalty, solver="normal")

    for number in range(1, max_rounds + 1):
        zero, mean = F.col("never_cited"), F.col("count_mean")
        none = F.pow(1 + dispersion * mean, F.lit(-1 / dispersion))
        structural = F.when(y > 0, 0.0).otherwise(zero / (zero + (1 - zero) * none))
        spread = F.greatest(zero * (1 - zero), F.lit(1e-6))
        asked = scored.withColumn("structural", structural).withColumns({
            "zero_target": F.log(zero / (1 - zero)) + (F.col("structural") - zero) / spread,
            "zero_weight": spread,
            "mean_target": F.log(mean) + (y - mean) / mean,
            "mean_weight": F.greatest((1 - F.col("structural")) * mean / (1 + dispersion * mean), F.lit(1e-9)),
        })
        models = regression("zero_target", "zero_weight").fit(asked), regression("mean_target", "mean_weight").fit(asked)
        # two products a row, so the chances are worked out where they are needed and never written
        scored = _predicted(given, *models)
        # the last dispersion is one of the grid, so the likelihood never falls by this step
        grid = sorted({min(max(dispersion * math.exp(i * width), LEAST_DISPERSION), MOST_DISPERSION) for i in range(-GRID, GRID + 1)})
        last, (value, dispersion) = dispersion, max(zip(_likelihoods(scored, grid), grid, strict=True))
        # narrow the grid around its middle, widen it where its end is the best
        steps = abs(math.log(dispersion / last)) / width
        width = width / 2 if steps < 1.5 else width * 2 if steps > GRID - 0.5 else width
        gain = math.inf if best is None else value - best.log_likelihood
        if gain > 0:
            best = ZeroInflated(*models, dispersion, value, number)
        if gain < tol and width < 0.01:
            break
    return best
