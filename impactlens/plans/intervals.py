"""Prediction intervals that depend on the paper: boosted quantile trees, made to cover by held-out papers.

Each round fits a tree to the signs of the residuals, the gradient of the pinball loss, and gives every leaf
the wanted quantile of its residuals. Two such models are the ends of an interval; how far held-out truths lie
above the upper end says by how much to move it so that the intervals cover the wanted share of papers. The
lower end stays: where many papers have no citation at all it is 0, and cannot leave out a tenth of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from impactlens.operators.ordering import quantiles
from impactlens.storage import durable

SEED = 42
LEAF = "_leaf"


@dataclass
class QuantileTrees:
    """base + step * the values of the leaves a paper falls into, one leaf of each tree."""

    quantile: float
    base: float
    step: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    values: list[dict[int, float]] = field(default_factory=list)

    def add_to(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with the prediction as a column; the tables of leaf values are as small as the trees."""
        out = df.withColumn(name, F.lit(self.base))
        for tree, values in zip(self.trees, self.values, strict=True):
            out = _with_leaf(out, tree).withColumn(name, F.col(name) + self.step * _value(values)).drop(LEAF)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{i}")
        leaves = [(i, int(leaf), float(v)) for i, values in enumerate(self.values) for leaf, v in values.items()]
        spark.createDataFrame(leaves, "tree INT, leaf INT, value DOUBLE").write.mode("overwrite").parquet(f"{path}/leaves")
        head = [(self.quantile, self.base, self.step, len(self.trees))]
        spark.createDataFrame(head, "quantile DOUBLE, base DOUBLE, step DOUBLE, trees INT").write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileTrees:
        head = spark.read.parquet(f"{path}/head").first()
        made = cls(head["quantile"], head["base"], head["step"], values=[{} for _ in range(head["trees"])])
        made.trees = [DecisionTreeRegressionModel.load(f"{path}/tree-{i}") for i in range(head["trees"])]
        for r in spark.read.parquet(f"{path}/leaves").collect():
            made.values[r["tree"]][r["leaf"]] = r["value"]
        return made


def _with_leaf(df: DataFrame, tree: DecisionTreeRegressionModel) -> DataFrame:
    return tree.setLeafCol(LEAF).setPredictionCol("_sign").transform(df).drop("_sign").withColumn(LEAF, F.col(LEAF).cast("int"))


def _value(values: dict[int, float]) -> Column:
    """The value of a row's leaf, 0 for one without; leaves are numbered from 0, so it is looked up by place."""
    if not values:
        return F.lit(0.0)
    table = F.array(*[F.lit(float(values.get(i, 0.0))) for i in range(max(values) + 1)])
    return F.coalesce(F.get(table, F.col(LEAF)), F.lit(0.0))


def fit_quantile(
    rows: DataFrame, quantile: float, label: str = "y12", features: str = "features", rounds: int = 10, max_depth: int = 4, step: float = 0.3
) -> QuantileTrees:
    """Boosted trees for one quantile of `label`. Rows without a label are left out; there must be some.

    A round is a tree fit and one exact quantile for each leaf, counted and ranged like any other quantile,
    so a leaf with most of the rows is no more than its distinct residuals.
    """
    known = rows.filter(F.col(label).isNotNull()).select(features, F.col(label).cast("double").alias("_y"))
    base = quantiles(known, "_y", {"v": quantile}).first()["v"]
    if base is None:
        raise ValueError("no row has a label")
    made = QuantileTrees(quantile, base, step)
    state = durable(known).withColumn("_f", F.lit(base))
    for _ in range(rounds):
        signs = state.select(features, F.when(F.col("_y") > F.col("_f"), quantile).otherwise(quantile - 1).alias("_g"))
        tree = DecisionTreeRegressor(labelCol="_g", featuresCol=features, maxDepth=max_depth, seed=SEED).fit(signs)
        # kept once a round, with the leaf; what the leaf adds is worked out where the next round reads it
        placed = durable(_with_leaf(state, tree).withColumn("_r", F.col("_y") - F.col("_f")))
        # one row for each leaf
        found = {r[LEAF]: r["v"] for r in quantiles(placed, "_r", {"v": quantile}, (LEAF,)).collect()}
        made.trees.append(tree)
        made.values.append(found)
        state = placed.select(features, "_y", (F.col("_f") + step * _value(found)).alias("_f"))
    return made


def pinball_loss(scored: DataFrame, quantile: float, label: str, prediction: str) -> Column:
    """The mean pinball loss of a scored table, as a scalar."""
    r = F.col(label) - F.col(prediction)
    return scored.agg(F.avg(F.greatest(quantile * r, (quantile - 1) * r))).scalar()


@dataclass
class PaperIntervals:
    low: QuantileTrees
    high: QuantileTrees
    shift: float

    def add_to(self, df: DataFrame) -> DataFrame:
        """`df` with q10 and q90; no end is below 0, and where the ends cross the upper one is the lower one."""
        both = self.high.add_to(self.low.add_to(df, "_low"), "_high")
        low = F.greatest("_low", F.lit(0.0))
        return both.withColumns({"q10": low, "q90": F.greatest(low, F.col("_high") + self.shift)}).drop("_low", "_high")


def fit_intervals(
    train: DataFrame, held_out: DataFrame, label: str = "y12", features: str = "features", coverage: float = 0.8, **options
) -> PaperIntervals:
    """Intervals for non-negative counts that cover about `coverage` of papers like the held-out ones.

    The upper end moves by the quantile coverage * (1 + 1/n) of how far held-out truths lie above it, where a
    truth below the lower end lies above every bound; without held-out rows it does not move.
    """
    tail = (1 - coverage) / 2
    made = PaperIntervals(fit_quantile(train, tail, label, features, **options), fit_quantile(train, 1 - tail, label, features, **options), 0.0)
    known = held_out.filter(F.col(label).isNotNull())
    scored = made.high.add_to(made.low.add_to(known, "_low"), "_high")
    above = F.when(F.col(label) < F.greatest("_low", F.lit(0.0)), F.lit(float("inf"))).otherwise(F.col(label) - F.col("_high"))
    rows = durable(scored.select(above.cast("double").alias("e")))
    n = rows.count()
    if n:
        made.shift = quantiles(rows, "e", {"v": min(1.0, coverage * (1 + 1 / n))}).first()["v"]
    return made
