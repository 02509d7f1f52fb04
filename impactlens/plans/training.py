"""Train, store, apply and monitor citation models."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from impactlens.operators import meta_features as meta
from impactlens.operators import metrics
from impactlens.operators.embeddings import hybrid
from impactlens.operators.ordering import quantiles
from impactlens.operators.skew import spread_join
from impactlens.operators.text_features import TextFeaturizer
from impactlens.storage import durable

TEXT_ENCODERS = ("tfidf", "transformer", "hybrid", "none")
SEED = 42
MIN_FIELD_RESIDUALS = 50
INTERVALS = "field STRING, q10 DOUBLE, q90 DOUBLE, n LONG"


def _seconds() -> Column:
    return F.unix_micros(F.col("published").cast("timestamp"))


def split_by_time(df: DataFrame, validation: float = 0.1, test: float = 0.2) -> DataFrame:
    """Add split: train, validation, test, cut at exact quantiles of the publication date.

    A date is never on both sides of a cut.
    """
    at = {"v": 1 - test - validation, "t": 1 - test}
    cuts = quantiles(df.select(_seconds().alias("s")), "s", at).first()
    return df.withColumn(
        "split",
        F.when(_seconds() <= F.lit(int(cuts["v"])), "train").when(_seconds() <= F.lit(int(cuts["t"])), "validation").otherwise("test"),
    )


@dataclass
class Artifacts:
    """Everything needed to predict."""

    meta_encoder: PipelineModel
    models: dict[int, PipelineModel]
    text_model: PipelineModel | None = None
    text_encoder: str = "tfidf"
    graph: bool = False
    feature_names: list[str] = field(default_factory=list)
    # horizon -> (field, q10, q90, n) of the residuals, a null field for all of them
    intervals: dict[int, DataFrame] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        self.meta_encoder.write().overwrite().save(f"{path}/meta")
        if self.text_model is not None:
            self.text_model.write().overwrite().save(f"{path}/text")
        for h, model in self.models.items():
            model.write().overwrite().save(f"{path}/model-{h}")
        for h, table in self.intervals.items():
            table.write.mode("overwrite").parquet(f"{path}/intervals-{h}")
        config = {
            "horizons": list(self.models), "text_encoder": self.text_encoder, "graph": self.graph,
            "feature_names": self.feature_names, "intervals": list(self.intervals), "has_text": self.text_model is not None,
        }
        spark.createDataFrame([(json.dumps(config, default=str),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifacts:
        config = json.loads(spark.read.text(f"{path}/config").first()["value"])
        return cls(
            PipelineModel.load(f"{path}/meta"),
            {h: PipelineModel.load(f"{path}/model-{h}") for h in config["horizons"]},
            PipelineModel.load(f"{path}/text") if config["has_text"] else None,
            config["text_encoder"],
            config["graph"],
            config["feature_names"],
            {h: spark.read.schema(INTERVALS).parquet(f"{path}/intervals-{h}") for h in config["intervals"]},
        )

    def features(self, papers: DataFrame) -> DataFrame:
        """Add the `features` vector: text, categories, numbers, graph."""
        df = papers if self.text_model is None else self.text_model.transform(papers)
        if self.text_encoder == "transformer":
            df = df.withColumn("text_emb", array_to_vector(F.col("embedding").cast("array<double>")))
        elif self.text_encoder == "hybrid":
            df = df.withColumn("text_emb", array_to_vector(hybrid(F.col("embedding"), vector_to_array("text_emb"))))
        return meta.assembler(self.graph, self.text_encoder != "none").transform(self.meta_encoder.transform(df))


def train(
    papers: DataFrame,
    horizons: dict[int, str] | None = None,
    text_encoder: str = "tfidf",
    graph: bool = False,
    featurizer: TextFeaturizer | None = None,
    max_iter: int = 20,
    max_depth: int = 5,
    least_residuals: int = MIN_FIELD_RESIDUALS,
) -> tuple[Artifacts, dict[str, float]]:
    """Fit one boosted-tree regressor per horizon (months -> label column) on shared features.

    `papers` carries title, abstract, primary_cat, month, n_authors, published, the labels, and
    `embedding` or the graph feature columns where asked for; "none" leaves text out. Encoders see
    the training dates only. A field with fewer than `least_residuals` held-out papers has the
    interval of all of them.
    """
    if text_encoder not in TEXT_ENCODERS:
        raise ValueError(f"text_encoder must be one of {TEXT_ENCODERS}")
    horizons = horizons or {12: "y12"}
    split = durable(split_by_time(papers))
    fit_rows = split.filter("split = 'train'")
    text_model = None if text_encoder in ("transformer", "none") else (featurizer or TextFeaturizer()).fit(fit_rows)
    made = Artifacts(meta.MetaFeaturizer().fit(fit_rows), {}, text_model, text_encoder, graph)
    rows = durable(
        made.features(split).select("paper_id", "published", "primary_cat", "split", "features", *horizons.values())
    )
    width = rows.select(F.size(vector_to_array("features"))).first()[0]
    other = len(meta.feature_names(0, made.meta_encoder, graph))
    made.feature_names = meta.feature_names(width - other, made.meta_encoder, graph)
    report: dict[str, float] = {}
    for h, label in horizons.items():
        known = rows.filter(F.col(label).isNotNull())
        tree = GBTRegressor(
            labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, stepSize=0.1, seed=SEED
        )
        made.models[h] = Pipeline(stages=[tree]).fit(known.filter("split = 'train'"))
        scored = durable(
            made.models[h].transform(known.filter("split <> 'train'")).select("paper_id", "primary_cat", "split", F.col(label).alias("y_true"), F.col("prediction").alias("y_pred"))
        )
        made.intervals[h] = residual_intervals(scored.filter("split = 'validation'"), least_residuals)
        report |= {f"{m}_{h}": v for m, v in regression_report(scored.filter("split = 'test'")).items()}
    return made, report


def train_baseline(papers: DataFrame, **options) -> tuple[Artifacts, dict[str, float]]:
    """TF-IDF text, metadata, one 12-month horizon."""
    return train(papers, {12: "y12"}, "tfidf", False, **options)


def regression_report(scored: DataFrame) -> dict[str, float]:
    error = F.col("y_pred") - F.col("y_true")
    row = scored.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")).first()
    return {
        "mae": row["mae"], "rmse": row["rmse"],
        "r2": metrics.r_squared(scored).first()["r2"], "spearman": metrics.spearman(scored).first()["value"],
    }


def residual_intervals(scored: DataFrame, least: int = MIN_FIELD_RESIDUALS) -> DataFrame:
    """(field, q10, q90, n): 10 % and 90 % points of truth - prediction on held-out rows, over all of
    them (field null) and for each field with `least` of them. No rows without held-out rows."""
    rows = durable(scored.select("primary_cat", (F.col("y_true") - F.col("y_pred")).alias("r")))
    at = {"q10": 0.1, "q90": 0.9}
    each = quantiles(rows, "r", at, ("primary_cat",)).filter(F.col("n") >= least)
    total = quantiles(rows, "r", at).filter(F.col("q10").isNotNull()).withColumn("primary_cat", F.lit(None).cast("string"))
    both = each.unionByName(total)
    return durable(both.select(F.col("primary_cat").cast("string").alias("field"), "q10", "q90", F.col("n").cast("long").alias("n")))


def predict(papers: DataFrame, artifacts: Artifacts, horizon: int | None = None) -> DataFrame:
    """papers with `prediction`, from the paper's own date, for a whole table of papers."""
    h = horizon or next(iter(artifacts.models))
    return artifacts.models[h].transform(artifacts.features(papers))


def predict_with_uncertainty(papers: DataFrame, artifacts: Artifacts, horizon: int | None = None) -> DataFrame:
    """papers with mean, q10, q90 and `interval`: an 80 % interval, and whether it is that of the
    paper's 'field' or of 'all' papers; the three are null without held-out residuals."""
    h = horizon or next(iter(artifacts.models))
    rows = predict(papers, artifacts, h).withColumnRenamed("prediction", "mean")
    none = rows.sparkSession.createDataFrame([], INTERVALS)
    known = artifacts.intervals.get(h, none)
    overall = known.filter("field IS NULL")
    fields = known.filter("field IS NOT NULL").select(F.col("field").alias("primary_cat"), F.col("q10").alias("_q10"), F.col("q90").alias("_q90"))
    # one row for each field: left to Spark's size checks, and split where a field is hot
    joined = spread_join(rows, fields, "primary_cat", "left")

    def bound(name: str) -> Column:
        return F.col("mean") + F.coalesce(f"_{name}", F.col(f"_all_{name}"))

    joined = joined.withColumns({f"_all_{q}": overall.agg(F.max(q)).scalar() for q in ("q10", "q90")})
    kind = F.when(F.col("_q10").isNotNull(), "field").when(F.col("_all_q10").isNotNull(), "all")
    out = joined.withColumns({"q10": bound("q10"), "q90": bound("q90"), "interval": kind})
    return out.drop("_q10", "_q90", "_all_q10", "_all_q90")


def hurdle(train_rows: DataFrame, label: str = "y12", features: str = "features") -> Callable[[DataFrame], DataFrame]:
    """Chance of any citation times the Poisson mean of the cited; returns a scoring function, which adds
    `chance`, `amount` and their product `prediction`."""
    any_cite = LogisticRegression(labelCol="_any", featuresCol=features, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r")
    amount = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol=label, featuresCol=features, predictionCol="_amount", regParam=0.01, maxIter=25
    )
    chance = any_cite.fit(train_rows.withColumn("_any", (F.col(label) > 0).cast("double")))
    mean = amount.fit(train_rows.filter(F.col(label) > 0))

    def score(df: DataFrame) -> DataFrame:
        both = mean.transform(chance.transform(df))
        parts = both.withColumns({"chance": vector_to_array("_p")[1], "amount": F.col("_amount")}).drop("_p", "_c", "_r", "_amount")
        return parts.withColumn("prediction", F.col("chance") * F.col("amount"))

    return score


def linear_on(columns: Sequence[str], label: str = "y12", penalty: float = 0.0) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep"),
            LinearRegression(labelCol=label, featuresCol="_x", predictionCol="y_pred", regParam=penalty, solver="normal"),
        ]
    )


def rolling_retrain(
    papers: DataFrame, cuts: Sequence[str], columns: Sequence[str], label: str = "y12", label_years: int = 1
) -> DataFrame:
    """(cut, n_train, n, mae, r2): retrain on what is known at each quarter start, test on that quarter.

    Known are the papers whose labels, the year of publication and `label_years` after it, had ended.
    """
    out = None
    for cut in cuts:  # a few dates, not data
        at = F.lit(cut).cast("timestamp_ntz")
        before = papers.filter(F.year("published") + label_years < F.year(at))
        during = papers.filter((F.col("published") >= at) & (F.col("published") < at + F.expr("INTERVAL 3 MONTHS")))
        error = F.col("y_pred") - F.col(label)
        row = (
            linear_on(columns, label).fit(before).transform(during)
            .agg(
                F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"),
                (1 - F.sum(error * error) / F.nullif(F.var_pop(label) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
            )
            .select(F.lit(cut).alias("cut"), F.lit(before.count()).cast("long").alias("n_train"), "n", "mae", "r2")
        )
        out = row if out is None else out.unionByName(row)
    return out


def ablation(papers: DataFrame, sets: dict[str, Sequence[str]], label: str = "y12") -> DataFrame:
    """(features, n, mae, r2) on the test dates for each named set of feature columns."""
    rows = durable(split_by_time(papers))
    out = None
    for name, columns in sets.items():
        scored = linear_on(columns, label).fit(rows.filter("split = 'train'")).transform(rows.filter("split = 'test'"))
        error = F.col("y_pred") - F.col(label)
        row = scored.agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"),
            (1 - F.sum(error * error) / F.nullif(F.var_pop(label) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        ).select(F.lit(name).alias("features"), "n", "mae", "r2")
        out = row if out is None else out.unionByName(row)
    return out
