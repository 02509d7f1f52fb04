"""Additive attributions of linear and tree models, their summary and the record per paper."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from impactlens.storage import new_path

# A path of at most so many features has its values worked out for each of its patterns.
TABLED = 6


def background_sample(df: DataFrame, n: int = 100, key: str = "paper_id") -> DataFrame:
    """A repeatable sample of n rows, for explaining against: the smallest hashes of the id."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def linear_attributions(df: DataFrame, weights: Sequence[float], means: Sequence[float], features: str = "x") -> DataFrame:
    """Add phi[i] = w[i] * (x[i] - mean[i])."""
    w, m = (F.array(*[F.lit(float(v)) for v in values]) for values in (weights, means))
    deviation = F.zip_with(F.col(features), m, lambda x, c: x.cast("double") - c)
    return df.withColumn("phi", F.zip_with(deviation, w, lambda d, v: d * v))


def _paths(nodes: dict[int, dict]) -> tuple[list[tuple], float]:
    """Per leaf (value, [(feature, test, cover share)]) with one entry per feature, and the tree's mean."""
    leaves, mean = [], 0.0

    def walk(at: int, path: dict) -> None:
        nonlocal mean
        node = nodes[at]
        if node["leftChild"] < 0:
            share = node["rawCount"] / nodes[0]["rawCount"]
            mean += share * node["prediction"]
            leaves.append((node["prediction"], [(f, tests, z) for f, (tests, z) in path.items()]))
            return
        split = node["split"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            tests, z = path.get(split["featureIndex"], ((), 1.0))
            test = (tuple(split["leftCategoriesOrThreshold"]), split["numCategories"] >= 0, left)
            walk(child, {**path, split["featureIndex"]: (tests + (test,), z * nodes[child]["rawCount"] / node["rawCount"])})

    walk(0, {})
    return leaves, mean


def _holds(x: np.ndarray, tests: tuple) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for values, categorical, left in tests:
        goes_left = np.isin(x, values) if categorical else x <= values[0]
        ok &= goes_left if left else ~goes_left
    return ok


def _patterns(x: np.ndarray, paths: list[list[tuple]]) -> Iterator[np.ndarray]:
    """The number of each row's pattern, path by path: bit j is set where the row's value of the path's feature j lets it
    go on to the leaf. Tests that the paths of a tree share are made once."""
    made: dict[tuple, np.ndarray] = {}
    for path in paths:
        code = np.zeros(len(x), np.int64)
        for j, (f, tests, _) in enumerate(path):
            if (f, tests) not in made:
                made[f, tests] = _holds(x[:, f], tests).astype(np.int64)
            code |= made[f, tests] << j
        yield code


def _bits(codes: np.ndarray, m: int) -> np.ndarray:
    """(pattern, feature of the path): whether the bit is set."""
    return (codes[:, None] >> np.arange(m) & 1).astype(bool)


def leaf_shapley(hit: np.ndarray, path: list[tuple]) -> np.ndarray:
    """(row, feature of the path): a leaf's exact path-dependent Shapley values of value 1, for the patterns `hit`.

    The subset sums are the coefficients of prod (z + o t) over the other features of the path.
    """
    m = len(path)
    weights = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
    phi = np.zeros(hit.shape)
    for a in range(m):
        poly = np.zeros((len(hit), m))
        poly[:, 0] = 1.0
        for b in range(m):
            if b != a:
                grown = poly * path[b][2]
                grown[:, 1:] += poly[:, :-1] * hit[:, [b]]
                poly = grown
        phi[:, a] = (hit[:, a] - path[a][2]) * (poly @ weights)
    return phi


def _explained(df: DataFrame, trees: list[list[tuple]], values_of: Callable, baseline: float, features: str, key: str) -> DataFrame:
    """(key, phi, baseline): the sum over the leaves (value, path, extra) of value * values_of(patterns, path, extra).

    A leaf's values depend on a row's pattern alone. Those of a path of at most `TABLED` features are worked out for
    every pattern beforehand and looked up by the rows; of a longer path for the patterns that a batch has.
    """
    tabled = [
        [(value, path, extra, value * values_of(_bits(np.arange(1 << len(path)), len(path)), path, extra) if len(path) <= TABLED else None)
         for value, path, extra in leaves if path]
        for leaves in trees
    ]
    shared = df.sparkSession.sparkContext.broadcast(tabled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(n, -1).T).T if n else np.zeros((0, 1))
            phi = np.zeros(x.T.shape)
            for leaves in shared.value if n else ():
                for (value, path, extra, table), code in zip(leaves, _patterns(x, [leaf[1] for leaf in leaves]), strict=True):
                    if table is None:
                        codes, code = np.unique(code, return_inverse=True)
                        table = value * values_of(_bits(codes, len(path)), path, extra)
                    for j, (f, _, _) in enumerate(path):
                        phi[f] += table[:, j][code]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(phi), pa.int32()), pa.array(phi.T.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "phi"])

    id_type = df.schema[key].dataType.simpleString()
    rows = df.select(key, vector_to_array(features).alias("x"))
    return rows.mapInArrow(run, f"`{key}` {id_type}, phi ARRAY<DOUBLE>").withColumn("baseline", F.lit(float(baseline)))


def _trees(spark: SparkSession, model) -> list[tuple]:
    """(weight, leaves, mean) of each tree of a fitted model."""
    path = new_path(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    single = "treeID" not in stored.columns
    trees: dict[int, dict[int, dict]] = {}
    for row in stored.collect():
        node = (row if single else row["nodeData"]).asDict(recursive=True)
        trees.setdefault(0 if single else row["treeID"], {})[node["id"]] = node
    scale = [1.0] if single else list(model.treeWeights)
    parsed = [(scale[t], *_paths(nodes)) for t, nodes in sorted(trees.items())]
    if model.__class__.__name__.startswith("RandomForest"):
        parsed = [(1.0 / len(parsed), leaves, mean) for _, leaves, mean in parsed]
    return parsed


def tree_attributions(df: DataFrame, model, features: str = "features", key: str = "paper_id") -> DataFrame:
    """(key, phi, baseline) for a fitted tree ensemble; phi sums to prediction - baseline.

    The node table of the model (trees x nodes, set by its depth) goes to the tasks with each leaf's values by
    pattern; rows are explained in Arrow batches wherever they lie, all of them.
    """
    parsed = _trees(df.sparkSession, model)
    trees = [[(w * value, path, None) for value, path in leaves] for w, leaves, _ in parsed]
    return _explained(df, trees, lambda hit, path, _: leaf_shapley(hit, path), sum(w * mean for w, _, mean in parsed), features, key)


def _hits(x: np.ndarray, path: list[tuple]) -> np.ndarray:
    """(row, feature of the path): whether the row's value lets it go on to the leaf."""
    return np.stack([_holds(x[:, f], tests) for f, tests, _ in path], axis=1) if path else np.zeros((len(x), 0), bool)


def leaf_contrast(hit: np.ndarray, other: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(row, feature of the path): a leaf's Shapley values of value 1 against rows `other` that weigh `share`.

    With a features that only the row satisfies and b that only the other does, the leaf is reached by the coalitions
    that hold all of the a and none of the b, wherefore each of the a gains (a-1)! b! / (a+b)! and each of the b loses
    a! (b-1)! / (a+b)!. A feature that neither satisfies leaves nothing to gain.
    """
    m = hit.shape[1]
    gain, loss = np.zeros((m + 1, m + 1)), np.zeros((m + 1, m + 1))
    for a in range(m + 1):
        for b in range(m + 1 - a):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    phi = np.zeros(hit.shape)
    for theirs, weight in zip(other, share, strict=True):
        own, not_own = hit & ~theirs, ~hit & theirs
        a, b = own.sum(axis=1), not_own.sum(axis=1)
        reached = weight * (hit | theirs).all(axis=1)
        phi += own * (reached * gain[a, b])[:, None] - not_own * (reached * loss[a, b])[:, None]
    return phi


def background_attributions(
    df: DataFrame, model, background: DataFrame, features: str = "features", key: str = "paper_id", most: int = 1000
) -> DataFrame:
    """(key, phi, baseline) for a fitted tree ensemble: exact Shapley values where a feature that is left out has the
    value of a background row, averaged over them. phi sums to prediction - baseline, the background's mean prediction.

    `background` is a small sample, as of `background_sample`; none, or more than `most` rows, raise ValueError. The
    driver turns it into the patterns in which its rows meet each leaf, with their shares; those go to the tasks with
    the node table, the rows themselves do not. Rows that meet a leaf in one pattern are explained once.
    """
    spark = df.sparkSession
    sample = background.select(vector_to_array(features).alias("x")).limit(most + 1).collect()
    if not 0 < len(sample) <= most:
        raise ValueError(f"the background has to have 1 to {most} rows")
    z = np.array([r["x"] for r in sample])
    trees, baseline = [], 0.0
    for weight, leaves, _ in _trees(spark, model):
        met = []
        for value, path in leaves:
            other, count = np.unique(_hits(z, path), axis=0, return_counts=True) if path else (np.zeros((1, 0), bool), np.array([len(z)]))
            share = count / len(z)
            baseline += weight * value * share[other.all(axis=1)].sum()
            met.append((weight * value, path, (other, share)))
        trees.append(met)
    return _explained(df, trees, lambda hit, _, sample: leaf_contrast(hit, *sample), baseline, features, key)


def feature_name(position: Column, names: Sequence[str] | None) -> Column:
    unnamed = F.concat(F.lit("feature_"), position)
    if not names:
        return unnamed
    return F.coalesce(F.get(F.array(*map(F.lit, names)), position), unnamed)


def global_importance(attributions: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(feature, importance): mean absolute attribution."""
    return (
        attributions.select(F.posexplode("phi").alias("i", "v"))
        .groupBy("i").agg(F.avg(F.abs(F.col("v").cast("double"))).alias("importance"))
        .select(feature_name(F.col("i"), names).alias("feature"), "importance")
    )


def explanations(
    attributions: DataFrame, names: Sequence[str] | None = None, top: int = 10, info: Sequence[str] = ()
) -> DataFrame:
    """Per paper: prediction, baseline, its strongest positive and negative features, paper_info.

    Zeros are in neither list; equal strengths keep feature order.
    """
    named = F.transform(
        "phi", lambda v, i: F.struct(feature_name(i, names).alias("name"), v.cast("double").alias("value"), i.alias("i"))
    )
    strongest = F.array_sort(
        named,
        lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
        .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
        .otherwise(a["i"] - b["i"]),
    )
    pick = lambda keep: F.transform(
        F.slice(F.filter("_ranked", keep), 1, top), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"))
    )
    has = attributions.columns
    baseline = F.coalesce("baseline", F.lit(0.0)) if "baseline" in has else F.lit(0.0)
    total = F.aggregate("phi", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return attributions.withColumn("_ranked", strongest).select(
        "paper_id",
        (F.col("prediction") if "prediction" in has else baseline + total).alias("prediction"),
        baseline.alias("baseline"),
        pick(lambda f: f["value"] > 0).alias("top_positive_features"),
        pick(lambda f: f["value"] < 0).alias("top_negative_features"),
        F.struct("paper_id", *info).alias("paper_info"),
    )
