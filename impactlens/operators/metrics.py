"""Ranking, calibration, slice and drift metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from impactlens.operators.ordering import average_rank, ordered_counts, quantiles
from impactlens.operators.skew import spread_join
from impactlens.storage import durable

K_VALUES = (10, 20, 50)


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def spearman(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row: rank correlation with averaged ties, null if either side is constant, and `status`.

    Works on the counted (truth, pred) pairs. The mean rank is (n+1)/2 by definition, so the
    centred sums need no second pass.
    """
    pairs = durable(df.select(truth, pred).dropna().groupBy(truth, pred).agg(F.count(F.lit(1)).alias("_n")))
    by_truth = ordered_counts(pairs, truth, weight="_n")
    by_pred = ordered_counts(pairs, pred, weight="_n")
    truth_ranks = by_truth.select(truth, average_rank().alias("_rt"), F.col("total").alias("_t"))
    both = spread_join(pairs, truth_ranks, truth).join(by_pred.select(pred, average_rank().alias("_rp")), pred)
    mean = (F.col("_t") + 1) / F.lit(2.0)
    t, p, n = F.col("_rt") - mean, F.col("_rp") - mean, F.col("_n")
    return both.agg(
        F.sum(n * t * p).alias("tp"), F.sum(n * t * t).alias("tt"), F.sum(n * p * p).alias("pp"), F.sum(n).alias("n")
    ).select(
        F.lit("spearman_overall").alias("metric"),
        _ratio(F.col("tp"), F.sqrt(F.col("tt") * F.col("pp"))).alias("value"),
        F.when(F.col("n").isNull(), "empty")
        .when((F.col("tt") == 0) | (F.col("pp") == 0), "constant")
        .otherwise("ok")
        .alias("status"),
    )


def _discounts(first: Column, last: Column) -> Column:
    """Sum of 1/log2(1+position) over the positions first..last; 0 if there are none."""
    total = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda s, p: s + 1 / F.log2(p + F.lit(1.0)))
    return F.when(first <= last, total).otherwise(F.lit(0.0))


def _dcg(df: DataFrame, by: list[str], score: str, gain: str, k_values: Sequence[int], prefix: str) -> DataFrame:
    """DCG@k per group: rows with equal scores share the mean gain over the positions they fill.

    Rows are counted per score first and only the max(k) best scores of a group go further.
    """
    tied = df.groupBy(*by, score).agg(
        F.count(F.lit(1)).cast("int").alias("_cnt"), F.avg(F.col(gain).cast("double")).alias("_gain")
    )
    order = W.partitionBy(*by).orderBy(F.desc(score))
    tied = tied.withColumn("_pos", F.row_number().over(order)).filter(F.col("_pos") <= max(k_values))
    start = F.coalesce(F.sum("_cnt").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    placed = tied.withColumn("_first", start)
    last = F.col("_first") + F.col("_cnt") - 1
    return placed.groupBy(*by).agg(
        *[
            F.sum(F.col("_gain") * _discounts(F.col("_first"), F.least(last, F.lit(k)))).alias(f"{prefix}{k}")
            for k in k_values
        ]
    )


def ndcg_per_group(
    df: DataFrame, by: Sequence[str], truth: str = "y_true", pred: str = "y_pred", k_values: Sequence[int] = K_VALUES
) -> DataFrame:
    """(by..., k, n, ndcg, min_truth): linear gain, tie-averaged, 0.0 where the ideal DCG is 0."""
    groups = list(by) or ["_list"]
    rows = (df if by else df.withColumn("_list", F.lit(0))).select(*groups, truth, pred).dropna(subset=[truth, pred])
    got = _dcg(rows, groups, pred, truth, k_values, "_dcg")
    ideal = _dcg(rows, groups, truth, truth, k_values, "_ideal")
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min(truth).cast("double").alias("min_truth"))
    # one row per group from each of the three: stacked and folded, a single group needs no join either
    stacked = sizes.unionByName(got, allowMissingColumns=True).unionByName(ideal, allowMissingColumns=True)
    joined = stacked.groupBy(*groups).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in groups])
    per_k = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("k"),
                    F.coalesce(_ratio(F.col(f"_dcg{k}"), F.col(f"_ideal{k}")), F.lit(0.0)).alias("ndcg"),
                )
                for k in k_values
            ]
        )
    )
    return joined.select(*by, "n", "min_truth", per_k.alias("_m")).select(*by, "_m.k", "n", "_m.ndcg", "min_truth")


def ndcg_at_k(df: DataFrame, k: int = 20, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """NDCG@k of the whole table as one list."""
    return ndcg_per_group(df, (), truth, pred, (k,)).select(F.lit("ndcg").alias("metric"), "k", F.col("ndcg").alias("value"))


def mean_cohort_ndcg(
    df: DataFrame, by: Sequence[str] = ("cohort",), truth: str = "y_true", pred: str = "y_pred",
    k_values: Sequence[int] = K_VALUES,
) -> DataFrame:
    """Unweighted mean over the cohorts with at least k rows; 0.0 if none has.

    A negative truth, or a list of one row, in an eligible cohort voids the metric at that k
    (0.0), and `status` says so.
    """
    per_group = ndcg_per_group(df, by, truth, pred, k_values)
    eligible = F.col("n") >= F.col("k")
    bad = eligible & (F.col("min_truth") < 0)
    single = eligible & (F.col("n") == 1)
    return (
        per_group.groupBy("k")
        .agg(
            F.avg(F.when(eligible, F.col("ndcg"))).alias("_mean"),
            F.count_if(eligible).alias("n_cohorts"),
            F.coalesce(F.bool_or(bad), F.lit(False)).alias("_negative"),
            F.coalesce(F.bool_or(single), F.lit(False)).alias("_single"),
        )
        .select(
            F.lit("ndcg").alias("metric"),
            "k",
            F.when(F.col("_negative") | F.col("_single"), F.lit(0.0))
            .otherwise(F.coalesce("_mean", F.lit(0.0)))
            .alias("value"),
            F.when(F.col("_negative"), "negative truth")
            .when(F.col("_single"), "single row")
            .when(F.col("n_cohorts") == 0, "no cohort")
            .otherwise("ok")
            .alias("status"),
            "n_cohorts",
        )
    )


def precision_at_k(
    df: DataFrame, key: str = "paper_id", truth: str = "y_true", pred: str = "y_pred",
    k_values: Sequence[int] = K_VALUES,
) -> DataFrame:
    """Share of the k truly best papers among the k best predicted, over the whole table.

    0.0 at every k above the row count. Ties go to the smaller id. Only the max(k) best rows of
    either order leave the scan.
    """
    top = max(k_values)
    rows = df.select(key, truth, pred).dropna(subset=[truth, pred])

    def best(score: str, name: str) -> DataFrame:
        order = [F.desc(score), F.col(key)]
        return rows.orderBy(*order).limit(top).withColumn(name, F.row_number().over(W.orderBy(*order))).select(key, name)

    both = best(truth, "_t").join(best(pred, "_p"), key)
    found = both.agg(
        *[F.count_if((F.col("_t") <= k) & (F.col("_p") <= k)).alias(f"_k{k}") for k in k_values]
    ).withColumn("_n", rows.agg(F.count(F.lit(1)).alias("n")).scalar())
    per_k = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.when(F.col("_n") >= k, F.col(f"_k{k}") / F.lit(float(k))).otherwise(F.lit(0.0)).alias("value"),
            )
            for k in k_values
        ]
    )
    return found.select(F.explode(per_k).alias("_m")).select(F.lit("precision").alias("metric"), "_m.k", "_m.value")


def ranking_report(df: DataFrame, by: Sequence[str] = ("cohort",), k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """(metric, k, value, status): rank correlation, mean cohort NDCG@k and precision@k."""
    none = F.lit(None).cast("int").alias("k")
    return (
        spearman(df).select("metric", none, "value", "status")
        .unionByName(mean_cohort_ndcg(df, by, k_values=k_values).select("metric", "k", "value", "status"))
        .unionByName(precision_at_k(df, k_values=k_values).withColumn("status", F.lit("ok")))
    )


def interval_coverage(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", bins: int = 10) -> DataFrame:
    """(bin, n, coverage, mean_width): how often [q10, q90] holds the truth, by prediction decile."""
    counts = ordered_counts(df, pred)
    spread = counts.select(
        pred, F.least(F.floor(F.col("before") * bins / F.col("total")) + 1, F.lit(bins)).cast("int").alias("bin")
    )
    inside = F.col(truth).between(F.col("q10"), F.col("q90")).cast("double")
    return spread_join(df, spread, pred, counts=counts.select(pred, "cnt")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage"), F.avg(F.col("q90") - F.col("q10")).alias("mean_width")
    )


def slice_metrics(df: DataFrame, slices: dict[str, Column], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(slice, member, n, mae, bias, r2) for each boolean slice, all in one aggregation."""
    named = F.explode(
        F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("boolean").alias("member")) for n, c in slices.items()])
    )
    y, e = F.col(truth).cast("double"), F.col(pred) - F.col(truth)
    return (
        df.select(truth, pred, named.alias("s"))
        .groupBy("s.slice", "s.member")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e).alias("bias"),
            (1 - _ratio(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        )
    )


def r_squared(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row: 1 - squared error / squared deviation, null when the truth is constant."""
    y, e = F.col(truth).cast("double"), F.col(pred) - F.col(truth)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        (1 - _ratio(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
    )


def population_stability(
    baseline: DataFrame, current: DataFrame, value: str, bins: int = 10, floor: float = 1e-4
) -> DataFrame:
    """One row: PSI of `value` between two periods over the baseline's quantile bins."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = F.array(*[F.lit(e) for e in quantiles(baseline, value, names).select(*names).first()])

    def shares(df: DataFrame, name: str) -> DataFrame:
        bin_of = F.size(F.filter(edges, lambda e: e < F.col(value)))
        binned = df.select(value).dropna().groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
        # at most `bins` rows here
        return binned.select("bin", (F.col("_c") / F.sum("_c").over(W.partitionBy())).alias(name))

    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor))
    q = F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(floor))
    return (
        shares(baseline, "q").join(shares(current, "p"), "bin", "full")
        .agg(F.sum((p - q) * F.ln(p / q)).alias("psi"), F.count(F.lit(1)).alias("n_bins"))
    )
