"""Impact ranks, percentiles and top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from impactlens.operators.ordering import with_average_rank


def impact_rank(df: DataFrame, score: str = "predicted_citations") -> DataFrame:
    """Every paper with impact_rank (1 is best, ties averaged) and impact_percentile.

    A paper without a score has neither, but counts among those the percentile is taken over.
    """
    everyone = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = with_average_rank(df, score, "impact_rank", descending=True).withColumn("total", everyone)
    return ranked.withColumn("impact_percentile", _percentile(F.col("total"))).drop("total")


def top_by_impact(df: DataFrame, k: int = 50, score: str = "predicted_citations", key: str = "paper_id") -> DataFrame:
    """Exactly k papers (fewer only if there are fewer), best first, ties by id.

    Same ranks as impact_rank, from two scans and no shuffle of the papers: only scores at or
    above the k-th need counting, and there are at most k of them.
    """
    scored = df.filter(F.col(score).isNotNull())
    top = scored.orderBy(F.desc(score), key).limit(k)
    leading = top.select(score).distinct()
    counts = scored.join(leading, score, "left_semi").groupBy(score).agg(F.count(F.lit(1)).alias("_cnt"))
    above = F.coalesce(
        F.sum("_cnt").over(W.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    ranks = counts.select(score, (above + (F.col("_cnt").cast("double") + 1) / 2).alias("impact_rank"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        top.join(ranks, score)
        .withColumn("_n", total)
        .withColumn("impact_percentile", _percentile(F.col("_n")))
        .drop("_n")
        .orderBy("impact_rank", key)
    )


def _percentile(total: Column) -> Column:
    return (total - F.col("impact_rank") + 1) / total * 100


def top_per_group(df: DataFrame, group: str | Column, k: int, score: str, key: str = "paper_id") -> DataFrame:
    """The k best rows of each group. The rank filter is applied before the shuffle as well, so a
    large group sends at most k rows per input partition."""
    group = F.col(group) if isinstance(group, str) else group
    w = W.partitionBy(group).orderBy(F.desc(score), key)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
