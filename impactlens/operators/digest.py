"""Digest items: defaults, keyword lists, activity blocks, composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from impactlens.functions import columns as C


def either_text(*choices: Column, default: str) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(default))


def either_number(*choices: Column, default: float) -> Column:
    """The first choice that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in choices], F.lit(default))


def or_unknown(c: Column) -> Column:
    """Only a missing value is unknown; 0 and "" are shown as they are."""
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def fixed(c: Column, digits: int, missing: str) -> Column:
    """A number with fixed decimals, or a word in its place."""
    return F.when(c.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def with_defaults(items: DataFrame) -> DataFrame:
    """Fill the displayed signals of digest items."""
    return items.select(
        "paper_id",
        either_text(F.col("field_classification"), F.col("signals.field_classification"), default="Unknown").alias("field"),
        either_number(F.col("field_prior_multiplier"), F.col("signals.field_prior_multiplier"), default=1.0).alias("field_prior"),
        or_unknown(F.col("signals.author_h_index_avg")).alias("author_h_index_avg"),
        or_unknown(F.col("signals.author_recent_works_avg")).alias("author_recent_works_avg"),
        or_unknown(F.col("signals.venue_two_year_mean_citedness")).alias("venue_citedness"),
        fixed(F.col("topic_activity_score"), 2, "Not available").alias("topic_activity"),
    )


def keyword_list(keywords: Column) -> Column:
    """Keywords with their relevance to one decimal, or 'unknown'."""
    return F.transform(
        keywords,
        lambda k: F.struct(
            k["keyword"].alias("keyword"),
            fixed(k["relevance"], 1, "unknown").alias("relevance"),
        ),
    )


def activity_block(breakdown: Column, top: int = 3) -> Column:
    """The first keywords, each with the distinct venues of its first publications in first-seen order."""
    return F.transform(
        C.leading(breakdown, top),
        lambda b: F.struct(
            b["keyword"].alias("keyword"),
            b["relevance"].alias("relevance"),
            b["num_works"].alias("num_works"),
            b["total_contribution"].alias("total_contribution"),
            F.array_distinct(F.transform(F.slice(b["top_publications"], 1, top), lambda p: p["venue"])).alias("venues"),
        ),
    )


def keyword_activity(items: DataFrame, top: int = 3) -> DataFrame:
    return items.select(
        "paper_id",
        activity_block(F.col("breakdown"), top).alias("activity"),
        C.remainder(F.col("breakdown"), top).alias("more_keywords"),
    )


def composite_score(df: DataFrame, weights: dict[str, float], name: str = "composite_score") -> DataFrame:
    """Weighted sum of standardised columns; the weights are the caller's, a constant column counts 0.

    The formula is this library's own definition.
    """
    moments = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    ).first()
    score = F.lit(0.0)
    for c, w in weights.items():
        mean, sd = moments[f"mean_{c}"], moments[f"sd_{c}"]
        if sd:
            score = score + F.lit(w) * (F.coalesce(F.col(c).cast("double"), F.lit(mean)) - F.lit(mean)) / F.lit(sd)
    return df.withColumn(name, score)
