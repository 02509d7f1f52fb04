"""Signals about papers and authors: diversity, standing, distance to the field."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.functions import columns as C
from impactlens.operators.ordering import ordered_counts
from impactlens.operators.skew import spread_join
from impactlens.storage import durable


def _shares(rows: DataFrame, item: str) -> DataFrame:
    """(paper_id, item, c) of non-null items; a paper's items are counted before they meet."""
    return rows.filter(F.col(item).isNotNull()).groupBy("paper_id", item).agg(F.count(F.lit(1)).alias("c"))


def concept_entropy(rows: DataFrame, concept: str = "concept") -> DataFrame:
    """(paper_id, n_concepts, concept_entropy): Shannon entropy -sum p ln p, from counts in one
    pass: ln N - sum c ln c / N."""
    n, c = F.sum("c"), F.col("c")
    return _shares(rows, concept).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_concepts"), (F.ln(n) - F.sum(c * F.ln(c)) / n).alias("concept_entropy")
    )


def institution_diversity(rows: DataFrame, institution: str = "institution") -> DataFrame:
    """(paper_id, n_institutions, institution_diversity): 1 - sum p^2."""
    n, c = F.sum("c"), F.col("c")
    return _shares(rows, institution).groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_institutions"), (1 - F.sum(c * c) / (n * n)).alias("institution_diversity")
    )


def author_standing(authors: DataFrame, yearly: DataFrame, cutoff: str) -> DataFrame:
    """(author, prior_papers, prior_cites, h_index) from papers published before the cutoff and the
    citations of the years that had ended by then.

    `yearly` is (paper_id, year, cited_by_count).

    h is the largest min(c, papers with at least c citations): counted values suffice, so an
    author with very many papers is not sorted in one task.
    """
    prior = authors.filter(F.col("published") < F.lit(cutoff).cast("timestamp_ntz"))
    ended = yearly.filter(F.col("year") < F.year(F.lit(cutoff).cast("timestamp_ntz")))
    cites = ended.groupBy("paper_id").agg(F.sum("cited_by_count").cast("long").alias("cites"))
    rows = prior.select("author", "paper_id").join(cites, "paper_id", "left").fillna(0, ["cites"])
    counts = ordered_counts(rows, "cites", ("author",))
    return counts.groupBy("author").agg(
        F.sum("cnt").alias("prior_papers"),
        F.sum(F.col("cnt") * F.col("cites")).alias("prior_cites"),
        F.max(F.least(F.col("cites"), F.col("total") - F.col("before"))).cast("long").alias("h_index"),
    )


def centroid_distance(vectors: DataFrame, category: str = "primary_cat") -> DataFrame:
    """(paper_id, category, centroid_distance): cosine distance to the mean vector of the category."""
    means = (
        vectors.select(category, F.posexplode("embedding").alias("i", "x"))
        .groupBy(category, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy(category)  # one entry per dimension
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("_centre"))
    )
    near = spread_join(vectors, durable(means), category)
    return near.select("paper_id", category, (1 - C.cosine(F.col("embedding"), F.col("_centre"))).alias("centroid_distance"))


def top_experts(standing: DataFrame, n: int = 20) -> DataFrame:
    """(author): the n most established authors by h-index, then citations."""
    return standing.orderBy(F.desc("h_index"), F.desc("prior_cites"), "author").limit(n).select("author")


def expert_proximity(neighbours: DataFrame, experts: DataFrame) -> DataFrame:
    """(author, expert_proximity): largest Jaccard overlap of an author's co-authors with an expert's.

    Only authors sharing a co-author with an expert appear; the others are at 0.
    """
    sizes = durable(neighbours.groupBy("author").agg(F.count(F.lit(1)).alias("cnt")))
    circle = neighbours.join(experts, "author", "left_semi").select(F.col("author").alias("expert"), "neighbour")
    through = neighbours.select("neighbour", "author")
    shared = (
        spread_join(through, circle, "neighbour", counts=sizes.withColumnRenamed("author", "neighbour"))
        .groupBy("author", "expert").agg(F.count(F.lit(1)).alias("_both"))
    )
    mine = sizes.withColumnRenamed("cnt", "_a")
    # one row for each expert, as many as the caller asked for: few keys, so no shuffle by them
    theirs = F.broadcast(sizes.join(experts, "author", "left_semi").select(F.col("author").alias("expert"), F.col("cnt").alias("_e")))
    overlap = F.col("_both") / (F.col("_a") + F.col("_e") - F.col("_both"))
    return shared.join(mine, "author").join(theirs, "expert").groupBy("author").agg(F.max(overlap).alias("expert_proximity"))
