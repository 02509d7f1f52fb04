"""Quantile trees and the intervals made of them."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from impactlens.plans import intervals


@pytest.fixture(scope="module")
def rows(spark):
    """y is spread evenly over 0 to 10 + 40 x: its quantiles are known."""
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, 4000)
    y = rng.uniform(0, 1, 4000) * (10 + 40 * x)
    given = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "paper_id long, x double, y double")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(given)


def test_quantile_trees_follow_the_paper(spark, rows, tmp_path):
    made = intervals.fit_quantile(rows, 0.9, "y", rounds=6, step=0.5, max_depth=3)
    scored = made.add_to(rows, "q").withColumn("true_q", 0.9 * (10 + 40 * F.col("x")))
    assert scored.agg(F.avg(F.abs(F.col("q") - F.col("true_q")))).first()[0] < 2.5
    assert abs(scored.agg(F.avg((F.col("y") <= F.col("q")).cast("int"))).first()[0] - 0.9) < 0.02
    flat = scored.withColumn("flat", F.lit(made.base))
    loss = flat.select(intervals.pinball_loss(scored, 0.9, "y", "q"), intervals.pinball_loss(flat, 0.9, "y", "flat")).first()
    assert loss[0] < 0.9 * loss[1]
    made.save(spark, str(tmp_path))
    again = intervals.QuantileTrees.load(spark, str(tmp_path)).add_to(rows, "again")
    assert made.add_to(again, "q").filter("q != again").count() == 0


def test_intervals_cover_the_wanted_share(rows):
    fit, held, test = (rows.filter(F.col("paper_id") % 3 == i) for i in range(3))
    made = intervals.fit_intervals(fit, held, "y", rounds=3, step=0.5, max_depth=3)
    scored = made.add_to(test)
    share = scored.agg(F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("int"))).first()[0]
    assert abs(share - 0.8) < 0.04 and scored.filter("q10 > q90 OR q10 < 0").count() == 0
    # a label that is 0 for a third of the papers is not covered more often than wanted
    zero = lambda df: df.withColumn("y", F.when(F.col("paper_id") % 10 < 3, 0.0).otherwise(F.col("y")))
    scored = intervals.fit_intervals(zero(fit), zero(held), "y", rounds=3, step=0.5, max_depth=3).add_to(zero(test))
    assert abs(scored.agg(F.avg(F.col("y").between(F.col("q10"), F.col("q90")).cast("int"))).first()[0] - 0.8) < 0.04


def test_intervals_without_rows(rows):
    with pytest.raises(ValueError, match="label"):
        intervals.fit_quantile(rows.withColumn("y", F.lit(None).cast("double")), 0.5, "y")
    assert intervals.fit_intervals(rows, rows.limit(0), "y", rounds=1).shift == 0.0
