"""What a task holds, and what a round moves, does not grow with the tables."""

import itertools
import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from impactlens import storage
from impactlens.operators import centrality, coauthors, graph_features
from impactlens.plans import counts, intervals


@pytest.fixture(scope="module")
def papers(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(0, 4), float(max(0, round(rng.gauss(2, 3))))) for i in range(600)]
    given = spark.createDataFrame(rows, "paper_id LONG, a DOUBLE, y12 DOUBLE")
    return VectorAssembler(inputCols=["a"], outputCol="features").transform(given).persist()


def counted(monkeypatch, module):
    """The tables a module makes durable from here on."""
    made, plain = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df: made.append(df.columns) or plain(df))
    return made


def test_pairs_are_counted_in_tasks_of_a_set_size(spark):
    """The pairs made by a task and the edges added up by one are bounded, whatever the number of shuffle partitions."""
    rng = random.Random(5)
    papers = {p: rng.sample(range(30), rng.randint(2, 9)) for p in range(300)}
    rows = [(p, str(a), len(of)) for p, of in papers.items() for a in of]
    odd = [(None, "1", 2), (None, "2", 2), (301, "1", 2), (301, None, 2)]  # nulls meet nothing
    inc = spark.createDataFrame(rows + odd, "paper_id INT, author STRING, n_authors INT")
    wanted = Counter(pair for of in papers.values() for pair in itertools.combinations(sorted(map(str, of)), 2))
    for block in (512, 2):
        edges = coauthors.coauthor_edges(inc, block=block, pairs_per_task=100)
        assert edges.rdd.getNumPartitions() >= sum(wanted.values()) / 100
        assert {(r["u"], r["v"]): r["weight"] for r in edges.collect()} == wanted


def test_rounds_of_the_count_model_write_no_table(monkeypatch, papers):
    made = counted(monkeypatch, counts)
    counts.fit_zero_inflated(papers, max_rounds=3)
    assert len(made) == 1


def test_likelihoods_of_a_grid_in_one_pass(papers):
    scored = papers.select(F.col("y12").alias("y"), (F.col("a") / 5 + 0.01).alias("never_cited"), F.exp("a").alias("count_mean"))
    grid = [1e-4, 0.3, 1.0, 50.0, 1e4]
    model = lambda a: counts.ZeroInflated(None, None, a, 0.0, 0)
    wanted = [scored.agg(F.avg(model(a).log_chance(F.col("y")))).first()[0] for a in grid]
    assert counts._likelihoods(scored, grid) == pytest.approx(wanted, abs=1e-9)


def test_a_round_of_quantile_trees_keeps_the_rows_once(monkeypatch, papers):
    made = counted(monkeypatch, intervals)
    intervals.fit_quantile(papers, 0.9, rounds=3)
    assert len(made) == 1 + 3


def test_leaf_values_are_looked_up_by_place(spark):
    rows = spark.createDataFrame([(0,), (2,), (3,), (9,), (None,)], f"{intervals.LEAF} INT")
    assert [r["v"] for r in rows.select(intervals._value({0: 1.5, 3: -2.0}).alias("v")).collect()] == [1.5, 0.0, -2.0, 0.0, 0.0]
    assert {r["v"] for r in rows.select(intervals._value({}).alias("v")).collect()} == {0.0}
    plan = rows.select(intervals._value({0: 1.5, 3: -2.0}).alias("v"))._jdf.queryExecution().toString()
    assert "lambda" not in plan


def test_what_is_kept_leaves_no_shuffles_and_can_be_dropped(spark, tmp_path):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    shuffled = lambda: {f.name for f in local.rglob("shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get(storage.CLEANUP, None)
    for keep in (storage.durable, lambda df: storage.stored(df, "sums")):
        kept = keep(rows.repartition(5, "k").groupBy("k").agg(F.sum("id").alias("n")))
        assert storage.is_kept(kept) and not storage.is_kept(kept.select("k"))
        assert {r["k"]: r["n"] for r in kept.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
        at = Path(str(kept._kept_at).removeprefix("file:"))
        assert at.exists()
        storage.dropped(kept, rows)
        assert not at.exists()
    assert spark.conf.get(storage.CLEANUP, None) == setting
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before


def test_rounds_of_lists_give_the_whole_result(spark, monkeypatch):
    """Clustering and network sizes in rounds of a few entries are those of one round."""
    rng = random.Random(5)
    pairs = {(p, f"a{rng.randint(0, 14):02d}") for p in range(40) for _ in range(rng.randint(1, 6))}
    rows = spark.createDataFrame(sorted(pairs), "paper_id INT, author STRING").withColumn("published", F.lit("1999-01-01").cast("timestamp_ntz"))
    edges = storage.stored(coauthors.coauthor_edges(coauthors.incidence(rows)), "edges")
    whole = {r["author"]: r["clustering"] for r in centrality.clustering(edges).collect()}
    parts = {r["author"]: r["clustering"] for r in centrality.clustering(edges, block=3, at_once=80).collect()}
    assert parts == pytest.approx(whole)
    rounds, plain = [], graph_features._distinct_entries
    monkeypatch.setattr(graph_features, "_distinct_entries", lambda *given: rounds.append(1) or plain(*given))
    sizes = [graph_features.network_sizes(rows, edges, **limits).collect() for limits in ({}, {"at_once": 400, "rows_per_task": 9, "block": 4})]
    assert sorted(sizes[0]) == sorted(sizes[1]) and len(rounds) > 3
    # the caller's table is not deleted
    assert edges.count() == len(edges.collect())
