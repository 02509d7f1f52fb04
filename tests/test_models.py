"""Training, intervals, attributions, ranking, embeddings and streams."""

import datetime as dt
import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from impactlens.operators import explain, metrics, text_features
from impactlens.plans import dataset, ranker, scoring, training
from impactlens.storage import new_path
from impactlens.streaming import jobs

rng = np.random.default_rng(3)
WORDS = "graph neural citation impact spark window model rank author field".split()


@pytest.fixture(scope="module")
def papers(spark):
    rows = []
    for i in range(240):
        words = rng.choice(WORDS, 8)
        n = int(rng.integers(1, 6))
        rows.append(
            (i, dt.datetime(2018, 1, 1) + dt.timedelta(days=3 * i), str(rng.choice(["a", "b"])), " ".join(words[:3]), " ".join(words[3:]),
             int(1 + i % 12), n, int(10 * n + 5 * list(words).count("impact") + rng.integers(0, 3)))
        )
    schema = "paper_id INT, published TIMESTAMP_NTZ, primary_cat STRING, title STRING, abstract STRING, month INT, n_authors INT, y12 INT"
    return spark.createDataFrame(rows, schema).persist()


@pytest.fixture(scope="module")
def trained(papers):
    return training.train_baseline(
        papers, featurizer=text_features.TextFeaturizer(max_features=200, n_components=6), max_iter=4, max_depth=3
    )


def test_time_split_is_disjoint_and_ordered(papers):
    got = {r["split"]: r for r in training.split_by_time(papers).groupBy("split").agg(F.min("published").alias("a"), F.max("published").alias("b"), F.count("*").alias("n")).collect()}
    assert got["train"]["b"] < got["validation"]["a"] and got["validation"]["b"] < got["test"]["a"]
    assert sum(r["n"] for r in got.values()) == 240 and got["test"]["n"] == pytest.approx(48, abs=1)


def test_round_trip_and_learning(spark, papers, trained):
    made, report = trained
    assert report["r2_12"] > 0.5 and len(made.feature_names) == 6 + 2 + 12 + 1
    path = new_path(spark, "model")
    made.save(spark, path)
    again = training.Artifacts.load(spark, path)
    a, b = (training.predict(papers, m).select("paper_id", "prediction", F.size(vector_to_array("features")).alias("w")) for m in (made, again))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.first()["w"] == len(made.feature_names) and {h: sorted(map(str, t.collect())) for h, t in again.intervals.items()} == {
        h: sorted(map(str, t.collect())) for h, t in made.intervals.items()
    }


def test_intervals_cover_held_out_rows(papers, trained):
    made, _ = trained
    rows = training.predict_with_uncertainty(training.split_by_time(papers).filter("split = 'validation'"), made)
    covered = rows.agg(F.avg(F.col("y12").between(F.col("q10"), F.col("q90")).cast("double"))).first()[0]
    assert 0.7 <= covered <= 0.95
    made_without = training.Artifacts(made.meta_encoder, made.models, made.text_model)
    row = training.predict_with_uncertainty(papers, made_without).first()
    assert row["q10"] is None and row["mean"] is not None


def test_newest_week_is_scored_and_written(spark, papers, trained):
    path = new_path(spark, "weekly")
    rows = scoring.score_newest_week(papers, trained[0], path).collect()
    assert rows and len({(r["published"] - dt.timedelta(days=r["published"].weekday())).date() for r in rows}) == 1
    assert spark.read.json(path).count() == len(rows)


def test_text_vectors_equal_brute_force_tfidf(spark):
    docs = ["spark graph spark", "graph rank", "x y"]
    rows = spark.createDataFrame([(i, d, None) for i, d in enumerate(docs)], "paper_id INT, title STRING, abstract STRING")
    got = {(r["paper_id"], r["term"]): r["weight"] for r in text_features.tfidf(rows).collect()}
    tf = [{"spark": 2, "graph": 1, "spark graph": 1, "graph spark": 1}, {"graph": 1, "rank": 1, "graph rank": 1}]
    df = {t: sum(t in d for d in tf) for d in tf for t in d}
    for i, d in enumerate(tf):
        w = {t: c * (np.log(4 / (1 + df[t])) + 1) for t, c in d.items()}
        size = np.sqrt(sum(x * x for x in w.values()))
        for t in w:
            assert got[i, t] == pytest.approx(w[t] / size)
    assert not [k for k in got if k[0] == 2]


def test_svd_keeps_the_gram_matrix_and_pads(spark):
    docs = [" ".join(rng.choice(WORDS, 6)) for _ in range(12)]
    rows = spark.createDataFrame([(i, d, "") for i, d in enumerate(docs)], "paper_id INT, title STRING, abstract STRING")
    model = text_features.TextFeaturizer(max_features=500, n_components=600, min_df=1).fit(rows)
    out = model.transform(rows).select("paper_id", vector_to_array("tfidf").alias("x"), vector_to_array("text_emb").alias("z")).orderBy("paper_id").collect()
    x, z = np.array([r["x"] for r in out]), np.array([r["z"] for r in out])
    assert z.shape[1] == 600
    assert z @ z.T == pytest.approx(x @ x.T, abs=1e-8)


def test_svd_finds_the_singular_vectors_in_few_passes(spark):
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(5)
    a = np.where(draw.random((200, 700)) < 0.05, draw.random((200, 700)), 0.0) * np.linspace(1, 0.01, 700)
    a[7] = 0.0
    rows = [(Vectors.dense(r) if i % 2 else Vectors.sparse(700, np.flatnonzero(r).tolist(), r[r != 0].tolist()),) for i, r in enumerate(a)]
    spark.sparkContext.setJobGroup("few passes", "")
    got = text_features.svd_basis(spark.createDataFrame(rows, ["v"]).repartition(3), "v", 40)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few passes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = np.linalg.svd(a)[2][:40].T
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)
    assert len(jobs) < 50  # one vector at a time took two jobs for each of some eighty


def test_min_df_falls_back_when_it_prunes_all(spark):
    rows = spark.createDataFrame([(1, "only here", "")], "paper_id INT, title STRING, abstract STRING")
    assert text_features.tfidf(rows, min_df=5).count() == 3


def test_texts_are_counted_once_when_min_df_falls_back(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "only here", ""), (2, "here twice here", "")], "paper_id INT, title STRING, abstract STRING")
    calls, kept = [], text_features.durable
    monkeypatch.setattr(text_features, "durable", lambda df: calls.append(1) or kept(df))
    wanted = {1: ["here", "here twice", "only", "only here"], 2: ["here"], 3: ["here", "here twice", "only", "only here"]}
    for least, terms in wanted.items():
        calls.clear()
        assert sorted(r["term"] for r in text_features.vocabulary(rows, 4, least).collect()) == terms
        assert len(calls) == 1


@pytest.mark.parametrize("counted", [3, 1 << 20])
def test_terms_of_some_documents_are_one_row_each(monkeypatch, counted):
    from collections import Counter

    import pyarrow as pa

    docs = [[], *([str(w) for w in rng.choice(WORDS[:4], n)] for n in (1, 7, 0, 2, 40, 3)), []]
    monkeypatch.setattr(text_features, "COUNTED", counted)
    rows = pa.concat_tables(pa.Table.from_batches([b]) for b in text_features._term_counts(iter([pa.record_batch({"_tokens": docs})]))).to_pylist()
    terms = [d + [f"{a} {b}" for a, b in itertools.pairwise(d)] for d in docs]
    cf, df = Counter(t for d in terms for t in d), Counter(t for d in terms for t in set(d))
    for kind, want in (("cf", cf), ("df", df)):
        got = Counter()
        for r in rows:
            got[r["term"]] += r[kind]
        assert got == want
    if counted > 100:  # not a row for each place, as there was
        assert len(rows) == len(cf)


def test_feature_shapes_of_two_tiny_papers(spark):
    rows = spark.createDataFrame([(1, "A", "foo bar"), (2, "B", "baz qux")], "paper_id INT, title STRING, abstract STRING")
    out = text_features.TextFeaturizer(max_features=100, n_components=8).fit(rows).transform(rows)
    assert [len(r["text_emb"]) for r in out.collect()] == [8, 8]


def brute_shapley(nodes, x, n_features):
    def value(subset, at=0):
        node = nodes[at]
        if node["leftChild"] < 0:
            return node["prediction"]
        split, kids = node["split"], (node["leftChild"], node["rightChild"])
        if split["featureIndex"] in subset:
            return value(subset, kids[0] if x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0] else kids[1])
        return sum(nodes[k]["rawCount"] / node["rawCount"] * value(subset, k) for k in kids)

    phi = np.zeros(n_features)
    for f in range(n_features):
        rest = [g for g in range(n_features) if g != f]
        for size in range(n_features):
            for s in itertools.combinations(rest, size):
                weight = factorial(size) * factorial(n_features - 1 - size) / factorial(n_features)
                phi[f] += weight * (value({*s, f}) - value(set(s)))
    return phi


def test_tree_attributions_equal_brute_force(spark):
    from pyspark.ml.feature import VectorAssembler

    x = rng.normal(size=(80, 3)).round(2)
    rows = spark.createDataFrame([(i, *map(float, v), float(v[0] * v[1] + v[2])) for i, v in enumerate(x)], "paper_id INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).persist()
    model = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(rows)
    out = explain.tree_attributions(rows, model).join(model.transform(rows).select("paper_id", "prediction"), "paper_id").collect()
    path = new_path(spark, "trees")
    model.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        node = r["nodeData"].asDict(recursive=True)
        trees.setdefault(r["treeID"], {})[node["id"]] = node
    for r in out:
        assert r["baseline"] + sum(r["phi"]) == pytest.approx(r["prediction"])
        if r["paper_id"] < 10:
            want = sum(w * brute_shapley(trees[t], x[r["paper_id"]], 3) for t, w in enumerate(model.treeWeights))
            assert r["phi"] == pytest.approx(list(want))


def background_value(nodes, x, z, subset):
    """The leaf of a row with x's values for the features of the subset, z's for the others."""
    at = 0
    while nodes[at]["leftChild"] >= 0:
        node = nodes[at]
        f = node["split"]["featureIndex"]
        left = (x if f in subset else z)[f] <= node["split"]["leftCategoriesOrThreshold"][0]
        at = node["leftChild"] if left else node["rightChild"]
    return nodes[at]["prediction"]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_background_attributions_equal_enumeration(spark, kind):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x = rng.normal(size=(90, 4)).round(1)  # ties and repeated values
    rows = spark.createDataFrame([(i, *map(float, v), float(v[0] * v[1] + v[2])) for i, v in enumerate(x)], "paper_id INT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, y DOUBLE")
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(rows).persist()
    learner = GBTRegressor(labelCol="y", maxIter=3, maxDepth=4, seed=1) if kind == "boosted" else RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1)
    model = learner.fit(rows)
    sample = explain.background_sample(rows, 12)
    out = explain.background_attributions(rows, model, sample).join(model.transform(rows).select("paper_id", "prediction"), "paper_id").collect()
    assert len(out) == 90
    mean = model.transform(sample).agg(F.avg("prediction")).first()[0]
    path = new_path(spark, "trees")
    model.write().save(path)
    trees = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        node = r["nodeData"].asDict(recursive=True)
        trees.setdefault(r["treeID"], {})[node["id"]] = node
    scale = list(model.treeWeights) if kind == "boosted" else [1 / 3] * 3
    z = [x[r["paper_id"]] for r in sample.select("paper_id").collect()]
    for r in out:
        assert r["baseline"] == pytest.approx(mean) and r["baseline"] + sum(r["phi"]) == pytest.approx(r["prediction"])
        if r["paper_id"] < 6:
            want = np.zeros(4)
            for f in range(4):
                rest = [g for g in range(4) if g != f]
                for s in (set(c) for size in range(4) for c in itertools.combinations(rest, size)):
                    weight = factorial(len(s)) * factorial(3 - len(s)) / factorial(4)
                    gains = [scale[t] * (background_value(n, x[r["paper_id"]], b, s | {f}) - background_value(n, x[r["paper_id"]], b, s)) for t, n in trees.items() for b in z]
                    want[f] += weight * sum(gains) / len(z)
            assert r["phi"] == pytest.approx(list(want))
    with pytest.raises(ValueError, match="background"):
        explain.background_attributions(rows, model, sample.limit(0))
    assert explain.background_attributions(rows.limit(0), model, sample).count() == 0


@pytest.mark.parametrize("tabled", [0, 6])
def test_attributions_do_work_by_pattern(spark, monkeypatch, tabled):
    """A leaf is explained once for each pattern of its path, not for each row; looked up or worked out in the batch, the values are the same."""
    from pyspark.ml.linalg import Vectors

    x = rng.integers(0, 4, size=(3000, 4)).astype(float)
    given = [(i, Vectors.dense(v), float(v[0] * v[1] + v[2])) for i, v in enumerate(x)]
    rows = spark.createDataFrame(given, ["paper_id", "features", "y"]).coalesce(1).persist()
    model = GBTRegressor(labelCol="y", maxIter=3, maxDepth=4, seed=1).fit(rows)
    monkeypatch.setattr(explain, "TABLED", tabled)
    sample = explain.background_sample(rows, 20)
    most = 1 << 4

    def few(work):
        def checked(hit, *others):
            assert len(hit) <= most, f"{len(hit)} rows for at most {most} patterns"
            return work(hit, *others)

        return checked

    monkeypatch.setattr(explain, "leaf_shapley", few(explain.leaf_shapley))
    monkeypatch.setattr(explain, "leaf_contrast", few(explain.leaf_contrast))
    scored = model.transform(rows).select("paper_id", "prediction")
    for phi in (explain.tree_attributions(rows, model), explain.background_attributions(rows, model, sample)):
        out = phi.join(scored, "paper_id").collect()
        assert len(out) == 3000
        for r in out:
            assert r["baseline"] + sum(r["phi"]) == pytest.approx(r["prediction"])


def test_rank_gradients_run_no_function_per_pair(spark):
    """Every row meets up to 30 leaders; what is done for a pair is compiled, no lambda is interpreted for it."""
    from impactlens.operators.skew import count_keys

    rows = spark.createDataFrame([(i, f"c{i % 3}", float(rng.integers(0, 4)), float(rng.normal())) for i in range(200)], "paper_id INT, cohort STRING, y DOUBLE, score DOUBLE")
    out = ranker.gradients(rows, count_keys(rows, "cohort"), ranker.ideal_dcg(rows, 5), 5)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["paper_id"]: (r["g"], r["h"]) for r in out.collect()}
    want = {}
    disc = lambda p: 1 / np.log2(1 + p) if p <= 5 else 0.0
    for c in ("c0", "c1", "c2"):
        own = sorted((r for r in rows.collect() if r["cohort"] == c), key=lambda r: (-r["score"], r["paper_id"]))
        ideal = sum(y * disc(i) for i, y in enumerate(sorted((r["y"] for r in own), reverse=True), 1))
        for (i, a), (j, b) in itertools.combinations(enumerate(own, 1), 2):
            if i > 5 or a["y"] == b["y"]:
                continue
            weight, sign = abs(a["y"] - b["y"]) * abs(disc(i) - disc(j)) / ideal, 1 if a["y"] > b["y"] else -1
            doubt = 1 / (1 + np.exp(sign * (a["score"] - b["score"])))
            for r, s in ((a, sign), (b, -sign)):
                g, h = want.get(r["paper_id"], (0.0, 0.0))
                want[r["paper_id"]] = (g + s * doubt * weight, h + doubt * (1 - doubt) * weight)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_ranker_improves_on_no_ranking(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = [(i, f"c{i % 6}", float(rng.normal()), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "paper_id INT, cohort STRING, a DOUBLE, b DOUBLE").withColumn("y", F.floor(F.greatest(2 * F.col("a") + 3, F.lit(0.0))))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).persist()
    scored = ranker.train_ranker(df, rounds=3).score(df)
    got = metrics.mean_cohort_ndcg(scored.select("paper_id", "cohort", F.col("y").alias("y_true"), F.col("score").alias("y_pred")), k_values=(10,)).first()["value"]
    assert got > 0.9


def test_ndcg_and_spearman_against_brute_force(spark):
    y, p = rng.integers(0, 4, 40), rng.integers(0, 6, 40)
    df = spark.createDataFrame([(i, float(y[i]), float(p[i])) for i in range(40)], "paper_id INT, y_true DOUBLE, y_pred DOUBLE")

    def dcg(score, k):
        order, at, total = sorted(set(score), reverse=True), 0, 0.0
        for s in order:
            tied = y[score == s]
            total += sum(tied.mean() / np.log2(2 + i) for i in range(at, at + len(tied)) if i < k)
            at += len(tied)
        return total

    assert metrics.ndcg_at_k(df, 10).first()["value"] == pytest.approx(dcg(p, 10) / dcg(y, 10))
    ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in (y, p)]
    assert metrics.spearman(df).first()["value"] == pytest.approx(np.corrcoef(*ranks)[0, 1])


def test_dataset_job(spark):
    feed = spark.createDataFrame(
        [("2001.1v2", "T", "A", ["cs.LG"], ["x"], "2020-01-05T00:00:00Z", None), ("2001.2", "T", "A", ["cs.LG"], [], "2020-02-01T00:00:00Z", None),
         ("2001.3", "T", "A", ["cs.LG"], [], "soon", None), ("2001.4", "T", "A", ["stat"], [], "2020-02-01", None)],
        "paper_id STRING, title STRING, abstract STRING, categories ARRAY<STRING>, authors ARRAY<STRING>, published STRING, updated STRING",
    )
    works = spark.createDataFrame([("arXiv:2001.1", "W1", [(2020, 1, 4)]), ("2001.1", "W9", [(2020, 1, 9)])], "paper_key STRING, work_id STRING, counts_by_year ARRAY<STRUCT<year: INT, works_count: BIGINT, cited_by_count: BIGINT>>")
    rows = dataset.build_dataset(feed, works, "cs.LG", "2020-01-01", "2020-12-31", "2022-01-01").collect()
    assert [(r["paper_id"], r["y12"], r["work_id"], r["n_authors"], r["primary_cat"], r["month"]) for r in rows] == [("2001.1v2", 4, "W1", 1, "cs.LG", 1)]


def test_streams_over_several_batches(spark):
    land, out, ck = (new_path(spark, n) for n in ("land", "out", "ck"))
    schema = "email STRING, action STRING, at TIMESTAMP_NTZ, seq BIGINT"
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    batches = [
        [("a@b.c", "subscribe", t[0], 1), ("x@y.z", "subscribe", t[1], 2), ("nobody", "subscribe", t[1], 9)],
        [("a@b.c", "subscribe", t[2], 3), ("x@y.z", "unsubscribe", t[3], 4)],
        [("a@b.c", "unsubscribe", t[4], 5), ("a@b.c", "subscribe", t[5], 6), ("n@e.w", "unsubscribe", t[5], 13)],
        # all late: before an unsubscribe that is known, or subscribing after it
        [("x@y.z", "subscribe", t[2], 10), ("a@b.c", "unsubscribe", t[3], 12), ("n@e.w", "subscribe", t[4], 14), ("n@e.w", "subscribe", t[6], 15)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        jobs.keep_subscribers(spark.readStream.schema(schema).parquet(land), out, ck).awaitTermination()
    got = {r["email"]: r["created_at"] for r in jobs.current_subscribers(spark, out).collect()}
    assert got == {"a@b.c": t[5], "x@y.z": None, "n@e.w": t[6]}
    assert jobs.written_batches(spark, out) == [0, 1, 2, 3] and jobs.written_batches(spark, out, 2) == [0, 1]
    assert jobs.written_batches(spark, out + "-none") == []
    # a retry of the last batch replaces it and changes nothing
    again = spark.createDataFrame(batches[3], schema)
    events = jobs._open_events(spark, out, 3).unionByName(jobs.subscribers.valid_events(again))
    assert sorted(map(tuple, jobs.subscribers.open_events(events).collect())) == sorted(map(tuple, jobs._open_events(spark, out).collect()))


def test_cache_stream_computes_each_key_once(spark):
    land, out, ck = (new_path(spark, n) for n in ("land", "out", "ck"))
    for keys in (["k1", "k2", "k1"], ["k2", "k3"]):
        spark.createDataFrame([(k, k * 2) for k in keys], "key STRING, text STRING").coalesce(1).write.mode("append").parquet(land)
        stream = spark.readStream.schema("key STRING, text STRING").parquet(land)
        jobs.fill_cache(stream, lambda b: b.select("key", F.length("text").cast("string").alias("payload")), out, ck).awaitTermination()
    assert sorted((r["key"], r["payload"], r["batch"]) for r in spark.read.parquet(out).collect()) == [("k1", "4", 0), ("k2", "4", 0), ("k3", "4", 1)]


def test_transformer_and_graph_features_over_two_horizons(papers):
    from impactlens.operators.embeddings import HashEncoder, embed_papers
    from impactlens.operators.graph_features import FEATURES

    vectors, _ = embed_papers(papers, lambda: HashEncoder(4))
    rows = papers.join(vectors, "paper_id").withColumns({f: (F.col("paper_id") % 7).cast("double") for f in FEATURES})
    made, report = training.train(
        rows.withColumn("y24", F.col("y12") * 2), {12: "y12", 24: "y24"}, "transformer", graph=True, max_iter=2, max_depth=2
    )
    assert made.feature_names[:4] == [f"text_emb_{i}" for i in range(4)] and made.feature_names[-10:] == FEATURES
    assert set(made.models) == {12, 24} and {"mae_12", "spearman_24"} <= set(report)
    assert training.predict(rows, made, 24).count() == 240
    with pytest.raises(ValueError):
        training.train(rows, text_encoder="unknown")


def test_a_missing_metric_is_not_finite(spark):
    from impactlens.catalog import models

    got = models._finite(spark, {"a": 1.0, "b": None, "c": float("nan")}).collect()
    assert {r["metric"]: r["finite"] for r in got} == {"a": True, "b": False, "c": False}


def test_model_queries_run_with_the_defaults(spark, monkeypatch):
    from impactlens.catalog import models

    class Stop(Exception):
        pass

    def stop(*args, **settings):
        seen.append((args[2] if len(args) > 2 else settings.pop("text_encoder", "tfidf"), settings))
        raise Stop

    seen = []
    monkeypatch.setattr(training, "train", stop)
    monkeypatch.setattr(training, "train_baseline", stop)
    monkeypatch.setattr(ranker, "train_ranker", lambda rows, **settings: stop(rows, **settings))
    for query in (models.m1, models.m4, models.m5, models.m6):
        with pytest.raises(Stop):
            query(spark, "/root/testdata/sf0.001")
    assert [encoder for encoder, _ in seen] == ["tfidf", "hybrid", "none", "tfidf"] and not any(settings for _, settings in seen)
