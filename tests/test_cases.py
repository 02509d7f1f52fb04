"""Small worked cases of the semantics each operator has to keep."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from impactlens.functions import columns as C
from impactlens.operators import cohorts, coauthors, digest, embeddings, explain, labels, meta_features, metrics, normalise, ranking, subscribers
from impactlens.operators.centrality import Incidence, clustering, component_sizes, connected_components, eigenvector, pagerank
from impactlens.operators.graph_features import FEATURES, author_statistics, paper_graph_features
from impactlens.sources import cache, feed, tables, works
from impactlens.storage import new_path

COUNTS = "ARRAY<STRUCT<year: INT, works_count: BIGINT, cited_by_count: BIGINT>>"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_clean_text_strips_all_whitespace_and_keeps_inner_runs(spark):
    assert one(spark, C.clean_text(F.col("t")), t="\n A\n B \t ") == "A  B"
    assert spark.sql("SELECT CAST(NULL AS STRING) t").select(C.clean_text(F.col("t")).alias("v")).first()["v"] == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("2021-03-04T05:06:07Z", dt.datetime(2021, 3, 4, 5, 6, 7)),
        ("2021-03-04T05:06:07+05:30", dt.datetime(2021, 3, 4, 5, 6, 7)),
        ("2021-03-04", dt.datetime(2021, 3, 4)),
        ("2021-13-04", None),
        ("yesterday", None),
        ("", None),
    ],
)
def test_iso_timestamp_drops_the_offset(spark, text, want):
    assert one(spark, C.iso_timestamp(F.col("t")), t=text) == want


def test_ids(spark):
    assert one(spark, C.id_from_url(F.col("t")), t="http://x/abs/2101.00001v2") == "2101.00001v2"
    assert one(spark, C.prefixed_id(F.col("t")), t="2101.1") == "arXiv:2101.1"
    assert one(spark, C.prefixed_id(F.col("t")), t="ARXIV:2101.1") == "ARXIV:2101.1"
    assert one(spark, C.join_key(F.col("t")), t="arXiv:2101.1v12") == "2101.1"


def test_manual_entry_keeps_empty_authors_but_does_not_count_them(spark):
    rows = spark.createDataFrame([("John Doe,, Jane ", "cs.AI, cs.LG"), ("A", "")], "authors STRING, categories STRING")
    a, b = feed.from_manual_entry(rows).collect()
    assert (a["authors"], a["n_authors"], a["primary_cat"]) == (["John Doe", "", "Jane"], 2, "cs.AI")
    assert b["primary_cat"] == "cs.LG"


def test_emails(spark):
    email = C.normalise_email(F.col("t"))
    assert one(spark, email, t="  A@B.Co \n") == "a@b.co"
    for bad in ("", "a@b", "a b@c.d", "@b.c", "a@@b.c"):
        assert not one(spark, C.valid_email(email), t=bad)


def test_paper_card(spark):
    rows = spark.createDataFrame([("p", "t", list("abcdefg"), "x" * 501), ("q", "t", [], "x" * 500)], "paper_id STRING, title STRING, authors ARRAY<STRING>, abstract STRING")
    a, b = feed.paper_card(rows).collect()
    assert a["lead_authors"] == list("abcde") and a["more_authors"] == 2 and a["abstract"] == "x" * 500 + "..."
    assert b["more_authors"] == 0 and b["abstract"] == "x" * 500


def test_category_window_bounds(spark):
    at = [dt.datetime(2022, 12, 31, 10), dt.datetime(2022, 12, 31), dt.datetime(2021, 1, 1), None]
    rows = spark.createDataFrame([(i, t, ["x", "cs.LG"]) for i, t in enumerate(at)], "paper_id INT, published TIMESTAMP_NTZ, categories ARRAY<STRING>")
    assert [r["paper_id"] for r in feed.category_window(rows, "cs.LG", "2021-01-01", "2022-12-31").collect()] == [2, 1]
    assert [r["paper_id"] for r in feed.category_window(rows, "cs.LG", "2021-01-01", "2022-12-31", 1).collect()] == [2]
    assert feed.category_window(rows, "cs.LG", "2021-01-01", "2022-12-31", 0).count() == 2


def test_feed_entry_without_parts(spark, tmp_path):
    body = (
        "<feed><entry><id>http://x/abs/1v1</id><title></title><author><name>A</name></author>"
        '<author/><category term="c1"/><category/></entry></feed>'
    )
    row = feed.parse_feed(spark.createDataFrame([(body,)], "body STRING")).first()
    assert (row["paper_id"], row["title"], row["abstract"]) == ("1v1", "", "")
    assert row["authors"] == ["A"] and row["categories"] == ["c1"] and row["published"] is None
    (tmp_path / "f.xml").write_text(body)
    assert feed.read_feed(spark, str(tmp_path)).first() == row


def label(spark, published, counts, as_of, horizon=12):
    rows = spark.createDataFrame([(published, counts)], f"published TIMESTAMP_NTZ, counts {COUNTS}")
    return rows.select(labels.calendar_label(F.col("counts"), F.col("published"), as_of, horizon).alias("v")).first()["v"]


def test_label_maturity_to_the_second(spark):
    counts = [(2021, None, 4)]
    assert label(spark, dt.datetime(2021, 1, 1, 0, 1), counts, "2022-01-01") is None
    assert label(spark, dt.datetime(2021, 1, 1), counts, "2022-01-01") == 4


def test_label_years(spark):
    at = dt.datetime(2021, 9, 1)
    assert label(spark, at, [(2021, 1, 3), (2022, 1, 5), (2023, 1, 9)], "2024-01-01") == 8
    assert label(spark, at, [], "2024-01-01") is None
    assert label(spark, at, None, "2024-01-01") is None
    assert label(spark, at, [(2019, 1, 4)], "2024-01-01") == 0
    assert label(spark, at, [(2021, 1, 3), (2021, 1, 7)], "2024-01-01") == 7
    assert label(spark, at, [(2021, 1, None), (None, 1, 5)], "2024-01-01") == 0


def test_prorated_label(spark):
    rows = spark.createDataFrame([(dt.datetime(2021, 9, 1), [(2021, 1, 8), (2022, 1, 12)])], f"published TIMESTAMP_NTZ, counts {COUNTS}")
    value = rows.select(labels.prorated_label(F.col("counts"), F.col("published"), "2024-01-01", 6).alias("v")).first()["v"]
    assert value == pytest.approx(8 + 12 * 2 / 12)  # four open months in 2021, two of the six left for 2022


def test_first_work_wins_and_empty_results_are_null(spark):
    bodies = [("a", '{"results":[{"id":"W1","counts_by_year":[{"year":2021,"cited_by_count":2}]},{"id":"W2"}]}'), ("b", '{"results":[]}'), ("c", "broken")]
    got = {r["paper_key"]: r for r in works.parse_works(spark.createDataFrame(bodies, "paper_key STRING, body STRING")).collect()}
    assert got["a"]["work_id"] == "W1" and got["a"]["counts_by_year"][0]["cited_by_count"] == 2
    assert got["b"]["work_id"] is None and got["c"]["work_id"] is None


def test_cache_treats_unreadable_as_miss(spark):
    requests = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k3", 4)], "key STRING, r INT")
    known = spark.createDataFrame([("k1", "x"), ("k2", None)], "key STRING, payload STRING")
    assert sorted(map(tuple, cache.misses(requests, known).collect())) == [("k2", 2), ("k3", 4)]
    assert [r["key"] for r in cache.hits(requests, known).collect()] == ["k1"]


def test_normalised_target(spark):
    d = dt.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(1, "a", d, 2), (2, "a", d, 4), (3, None, d, 9), (4, "b", None, 9)], "paper_id INT, primary_cat STRING, published TIMESTAMP_NTZ, y12 INT")
    got = {r["paper_id"]: r["y12_normalized"] for r in normalise.normalise_by_field(rows).collect()}
    assert got == {1: pytest.approx(2 / 3.1), 2: pytest.approx(4 / 3.1), 3: 0.0, 4: 0.0}


def test_week_is_monday_to_sunday(spark):
    rows = spark.createDataFrame([(dt.datetime(2021, 1, 3),), (dt.datetime(2021, 1, 4),)], "published TIMESTAMP_NTZ")
    assert [r["cohort"] for r in cohorts.with_cohort(rows).collect()] == ["2020-12-28", "2021-01-04"]


def test_average_ranks_and_percentiles(spark):
    rows = spark.createDataFrame([(i, "t", "c", float(s)) for i, s in enumerate([9, 3, 3, 1])], "paper_id INT, title STRING, primary_cat STRING, predicted_citations DOUBLE")
    full = {r["paper_id"]: (r["impact_rank"], r["impact_percentile"]) for r in ranking.impact_rank(rows).collect()}
    assert full == {0: (1.0, 100.0), 1: (2.5, 62.5), 2: (2.5, 62.5), 3: (4.0, 25.0)}
    top = ranking.top_by_impact(rows, 2).collect()
    assert [(r["paper_id"], r["impact_rank"], r["impact_percentile"]) for r in top] == [(0, 1.0, 100.0), (1, 2.5, 62.5)]


def ranked_rows(spark, rows):
    return spark.createDataFrame(rows, "paper_id INT, cohort STRING, y_true DOUBLE, y_pred DOUBLE")


def test_metrics_edge_cases(spark):
    few = ranked_rows(spark, [(i, "c", float(i), float(-i)) for i in range(5)])
    assert {r["value"] for r in metrics.precision_at_k(few).collect()} == {0.0}
    assert metrics.spearman(few).first()["value"] == pytest.approx(-1)
    flat = ranked_rows(spark, [(i, "c", float(i), 1.0) for i in range(5)])
    assert tuple(metrics.spearman(flat).first())[1:] == (None, "constant")
    zero = ranked_rows(spark, [(i, "c", 0.0, float(i)) for i in range(5)])
    assert metrics.mean_cohort_ndcg(zero, k_values=(3,)).first()["value"] == 0.0
    none = metrics.mean_cohort_ndcg(few, k_values=(10,)).first()
    assert (none["value"], none["status"]) == (0.0, "no cohort")
    negative = metrics.mean_cohort_ndcg(ranked_rows(spark, [(1, "c", -1.0, 1.0), (2, "c", 1.0, 2.0)]), k_values=(1,)).first()
    assert (negative["value"], negative["status"]) == (0.0, "negative truth")


def test_coverage_of_empty_tables(spark):
    empty = ranked_rows(spark, [])
    assert metrics.spearman(empty).first()["status"] == "empty"


@pytest.fixture(scope="module")
def graph(spark):
    papers = spark.createDataFrame(
        [(1, ["a", "b"]), (2, ["b", "c"]), (3, ["a"]), (4, ["d", "d"]), (5, ["e", "f"])], "paper_id INT, authors ARRAY<STRING>"
    ).withColumn("published", F.lit("2020-01-01").cast("timestamp_ntz"))
    late = spark.createDataFrame([(6, ["a", "z"])], "paper_id INT, authors ARRAY<STRING>").withColumn("published", F.lit("2021-01-01").cast("timestamp_ntz"))
    undated = spark.createDataFrame([(7, ["a", "y"])], "paper_id INT, authors ARRAY<STRING>").withColumn("published", F.lit(None).cast("timestamp_ntz"))
    return papers.unionByName(late).unionByName(undated)


def test_graph_construction(spark, graph):
    inc = coauthors.incidence(coauthors.authorship(graph), "2020-01-01")
    edges = coauthors.coauthor_edges(inc)
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 1), ("b", "c", 1), ("e", "f", 1)]
    assert sorted(r[0] for r in coauthors.nodes(edges).collect()) == list("abcef")
    assert {r["paper_id"] for r in coauthors.graph_papers(graph, "2020-01-01").collect()} == {1, 2, 5}
    prepared = Incidence(inc)
    components = connected_components(prepared)
    assert {r["author"]: r["component"] for r in components.collect()} == dict(a="a", b="a", c="a", e="e", f="e")
    largest = component_sizes(components).filter("is_largest").first()
    assert (largest["component"], largest["size"], largest["is_connected"]) == ("a", 3, False)
    leading = {r["author"]: r["eigenvector"] for r in eigenvector(prepared, components).collect()}
    assert leading["e"] == leading["f"] == 0 and leading["b"] > leading["a"] > 0
    assert sum(r["pagerank"] for r in pagerank(prepared).collect()) == pytest.approx(1)
    failed = pagerank(prepared, max_iter=1).first()
    assert failed["pagerank"] == 0.0 and not failed["converged"]


def test_clustering_of_a_triangle(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 4), ("c", "d", 1)], "u STRING, v STRING, weight BIGINT")
    got = {r["author"]: r["clustering"] for r in clustering(edges).collect()}
    assert got["a"] == got["b"] == pytest.approx(0.5)
    assert got["c"] == pytest.approx(2 * 0.5 / 6) and got["d"] == 0.0


def test_paper_features_of_unknown_and_missing_authors(spark, graph):
    inc = coauthors.incidence(coauthors.authorship(graph), "2020-01-01").persist()
    edges = coauthors.coauthor_edges(inc)
    stats = author_statistics(inc, edges)
    new = spark.createDataFrame([(10, []), (11, ["q"]), (12, ["a", "b"])], "paper_id INT, authors ARRAY<STRING>").withColumn("published", F.lit(None).cast("timestamp_ntz"))
    got = {r["paper_id"]: r for r in paper_graph_features(new, coauthors.authorship(new), stats, edges).collect()}
    assert all(got[p][f] == 0 for p in (10, 11) for f in FEATURES)
    assert got[12]["coauthor_network_size"] == 3  # a, b, c
    assert got[12]["max_degree_centrality"] == pytest.approx(2 / 4)


def test_one_hot_unseen_and_null(spark):
    fit = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "paper_id INT, c STRING")
    new = spark.createDataFrame([(4, "zz"), (5, None)], "paper_id INT, c STRING")
    assert [(r["paper_id"], r["feature"]) for r in meta_features.one_hot(fit, new, "c").collect()] == [(5, "c=(null)")]


def test_meta_vectors(spark):
    fit = spark.createDataFrame([("a", 1, 2), ("b", 2, 3), (None, 2, 3)], "primary_cat STRING, month INT, n_authors INT")
    model = meta_features.MetaFeaturizer().fit(fit)
    assert meta_features.category_names(model) == ["primary_cat=(null)", "primary_cat=a", "primary_cat=b", "month=1", "month=2"]
    new = spark.createDataFrame([("zz", 12, 2), (None, 1, 2)], "primary_cat STRING, month INT, n_authors INT")
    a, b = model.transform(new).collect()
    assert a["meta_cat"].toArray().tolist() == [0] * 5 and b["meta_cat"].toArray().tolist() == [1, 0, 0, 1, 0]


@pytest.mark.parametrize("values, scaled", [([2, 3], [4.0, 6.0]), ([4, 4], [4.0, 4.0])])
def test_scaling(spark, values, scaled):
    rows = spark.createDataFrame([(v,) for v in values], "n INT")
    scale = meta_features.population_scale(rows, "n")
    assert [v / scale for v in values] == scaled


def test_hybrid(spark):
    e, t = F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, embeddings.hybrid(e, t)) == pytest.approx([0.7, 0.3, 0.6])
    assert one(spark, embeddings.hybrid(None, t)) == pytest.approx([0.3, 0.6])
    with pytest.raises(ValueError):
        embeddings.hybrid()


def test_equal_texts_are_encoded_once(spark):
    papers = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (3, "u", None)], "paper_id INT, title STRING, abstract STRING")
    rows, new = embeddings.embed_papers(papers, lambda: embeddings.HashEncoder(8))
    assert rows.count() == 3 and new.count() == 2
    _, again = embeddings.embed_papers(papers, lambda: embeddings.HashEncoder(8), new)
    assert again.count() == 0


def test_explanation_lists_leave_zeros_out(spark):
    rows = spark.createDataFrame([(1, [0.0, -2.0, 1.0, 3.0], 0.5)], "paper_id INT, phi ARRAY<DOUBLE>, baseline DOUBLE")
    r = explain.explanations(rows, ["a", "b", "c"]).first()
    assert [tuple(x) for x in r["top_positive_features"]] == [("feature_3", 3.0), ("c", 1.0)]
    assert [tuple(x) for x in r["top_negative_features"]] == [("b", -2.0)]
    assert r["prediction"] == pytest.approx(2.5)


def test_digest_defaults_skip_zero_and_empty(spark):
    n = F.lit(None)
    assert one(spark, digest.either_number(F.lit(0.0), n.cast("double"), default=1.0)) == 1.0
    assert one(spark, digest.either_text(F.lit(""), F.lit("x"), default="Unknown")) == "x"
    assert one(spark, digest.or_unknown(F.lit(0))) == "0"
    assert one(spark, digest.fixed(F.lit(1.25), 1, "unknown")) in ("1.2", "1.3")


def test_subscription_fold(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    log = spark.createDataFrame(
        [(" A@b.c", "subscribe", t[0], 1), ("a@B.c", "subscribe", t[1], 2), ("a@b.c", "unsubscribe", t[2], 3), ("a@b.c", "subscribe", t[3], 4),
         ("x@y.z", "unsubscribe", t[0], 5), ("x@y.z", "subscribe", t[1], 6), ("x@y.z", "subscribe", t[2], 7), ("bad", "subscribe", t[0], 8)],
        "email STRING, action STRING, at TIMESTAMP_NTZ, seq BIGINT",
    )
    assert {r["email"]: r["created_at"] for r in subscribers.subscribers(log).collect()} == {"a@b.c": t[3], "x@y.z": t[1]}
    assert {r["seq"]: r["reply"] for r in subscribers.unsubscribe_replies(log).collect()} == {3: "Unsubscribed", 5: "Not found"}
    assert [r["email"] for r in subscribers.active_list(log).collect()] == ["a@b.c", "x@y.z"]
    assert subscribers.rejected_events(log).count() == 1


def test_dataset_round_trip(spark):
    rows = spark.createDataFrame([(str(i), dt.datetime(2019 + i % 3, 5, 1), ["a", "b"]) for i in range(30)], "paper_id STRING, published TIMESTAMP_NTZ, authors ARRAY<STRING>")
    path = new_path(spark, "roundtrip")
    assert {r["pub_year"]: r["n_rows"] for r in tables.write_dataset(rows, path).collect()} == {2019: 10, 2020: 10, 2021: 10}
    back = tables.read_dataset(spark, path, "paper_id STRING, published TIMESTAMP_NTZ, authors ARRAY<STRING>, pub_year INT")
    plan = back.filter("pub_year = 2020").select("paper_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pub_year" in plan and back.count() == 30


def test_flat_dataset(spark):
    rows = spark.createDataFrame([("A, B", "cs.AI", "2020-01-02T00:00:00", 3)], "authors STRING, categories STRING, published STRING, citations_12mo INT")
    r = feed.from_flat_dataset(rows).first()
    assert r["authors"] == ["A", "B"] and r["y12"] == 3 and r["published"] == dt.datetime(2020, 1, 2)


class StubContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class StubSession:
    def __init__(self, context, setting=None):
        self.sparkContext, self.conf = context, {"spark.checkpoint.dir": setting}


def test_shared_folder_comes_from_the_session():
    from impactlens.storage import shared_dir

    cluster = StubSession(StubContext("yarn"), "hdfs:///shared")
    assert shared_dir(cluster) == "hdfs:///shared" == cluster.sparkContext.folder
    with pytest.raises(RuntimeError):
        shared_dir(StubSession(StubContext("yarn")))
    local = StubSession(StubContext("local[2]"))
    assert shared_dir(local) == local.sparkContext.folder
