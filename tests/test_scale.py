"""Skewed inputs and forced splitting must not change any result; plans must not degrade."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactlens.catalog import QUERIES
from impactlens.operators import centrality, coauthors, graph_features, neighbours, ordering, ranking, skew, subscribers
from impactlens.plans import ranker

rng = np.random.default_rng(7)


def skewed(spark, n=3000, keys=50):
    """A third of the rows share key 0."""
    k = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, keys, n))
    rows = [(i, int(k[i]), int(rng.integers(0, 40))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "paper_id INT, k INT, v INT")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    _, left = skewed(spark)
    left = left.unionByName(spark.createDataFrame([(-1, None, 1)], "paper_id INT, k INT, v INT"))
    right = spark.createDataFrame([(i, f"r{j}") for i in range(0, 40) for j in range(i % 3)], "k INT, name STRING")
    hot = skew.hot_keys(skew.count_keys(left, "k"), "k", rows_per_task=10)
    assert 0 < hot.count() <= 128
    got = skew.spread_join(left, right, "k", how, rows_per_task=10)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_split(spark):
    _, left = skewed(spark)
    hot = skew.hot_keys(skew.count_keys(left, "k"), "k", rows_per_task=50)
    per_slot = skew.assign_slot(left, hot, "k").filter("k = 0").groupBy("_slot").count().collect()
    assert len(per_slot) > 10 and max(r["count"] for r in per_slot) < 200


@pytest.mark.parametrize("rows_per_range", [9, 10**6])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_ordered_counts(spark, by, rows_per_range):
    rows, df = skewed(spark)
    got = ordering.ordered_counts(df, "v", by, rows_per_range=rows_per_range).collect()
    groups = {g: [r[2] for r in rows if not by or r[1] == g] for g in ({r[1] for r in rows} if by else {None})}
    want = {(g, v): (vs.count(v), sum(x < v for x in vs), len(vs)) for g, vs in groups.items() for v in set(vs)}
    assert {(r["k"] if by else None, r["v"]): (r["cnt"], r["before"], r["total"]) for r in got} == want


@pytest.mark.parametrize("kind", ["timestamp", "string", "date"])
def test_ordered_counts_of_other_types(spark, kind):
    _, df = skewed(spark)
    made = {"string": F.concat(F.lit("v"), F.lpad("v", 3, "0")), "date": F.date_add(F.lit("2020-01-01"), F.col("v"))}
    value = made.get(kind, F.timestamp_seconds(F.col("v")))
    got = ordering.ordered_counts(df.withColumn("w", value), "w", rows_per_range=5).orderBy("w").collect()
    want = ordering.ordered_counts(df, "v").orderBy("v").collect()
    assert [(r["cnt"], r["before"], r["total"]) for r in got] == [(r["cnt"], r["before"], r["total"]) for r in want]


@pytest.mark.parametrize("rows_per_range", [9, 10**6])
def test_quantiles_interpolate(spark, rows_per_range):
    rows, df = skewed(spark)
    got = {r["k"]: r for r in ordering.quantiles(df, "v", {"a": 0.1, "m": 0.5}, ("k",), rows_per_range=rows_per_range).collect()}
    for k in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == k]
        assert got[k]["a"] == pytest.approx(np.percentile(values, 10)) and got[k]["m"] == pytest.approx(np.median(values))


def test_pairs_of_a_large_paper_by_blocks(spark):
    members = {1: [f"a{i}" for i in range(40)], 2: ["a1", "a2"], 3: ["a3"]}
    inc = spark.createDataFrame([(p, a, len(m)) for p, m in members.items() for a in m], "paper_id INT, author STRING, n_authors INT")
    got = [tuple(r) for r in coauthors.author_pairs(inc, block=3).collect()]
    want = [(p, *sorted(x)) for p, m in members.items() for x in itertools.combinations(m, 2)]
    assert sorted(got) == sorted(want)


def random_graph(spark, n_papers=60, n_authors=25):
    papers = [sorted({int(a) for a in rng.integers(0, n_authors, rng.integers(2, 6))} | ({0} if rng.random() < 0.4 else set())) for _ in range(n_papers)]
    papers = [p for p in papers if len(p) > 1]
    rows = [(i, f"n{a:02d}", len(p)) for i, p in enumerate(papers) for a in p]
    w = np.zeros((n_authors, n_authors))
    for p in papers:
        for a, b in itertools.permutations(p, 2):
            w[a, b] += 1
    return spark.createDataFrame(rows, "paper_id INT, author STRING, n_authors INT"), w


def by_author(df, column):
    return {int(r["author"][1:]): r[column] for r in df.collect()}


@pytest.fixture(params=[False, True], ids=["plain", "hot keys split"])
def split(request, monkeypatch):
    if request.param:
        plain = skew.hot_keys
        monkeypatch.setattr(centrality, "hot_keys", lambda c, k: plain(c, k, rows_per_task=3))
    return request.param


def test_centralities_against_matrices(spark, split):
    inc, w = random_graph(spark)
    live = np.flatnonzero(w.sum(1))
    n = len(live)
    prepared = centrality.Incidence(inc)
    assert (prepared._hot_papers is not None) == split
    got = by_author(centrality.pagerank(prepared, max_iter=4, tol=None), "pagerank")
    x = np.full(n, 1 / n)
    sub = w[np.ix_(live, live)]
    for _ in range(4):
        x = 0.15 / n + 0.85 * sub.T @ (x / sub.sum(1))
    assert [got[a] for a in live] == pytest.approx(list(x))
    components = centrality.connected_components(prepared)
    leading = centrality.eigenvector(prepared, components, max_iter=4, tol=None)
    names = by_author(components, "component")
    largest = max(set(names.values()), key=lambda c: (list(names.values()).count(c), [-ord(ch) for ch in c]))
    inside = np.array([names[a] == largest for a in live])
    y = inside / inside.sum()
    for _ in range(4):
        y = y + sub @ y
        y = y / np.linalg.norm(y)
    assert [by_author(leading, "eigenvector")[a] for a in live] == pytest.approx(list(y), abs=1e-12)
    prepared.release()


def test_components_of_a_long_chain_close_fast(spark):
    chain = [(i, f"n{a:03d}", 2) for i in range(99) for a in (i, i + 1)]
    prepared = centrality.Incidence(spark.createDataFrame(chain, "paper_id INT, author STRING, n_authors INT"))
    got = centrality.connected_components(prepared, max_iter=12)
    assert {r["component"] for r in got.collect()} == {"n000"}
    prepared.release()


def test_clustering_against_brute_force(spark):
    inc, w = random_graph(spark)
    got = by_author(centrality.clustering(coauthors.coauthor_edges(inc)), "clustering")
    blocks = by_author(centrality.clustering(coauthors.coauthor_edges(inc), block=2), "clustering")
    assert blocks == pytest.approx(got)
    v = np.cbrt(w / w.max())
    for a in np.flatnonzero(w.sum(1)):
        d = np.count_nonzero(w[a])
        want = (v @ v @ v)[a, a] / (d * (d - 1)) if d > 1 else 0
        assert got[a] == pytest.approx(want)


@pytest.mark.parametrize("pivots, block", [(3, 16), (40, 7), (5, 4096)])
def test_nearest_older_with_a_mass_of_copies(spark, pivots, block):
    vectors = rng.normal(size=(120, 6)).round(3)
    vectors[rng.random(120) < 1 / 3] = vectors[0]
    vectors[50] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "paper_id BIGINT, embedding ARRAY<DOUBLE>")
    got = {}
    for r in neighbours.nearest_older(df, 4, pivots=pivots, block=block).collect():
        got.setdefault(r["paper_id"], {})[r["position"]] = r["neighbour"]
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1) == 0, 1, np.linalg.norm(vectors, axis=1))[:, None]
    for i in range(120):
        if i == 50:
            assert i not in got
            continue
        s = (unit[:i] @ unit[i]).round(12)
        want = [j for j in np.lexsort((np.arange(i), -s)) if j != 50][:4]
        assert [got.get(i, {}).get(p) for p in range(1, len(want) + 1)] == want


def test_nearest_older_writes_no_row_for_every_cell(spark, monkeypatch):
    counts, kept = [], neighbours.durable

    def counted(df):
        out = kept(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "durable", counted)
    vectors = rng.normal(size=(300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "paper_id BIGINT, embedding ARRAY<DOUBLE>")
    assert neighbours.nearest_older(df, 4, pivots=40, block=7).count() == 1 + 2 + 3 + 4 * 296
    assert max(counts) == 300


def test_replies_do_not_depend_on_slices(spark):
    actions = rng.choice(["subscribe", "unsubscribe"], 400)
    who = np.where(rng.random(400) < 0.5, 0, rng.integers(1, 9, 400))
    log = spark.createDataFrame(
        [(f"u{who[i]}@x.y", str(actions[i]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(i // 3)), i) for i in range(400)],
        "email STRING, action STRING, at TIMESTAMP_NTZ, seq INT",
    )
    active, want = set(), {}
    for i in range(400):
        if actions[i] == "subscribe":
            active.add(who[i])
        else:
            want[i] = "Unsubscribed" if who[i] in active else "Not found"
            active.discard(who[i])
    for rows in (10**6, 20, 3):
        assert {r["seq"]: r["reply"] for r in subscribers.unsubscribe_replies(log, rows).collect()} == want
    assert {r["email"] for r in subscribers.subscribers(log).collect()} == {f"u{w}@x.y" for w in active}


def test_rank_gradients_cover_each_pair_once(spark):
    n = 25
    y, s = rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    rows = spark.createDataFrame([(i, "c", float(y[i]), float(s[i])) for i in range(n)], "paper_id INT, cohort STRING, y DOUBLE, score DOUBLE").cache()
    got = {r["paper_id"]: (r["g"], r["h"]) for r in ranker.gradients(rows, skew.count_keys(rows, "cohort"), ranker.ideal_dcg(rows, 6), 6).collect()}
    order = sorted(range(n), key=lambda i: (-s[i], i))
    disc = {i: (1 / np.log2(2 + p) if p < 6 else 0.0) for p, i in enumerate(order)}
    ideal = sum(v / np.log2(2 + p) for p, v in enumerate(sorted(y, reverse=True)[:6]))
    g, h = np.zeros(n), np.zeros(n)
    for i, j in itertools.permutations(range(n), 2):
        if y[i] > y[j] and (disc[i] or disc[j]):
            weight = (y[i] - y[j]) * abs(disc[i] - disc[j]) / ideal
            rho = 1 / (1 + np.exp(s[i] - s[j]))
            for k, sign in ((i, 1), (j, -1)):
                g[k] += sign * rho * weight
                h[k] += rho * (1 - rho) * weight
    for i, (a, b) in got.items():
        assert a == pytest.approx(g[i]) and b == pytest.approx(h[i])


def test_top_per_group_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = ranking.top_per_group(df, "k", 3, "v")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_what_is_asked(spark, sf):
    plan = QUERIES["s8_dataset_scan"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_wedges_travel_as_lists(spark):
    """No row of a wedge is shuffled: the ends behind an edge go to its middle as one list."""
    inc, _ = random_graph(spark)
    plan = centrality.clustering(coauthors.coauthor_edges(inc))._jdf.queryExecution().toString()
    assert "array_intersect" in plan


@pytest.mark.parametrize("limits", [{}, {"rows_per_task": 7, "block": 3}])
def test_network_sizes_of_papers_dealt_to_tasks(spark, limits):
    inc, w = random_graph(spark)
    edges = coauthors.coauthor_edges(inc)
    rows = inc.select("paper_id", "author").collect()
    near = {}
    for r in edges.collect():
        near.setdefault(r["u"], set()).add(r["v"])
        near.setdefault(r["v"], set()).add(r["u"])
    want = {}
    for r in rows:
        want.setdefault(r["paper_id"], set()).update(near.get(r["author"], ()))
    found = graph_features.network_sizes(inc.select("paper_id", "author"), edges, **limits)
    got = {r["paper_id"]: r["coauthor_network_size"] for r in found.collect()}
    assert got == {p: len(names) for p, names in want.items() if names}
    assert "array_distinct" in found._jdf.queryExecution().toString()


def test_no_task_writes_a_third_of_a_stream(spark, sf, tmp_path, monkeypatch):
    from impactlens.catalog import streams

    monkeypatch.setattr(streams, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    plain = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
        stream = streams._files(spark, sf, "documents", "doc_id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", plain)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "landing").glob("part-*"))) > min(read, 12) > 3
    rows = []
    stream.writeStream.foreachBatch(lambda df, i: rows.append(df.count())).option("checkpointLocation", f"{tmp_path}/ck").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert len(rows) <= 3 and sum(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
