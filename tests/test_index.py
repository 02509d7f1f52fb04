"""The approximate index against plain comparisons."""

import numpy as np
import pytest

from impactlens.operators import lsh


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def plain(points, asked, k):
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    out = {}
    for i in asked:
        near = np.round(unit[:i] @ unit[i], 12)
        out[i] = sorted(range(i), key=lambda j: (-near[j], j))[:k]
    return out


def test_recall_and_similarities(spark):
    points = clustered(3000, 24, 1)
    points[100:140] = points[99]  # copies
    asked = range(50, 3000, 50)
    rows = spark.createDataFrame([(i, p.tolist(), i % 50 == 0, "x") for i, p in enumerate(points)], "paper_id long, embedding array<float>, query boolean, vec string")
    got = {}
    for r in lsh.approximate_nearest_older(rows, 5, bucket=64).collect():
        got.setdefault(r.paper_id, {})[r.position] = (r.neighbour, r.similarity)
    want = plain(points, asked, 5)
    assert got.keys() <= set(asked)
    hits = sum(len({n for n, _ in got.get(i, {}).values()} & set(want[i])) for i in asked)
    assert hits >= 0.9 * sum(map(len, want.values()))
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    for i, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1)) and all(n < i for n, _ in found.values())
        assert all(abs(unit[i] @ unit[n] - s) < 1e-6 for n, s in found.values())


@pytest.mark.parametrize("block", [3, 4096])
def test_all_probes_find_all(spark, monkeypatch, block):
    """With every bucket visited the result is exact, whatever the blocks."""
    monkeypatch.setattr(lsh, "BLOCK", block)
    points = clustered(120, 6, 2)
    points[40:60] = points[3]
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "paper_id long, embedding array<float>")
    got = {}
    for r in lsh.approximate_nearest_older(rows, 3, tables=1, probes=8, bucket=16).collect():
        got.setdefault(r.paper_id, {})[r.position] = r.neighbour
    assert {i: [f[p] for p in sorted(f)] for i, f in got.items()} == {i: w for i, w in plain(points, range(120), 3).items() if w}


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0])], "paper_id long, embedding array<double>")
    got = [(r.paper_id, r.neighbour, r.position) for r in lsh.approximate_nearest_older(rows).collect()]
    assert got == [(4, 3, 1)]
    assert lsh.approximate_nearest_older(rows.limit(0)).count() == 0


def test_buckets_visit_the_nearest_first():
    unit = np.array([[0.9, 0.1, -0.4]])
    table = np.eye(3)
    assert lsh.buckets(unit, table, 4).tolist() == [[0b011, 0b001, 0b111, 0b101]]
