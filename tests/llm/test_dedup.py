"""Exact and near duplicates against brute force, and their odd inputs."""

import hashlib
import random
import re

import pytest
import xxhash

from impactlens.llm import components, exact_dedup, queries, simhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, words=4):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows, links):
    """rows: {id: value}; the smallest id over links between equal or linked values."""
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and links(rows[a], rows[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_on_the_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    got = queries.QUERIES["op2_simhash_near_duplicates"](spark, sf).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in rows}


@pytest.mark.parametrize("most", [0, 1, 2, 4, 5, 8])
def test_links_are_all_pairs_within_the_distance(spark, most):
    rng = random.Random(most)
    values = {0, (1 << 64) - 1, 1 << 63, 1}
    while len(values) < 150:
        base = rng.choice(sorted(values)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, most + 2)):
            base ^= 1 << rng.randrange(64)
        values.add(base)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = [tuple(sorted((r.a, r.b))) for r in simhash.links(frame, most).collect()]
    want = {
        tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a < b and (a ^ b).bit_count() <= most
    }
    assert set(got) == want
    assert len(got) <= (most // 3 + 1) * len(want)  # a pair comes once per grid at most


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, i) for i in range(101, 160)] + [(99, 100)]
    got = {r.node: r.root for r in components.smallest_reachable(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 99 for i in range(99, 160)}}
    assert components.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [
    (1, None, "x"), (2, "", "x"), (3, "Same text Here now again", "x"), (4, "same TEXT here now again", "x"),
    (4, "same TEXT here now again", "x"), (5, "É same", "x"), (6, "é same", "x"), (7, "word " * 40_000, "x"),
    (None, "same text here now again", "x"), (9, " \t\n", "x"), (10, "one two", "x"),
]
SCHEMA = "doc_id long, text string, fp string"


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    first = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, None: 3, 9: 1, 10: 10}
    assert got == sorted(((i, first[i]) for i, _, _ in ODD), key=str)
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5, 6, 7, 10]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_with_a_text_over_many_ranges(spark, parts, keep):
    rng = random.Random(parts)
    rows = [(i, rng.choice(["Hot", "hot", "a" * 70 + rng.choice("xyz"), "", None, "é", "É", f"t{i}"]), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(5)
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, keep, parts=parts).collect()}
    groups = {}
    for i, text, _ in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(i)
    for text, ids in groups.items():
        best = max(ids) if keep == "largest" else min(ids)
        for i in ids:
            assert got[i].asDict() == {
                "doc_id": i, "keep_id": best, "group_size": len(ids), "kept": i == best,
                "text_sha256": hashlib.sha256(text.encode()).hexdigest(),
            }
    assert len(got) == len(rows)


def test_exact_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 5, 6, 7, 9, 10]
    assert all(r.group_size == 4 and r.keep_id == 3 for r in got if r.doc_id in (3, 4, None))
    twice = spark.createDataFrame([(4, "a", "x"), (4, "A", "x"), (None, "b", "x"), (None, "b", "x")], SCHEMA)
    assert sum(r.kept for r in exact_dedup.exact_duplicates(twice).collect()) == 2
    assert exact_dedup.keep_one(twice).count() == 2
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs).collect()) == [1, 3, 5, 6, 7, 9, 10]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0 and exact_dedup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_keep_one_shuffles_the_texts_once(spark, keep):
    """Whole rows come back, the texts being too many to broadcast their keys; no plan joins them by key."""
    rng = random.Random(5)
    rows = [(rng.choice("XY"), i if i % 50 else None, rng.choice(["Hot", "hot", "", None, f"t{i}", f"T{i % 90}"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "lang string, doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_dedup.keep_one(docs, keep)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    groups = {}
    for row in rows:
        groups.setdefault((row[2] or "").translate(FOLD), []).append(row)
    assert "SortMergeJoin" not in plan
    assert found.columns == docs.columns and len(got) == len(groups)
    for r in got:
        group = groups.pop((r.text or "").translate(FOLD))
        ids = [i for _, i, _ in group if i is not None]
        assert r.doc_id == ((max(ids) if keep == "largest" else min(ids)) if ids else None)
        assert (r.lang, r.doc_id, r.text) in group
