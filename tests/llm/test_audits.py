"""Source divergence, URL filters and vector codes against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactlens.llm import divergence, url_filter, vector_codes
from impactlens.llm.queries import QUERIES, URL_RULES

# divergence


def plain_audit(rows, least, smoothing=5, scale=10**9, top=50):
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) for text, _, _ in rows]
    groups = {(lang or "", source or "") for _, lang, source in rows}
    out = []
    for lang in {g[0] for g in groups}:
        inside = [(source or "", w) for (_, own, source), w in zip(rows, words, strict=True) if (own or "") == lang]
        docs = Counter(t for _, w in inside for t in set(w))
        kept = [t for t, n in docs.items() if n >= least]

        def shares(lists):
            cnt = Counter(t for w in lists for t in w if docs[t] >= least)
            return cnt, {t: 1 + scale * (cnt[t] + smoothing) // (sum(cnt.values()) + smoothing * len(kept)) for t in kept}

        _, whole = shares([w for _, w in inside])
        each = {s: shares([w for own, w in inside if own == s]) for s in {s for s, _ in inside}}
        for s, (cnt, p) in each.items():
            pairs = [(o, sum(abs(p[t] - q[t]) for t in kept)) for o, (_, q) in each.items() if o != s]
            terms = [(t, p[t] - whole[t]) for t in kept if cnt[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def random_documents(n, sources, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "xyzäß" for b in ("", "a", "É", "ou", "ß日")]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choice(words[: rng.randint(1, len(words))]) + rng.choice(["", ".", "9a", "'S"]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), rng.choice([f"s{rng.randint(0, sources)}", "hot", None])))
    return rows


@pytest.mark.parametrize(("n", "sources", "least"), [(60, 3, 2), (200, 25, 5), (30, 4, 1000), (4, 1, 1)])
def test_divergence_by_brute_force(spark, n, sources, least):
    rows = random_documents(n, sources, n)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, term int, place string, cnt int").repartition(5)
    got = sorted(map(tuple, divergence.audit_sources(docs, least_documents=least, top=4).collect()))
    assert got == plain_audit(rows, least, top=4)


def test_divergence_with_small_steps(spark, monkeypatch):
    """Texts cut in slices and counts handed on early give the same."""
    rows = random_documents(50, 6, 1)
    want = plain_audit(rows, 2)
    monkeypatch.setattr(divergence, "AT_ONCE", 10)
    monkeypatch.setattr(divergence, "HELD", 7)
    terms = [t for text, _, _ in rows for part in divergence.cut_terms((text or "").encode()) for t in part]
    assert Counter(terms) == Counter(t.encode() for text, _, _ in rows for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit_sources(docs, least_documents=2).collect())) == want
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_divergence_of_one_long_text(spark):
    docs = spark.createDataFrame([("word Other " * 300_000, "en", "a"), ("other", "en", "b")], "text string, lang string, source string")
    got = {(r.source, r.part, r["item"]): r.value for r in divergence.audit_sources(docs, least_documents=1).collect()}
    assert got == {(s, part, item): v for _, s, part, item, v, _ in plain_audit([("word Other " * 300_000, "en", "a"), ("other", "en", "b")], 1)}


# url filters

ODD_URLS = [
    None, "", "://", "x://", "no scheme/en/1", "http://example.org", "http://EXAMPLE.org/en/1?x=/es/", "http://example.org/en/2", "http://example.org/es/",
    "http://badexample.org/es/x", "https://a.b.Example.ORG/es/#x", "http://x.com/fr", "http://x.com/fr/", "http://com/de/", "http://x.com?y=/de/",
    "http://x.com#/de/", "ftp://a://b/c", "http://ünï.org/é🙂/x?y", "http://org/\nx", "http://x.org:80/es/", "http://x.com/" + "a" * 200_000,
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = []
    for rule in URL_RULES:
        name, _, start = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule.text), rule.text, rule.verdict))
    return (host, path, *max(fits, default=(0, None, None))[1:])


def test_rules_by_brute_force(spark, sf):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string, host string, rule string")
    machine = url_filter.train(url_filter.ruled(pages, URL_RULES))
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES, machine).collect()}
    assert len(got) == 2 * len(ODD_URLS)
    for i, url in enumerate(ODD_URLS * 2):
        host, path, rule, verdict = plain_url(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("allow" if got[i].score >= machine.bound else "block"))
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    query = QUERIES["op12_url_filter"](spark, sf)
    for r in query.collect():
        host, path, rule, verdict = plain_url(urls.pop(r.page_id))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert not urls
    plan = query._jdf.queryExecution().toString()
    assert not any(bad in plan for bad in ("PythonUDF", "MapInArrow", "Exchange", "Join"))
    empty = pages.limit(0)
    assert url_filter.judge(empty, URL_RULES, url_filter.train(url_filter.ruled(empty, URL_RULES))).count() == 0


def plain_score(text, samples, order, kept):
    """The difference of the mean log-likelihoods, by the definition: contexts that are kept, each smoothed with the shorter ones."""
    signs = url_filter.SIGNS + url_filter.OTHER
    counts = [Counter(), Counter()]
    for accepted, own in samples:
        whole = "^" + own
        counts[accepted].update(whole[i - k : i + 1] for i in range(1, len(whole)) for k in range(min(order, i) + 1))

    def chance(side, context, sign):
        lower = chance(side, context[1:], sign) if context else 1 / len(signs)
        behind = [counts[side][context + s] for s in signs]
        total, kinds = sum(behind), sum(n > 0 for n in behind)
        return (counts[side][context + sign] + kinds * lower) / (total + kinds) if total else lower

    total, before = 0.0, "^"
    for sign in text:
        context = next(c for c in (before[-k:] if k else "" for k in range(min(order, len(before)), -1, -1)) if c in kept)
        total += math.log(chance(1, context, sign) / chance(0, context, sign))
        before += sign
    return total / len(text)


@pytest.mark.parametrize("most", [1, 12, 100_000])
def test_scores_by_brute_force(spark, most):
    samples = [(1, "good.net/a"), (1, "goods.net/ab"), (0, "bad.net/x1"), (0, "bad.bad/x")]
    counts = {}
    for accepted, own in samples:
        whole = "^" + own
        for i in range(1, len(whole)):
            for k in range(min(3, i) + 1):
                counts.setdefault(whole[i - k : i + 1], [0, 0])[accepted] += 1
    machine = url_filter._machine(counts, 3, most)
    texts = ["good", "bad.net/x1", "zzz", "g", "ood.bad", "^*", "goodgoodbadbad/x1ab"]
    texts = [t.replace("^", "*") for t in texts]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", machine.score(F.col("text")).alias("s")).collect()
    for r in rows:
        assert math.isclose(r.s, plain_score(r.text, samples, 3, set(machine.states)), rel_tol=1e-6, abs_tol=1e-9), r.text


def test_models_tell_unseen_addresses(spark):
    rng = random.Random(3)
    good = lambda: f"https://{rng.choice(['news', 'wiki', 'docs'])}.site{rng.randint(0, 999)}.net/{rng.choice(['article', 'page'])}/{rng.randint(0, 99)}"
    bad = lambda: f"http://{rng.choice(['casino', 'pills', 'bets'])}-{rng.choice(['win', 'cheap'])}{rng.randint(0, 999)}.net/{rng.choice(['buy', 'spin'])}?id={rng.randint(0, 99)}"
    rows = [(i, (good if i % 3 else bad)(), i % 3 > 0) for i in range(900)]
    machine = url_filter.train(spark.createDataFrame(rows, "page_id long, url string, accepted boolean"))
    tests = spark.createDataFrame([(i, (good if i % 2 else bad)()) for i in range(400)], "page_id long, url string")
    got = url_filter.judge(tests, [], machine).collect()
    assert np.mean([(r.verdict == "allow") == (r.page_id % 2 == 1) for r in got]) > 0.97


def test_every_address_is_learned_from(spark):
    """Of 30,000 rejected addresses and one accepted shape, what was seen once still counts."""
    rows = spark.range(60_000).selectExpr("id AS page_id", "concat(if(id % 2 = 0, 'good', 'bad'), id % 60000, '.net/') AS url", "id % 2 = 0 AS accepted")
    machine = url_filter.train(rows, order=1, most_states=100)
    seen = rows.select(url_filter.spelled(F.col("url")).alias("text")).distinct().filter(F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)) == 0).collect()
    samples = [(int(r.text.startswith("good")), r.text) for r in seen]
    assert len(samples) > 25_000
    texts = ["good17.net/", "bad99.net/", "god-1"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", machine.score(F.col("text")).alias("s")).collect()
    for r in got:
        assert math.isclose(r.s, plain_score(r.text, samples, 1, set(machine.states)), rel_tol=1e-6, abs_tol=1e-9), r.text


def test_models_of_all_addresses(spark):
    """What the query judges with counts every address, not half of them."""
    rows = spark.range(400).selectExpr("id AS page_id", "concat(if(id % 2 = 0, 'good', 'bad'), id, '.net/') AS url", "id % 2 = 0 AS accepted")
    machine = url_filter.train(rows, order=1, most_states=100, whole=True)
    samples = [(int(r.accepted), r.url) for r in rows.collect()]
    texts = ["good17.net/", "bad99.net/", "god-1"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", machine.score(F.col("text")).alias("s")).collect()
    for r in got:
        assert math.isclose(r.s, plain_score(r.text, samples, 1, set(machine.states)), rel_tol=1e-6, abs_tol=1e-9), r.text
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(rows.drop("accepted"), [], machine).collect()}
    assert all((verdicts[i] == "allow") == (i % 2 == 0) for i in verdicts)
    alone = url_filter.train(rows.filter("accepted"), order=1, whole=True)
    assert alone.bound == 0 and set(alone.ratio) == {0.0}


def test_the_query_learns_from_all_addresses(spark, sf, monkeypatch):
    asked = []
    plain = url_filter.train
    monkeypatch.setattr(url_filter, "train", lambda *given, **options: asked.append(options) or plain(*given, **options))
    QUERIES["op12_url_filter"](spark, sf)
    assert [o.get("whole") for o in asked] == [True]


def test_bound_of_many_steps():
    rng = random.Random(8)
    scored = [(side, rng.randint(-40, 40) + 15 * side, rng.randint(1, 9)) for side in (False, True) for _ in range(60)]
    lost = lambda at: (
        1 - sum(n for s, i, n in scored if not s and i < at) / sum(n for s, _, n in scored if not s)
        + sum(n for s, i, n in scored if s and i < at) / sum(n for s, _, n in scored if s)
    )
    got = url_filter._bound(scored)
    assert lost(got * url_filter.STEPS) == min(lost(at) for at in range(-60, 80))


# vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(codes, error) per row and the codebooks, in Python's whole numbers."""
    width = -(-max((len(v) for _, v in rows), default=0) // parts)
    whole = [[math.floor(scale * float(x)) for x in v] + [0] * (parts * width - len(v)) for _, v in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, near in zip(cut, found, strict=True) if near[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(bytes(k for _, k in near), sum(d for d, _ in near)) for near in assign()], books


def check_codes(spark, rows, kind="float", **options):
    """rows: (id, vector, label)"""
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], f"vec_id long, embedding array<{kind}>, label int, error int, codes string").repartition(3)
    found, books = vector_codes.compress(docs, **options)
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    exact = [(i, np.float32(v).astype(float).tolist() if kind == "float" else v) for i, v, _ in kept]
    want, plain_books = plain_codes(exact, **options)
    sums = Counter()
    for (_, _, label), (_, error) in zip(kept, want, strict=True):
        sums[label] += error
    got = Counter((r.vec_id, r.label, bytes(r.codes), r.error, r.label_error) for r in found.collect())
    assert got == Counter((i, label, code, error, sums[label]) for (i, _, label), (code, error) in zip(kept, want, strict=True))
    assert [b.tolist() for b in books.books] == plain_books
    return books


def test_codes_of_random_vectors(spark):
    rng = random.Random(8)
    some = lambda n: [rng.choice([rng.uniform(-2, 2), rng.randint(-1, 1) / 4]) for _ in range(n)]
    rows = [(i, some(24), rng.choice([1, 2, None])) for i in range(120)]
    rows += [(7, some(24), 1), (None, some(24), 2), (500, rows[3][1], 1), (501, rows[3][1], 1), (502, None, 1), (503, [float("nan")] * 24, 1)]
    rows += [(504, [*some(23), None], 1), (505, [*some(23), float("-inf")], 1), (-9, some(10), None), (600, [], 3)]
    check_codes(spark, rows, entries=16, rounds=3)
    check_codes(spark, rows, parts=3, entries=256, rounds=2)
    check_codes(spark, rows[:5], parts=5)


def test_codes_of_wide_numbers_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**17 for _ in range(40)], i) for i in range(40)]
    books = check_codes(spark, rows, "double", entries=8, rounds=2)
    assert books.books[0].dtype == object


def test_codes_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    found, books = vector_codes.compress(docs)
    assert found.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("m", [1, 2, 8, 64])
def test_transform_is_in_sequency_order(m):
    rows = vector_codes.transform(np.eye(m, dtype=np.int64), m).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(m))
    assert (rows @ rows.T == m * np.eye(m)).all()


def test_code_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in QUERIES["op13_vector_codes"](spark, sf).collect()}
    ids, vectors = zip(*rows, strict=True)
    points = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64).reshape(len(ids), 4, -1)
    books = [points[np.argsort(ids)[:256], p] for p in range(4)]
    near = lambda p: ((points[:, None, p] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(4):
        for p in range(4):
            own = near(p).argmin(axis=1)
            books[p] = np.array([points[own == k, p].sum(axis=0) // max((own == k).sum(), 1) if (own == k).any() else e for k, e in enumerate(books[p])])
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    last = [near(p).argmin(axis=1) for p in range(4)]
    for n, i in enumerate(ids):
        assert got[i].code == "".join(f"{own[n]:02x}" for own in last) and got[i].codebooks_sha256 == digest
    assert sum(r.error for r in got.values()) == sum(int(near(p).min(axis=1).sum()) for p in range(4))
