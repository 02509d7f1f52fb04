"""The pipeline against what its stages promise."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from impactlens.llm import language_id, simhash
from impactlens.llm.queries import BYTE_LEVEL
from test_dedup import FOLD, plain_components, plain_fingerprint
from test_scans import plain_base


def test_pipeline_by_brute_force(spark, sf):
    """All rows of the table are labelled, so the language stage rejects those without a letter alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert all(r.lang for r in rows.values())
    first = {}
    for i in sorted(rows):
        if any(map(str.isalpha, rows[i].text or "")):
            first.setdefault(rows[i].text.translate(FOLD), i)
    prints = {i: plain_fingerprint(rows[i].text, 4) for i in first.values()}
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    stay = {i for i, root in roots.items() if i == root}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got.keys() == stay
    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    for i in stay:
        text = tokenizer.decode(got[i][:-1], skip_special_tokens=False)
        assert got[i][-1] == 0
        if plain_base(rows[i].text):
            assert "[SECRET]" in text and not plain_base(text)
        elif "[SECRET]" not in text:
            assert text == rows[i].text


def test_pipeline_of_odd_rows(spark):
    rows = [
        (1, "the cat and the dog", "en", "s", 19), (2, "THE cat and the dog", "en", "s", 19), (3, None, "en", "s", 0), (4, "", None, None, 0),
        (1, "the cat and the dog", "en", "s", 19), (None, "der Hund und die Katze", "de", "s", 22), (6, "the dog " * 40_000, "en", "s", 320_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'a' AS key", "2 AS judged", "3 AS predicted", "'b' AS base", "'c' AS spans", "4 AS id", "5 AS fp")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
        docs = out.checkpoint()
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 6]
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, "").collect()} == {None, 1, 6}


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    words = ["w" + str(i) for i in range(3000)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("w17 ", "W17 ")) for i, t in enumerate(base)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(20))


def test_unlabelled_clean_texts_stay(spark, sf):
    """Most rows without their label are still found to be in a learned language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hidden = docs.withColumn("lang", F.expr("CASE WHEN doc_id % 5 > 0 THEN lang END"))
    kept = language_id.known_language(hidden)
    assert kept.count() >= 0.99 * docs.count()
    wrong = kept.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("lang != truth").count()
    assert wrong <= 0.02 * docs.count()
