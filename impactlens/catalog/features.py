"""Queries over text, metadata, embedding and neighbour features and paper signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.registry import query
from impactlens.functions import columns as C
from impactlens.operators import coauthors, embeddings, explain, lsh, meta_features, neighbours, signals, text_features
from impactlens.sources import feed
from impactlens.storage import durable

_TFIDF = """tokens AS (
  SELECT paper_id, regexp_extract_all(lower(title || ' ' || chr(10) || ' ' || abstract), '[\\p{L}\\p{N}_]{2,}') AS t FROM doc_papers),
spots AS (SELECT paper_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM tokens),
terms AS (
  SELECT paper_id, token AS term FROM spots
  UNION ALL SELECT a.paper_id, a.token || ' ' || b.token FROM spots a JOIN spots b ON b.paper_id = a.paper_id AND b.i = a.i + 1),
tf AS (SELECT paper_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
vocab AS (
  SELECT term, sum(tf) AS cf, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM doc_papers)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
  FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 20000)"""


@query(
    "f1_tfidf_vocabulary",
    f"WITH {V.DOC_PAPERS}, {_TFIDF} SELECT term, CAST(cf AS BIGINT) AS cf, df, round(idf, 9) AS idf FROM vocab",
)
def f1_vocabulary(spark, sf):
    papers = V.doc_papers(spark, sf)
    vocab = text_features.vocabulary(papers)
    return vocab.withColumn("idf", F.round("idf", 9))


@query(
    "f1_tfidf_weights",
    f"""WITH {V.DOC_PAPERS}, {_TFIDF}, w AS (SELECT paper_id, tf.term, tf * idf AS w FROM tf JOIN vocab ON vocab.term = tf.term)
SELECT paper_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY paper_id)), 9) AS weight FROM w""",
)
def f1(spark, sf):
    return text_features.tfidf(V.doc_papers(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("f2_f4_f7_text_svd", "SELECT doc_id AS paper_id, 24 AS width, TRUE AS within_unit_ball FROM documents")
def f2(spark, sf):
    """Embedding width and length per document; min_df prunes everything and falls back."""
    papers = V.doc_papers(spark, sf)
    model = text_features.TextFeaturizer(max_features=2000, n_components=24, min_df=10**9).fit(papers)
    from pyspark.ml.functions import vector_to_array

    emb = model.transform(papers).select("paper_id", vector_to_array("text_emb").alias("e"))
    return emb.select("paper_id", F.size("e").alias("width"), (C.norm(F.col("e")) <= 1 + 1e-9).alias("within_unit_ball"))


@query(
    "f3_zero_pad",
    """SELECT vec_id, 80 AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, 0.0::DOUBLE AS last FROM embeddings""",
)
def f3(spark, sf):
    padded = C.pad_array(F.transform("embedding", lambda x: x.cast("double")), 80)
    rows = V.table(spark, sf, "embeddings").select("vec_id", padded.alias("e"))
    return rows.select(
        "vec_id", F.size("e").alias("width"),
        F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.element_at("e", -1).alias("last"),
    )


@query(
    "f5_one_hot",
    f"""WITH {V.PAPERS}, fit AS (SELECT * FROM papers WHERE published < TIMESTAMP '1996-01-01'),
slots AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS slot FROM (
  SELECT DISTINCT coalesce(CASE WHEN second_cat <> '5-LOW' THEN second_cat END, '(null)') AS value FROM fit))
SELECT paper_id, 'second_cat=' || value AS feature, slot, 1.0::DOUBLE AS value
FROM papers JOIN slots ON value = coalesce(CASE WHEN second_cat <> '5-LOW' THEN second_cat END, '(null)')""",
)
def f5(spark, sf):
    second = F.col("categories")[1]
    rows = V.papers(spark, sf).withColumn("second_cat", F.when(second != "5-LOW", second))
    fit = rows.filter(F.col("published") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return meta_features.one_hot(fit, rows, "second_cat")


@query(
    "f6_scaled_n_authors",
    f"""WITH {V.AUTHORS}, n AS (SELECT paper_id, count(*) AS n_authors FROM authors GROUP BY 1)
SELECT paper_id, round(n_authors / (SELECT coalesce(nullif(stddev_pop(n_authors), 0), 1) FROM n), 9) AS n_authors_scaled FROM n""",
)
def f6(spark, sf):
    n = durable(V.authors(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_authors")))
    scale = meta_features.population_scale(n, "n_authors")
    return n.select("paper_id", F.round(F.col("n_authors") / F.lit(scale), 9).alias("n_authors_scaled"))


@query("f5_f8_p13_assembled_features", "SELECT o_orderkey AS paper_id, TRUE AS width_ok, TRUE AS slots_ok FROM orders")
def f8(spark, sf):
    """Width and names of the assembled metadata vector agree; one slot per category of each column is set."""
    papers = feed.dataset_columns(V.papers(spark, sf).withColumn("authors", F.array("title")))
    model = meta_features.MetaFeaturizer().fit(papers)
    from pyspark.ml.functions import vector_to_array

    names = meta_features.category_names(model)
    rows = model.transform(papers).select("paper_id", vector_to_array("meta_cat").alias("v"))
    return rows.select(
        "paper_id", (F.size("v") == len(names)).alias("width_ok"),
        (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) == 2.0).alias("slots_ok"),
    )


@query(
    "f10_embedding_misses",
    """WITH cached AS (SELECT DISTINCT sha256(text) AS key FROM documents JOIN labels USING (doc_id))
SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT key FROM cached)""",
)
def f10(spark, sf):
    docs = V.table(spark, sf, "documents")
    keyed = docs.select(F.sha2("text", 256).alias("key"), "text")
    cached = docs.join(V.table(spark, sf, "labels"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("key"))
    return embeddings.missing_texts(keyed, cached).select("key")


@query(
    "f9_text_embeddings",
    f"""WITH {V.DOC_PAPERS} SELECT paper_id, 64 AS dim,
  CASE WHEN regexp_matches(title || ' ' || abstract, '[\\p{{L}}\\p{{N}}_]{{2,}}') THEN 1.0::DOUBLE ELSE 0 END AS length FROM doc_papers""",
)
def f9(spark, sf):
    rows, _ = embeddings.embed_papers(V.doc_papers(spark, sf), lambda: embeddings.HashEncoder(64))
    return rows.select("paper_id", F.size("embedding").alias("dim"), F.round(C.norm(F.col("embedding")), 5).alias("length"))


@query(
    "f11_hybrid_embedding",
    """SELECT vec_id, unnest(list_concat(list_transform(embedding, lambda x: round(0.7::DOUBLE * x::DOUBLE, 9)),
  list_transform(embedding[1:8], lambda x: round(0.3::DOUBLE * x::DOUBLE, 9)))) AS value,
  CAST(generate_subscripts(list_concat(embedding, embedding[1:8]), 1) - 1 AS INTEGER) AS i FROM embeddings""",
)
def f11(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    both = embeddings.hybrid(F.col("embedding"), F.slice("embedding", 1, 8))
    return rows.select("vec_id", F.posexplode(both).alias("i", "value")).withColumn("value", F.round("value", 9))


_UNIT = """v AS (SELECT vec_id AS paper_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT paper_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)"""
_NEAREST = f"""{_UNIT},
near AS (
  SELECT q.paper_id, m.paper_id AS neighbour, round(list_dot_product(q.e, m.e), 9) AS similarity,
    CAST(row_number() OVER (PARTITION BY q.paper_id ORDER BY round(list_dot_product(q.e, m.e), 12) DESC, m.paper_id) AS INTEGER) AS position
  FROM u q JOIN u m ON m.paper_id < q.paper_id QUALIFY position <= 5)"""


@query("j9_nearest_older", f"WITH {_NEAREST} SELECT paper_id, neighbour, similarity, position FROM near")
def j9(spark, sf):
    near = neighbours.nearest_older(V.vectors(spark, sf), 5)
    return near.withColumn("similarity", F.round("similarity", 9))


@query(
    "j9_lsh_recall",
    f"""WITH {_NEAREST} SELECT count(DISTINCT paper_id) AS queries, count(*) AS wanted, TRUE AS reached FROM near WHERE paper_id % 50 = 0""",
)
def j9_lsh(spark, sf):
    """Whether the approximate index over all vectors finds nine in ten of the exact neighbours of every fiftieth paper."""
    rows = V.vectors(spark, sf).withColumn("query", F.col("paper_id") % 50 == 0)
    measured = lsh.recall(lsh.approximate_nearest_older(rows, 5), neighbours.nearest_older(rows, 5))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


def _cites(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.sum("l_quantity").cast("long").alias("cites")
    )


_CITES = "cites AS (SELECT l_orderkey AS paper_id, CAST(sum(l_quantity) AS BIGINT) AS cites FROM lineitem GROUP BY 1)"


@query(
    "w9_neighbour_statistics",
    f"""WITH {_NEAREST}, {_CITES}, pairs AS (
  SELECT n.paper_id, c.cites, exp(-greatest(date_diff('day', b.o_orderdate, a.o_orderdate), 0) / 365.0::DOUBLE) AS w
  FROM near n JOIN orders a ON a.o_orderkey = n.paper_id JOIN orders b ON b.o_orderkey = n.neighbour JOIN cites c ON c.paper_id = n.neighbour)
SELECT paper_id, count(*) AS n_neighbours, round(sum(w * cites) / sum(w), 6) AS weighted_mean, max(cites) AS max_cites,
  CAST(median(cites) AS DOUBLE) AS median_cites, round(var_pop(cites), 6) AS var_cites FROM pairs GROUP BY 1""",
)
def w9(spark, sf):
    near = neighbours.nearest_older(V.vectors(spark, sf), 5)
    papers = V.papers(spark, sf).select("paper_id", "published").join(_cites(spark, sf), "paper_id", "left")
    out = neighbours.neighbour_statistics(near, papers)
    return out.withColumns({"weighted_mean": F.round("weighted_mean", 6), "var_cites": F.round("var_cites", 6)})


@query(
    "w9_neighbour_growth",
    f"""WITH {_NEAREST}, {V.YEARLY}, per AS (
  SELECT n.paper_id, y.year::DOUBLE AS year, sum(y.cited_by_count)::DOUBLE AS c FROM near n JOIN yearly y ON y.paper_id = n.neighbour GROUP BY 1, 2)
SELECT paper_id, round(CASE WHEN var_pop(year) > 0 THEN covar_pop(year, c) / var_pop(year) END, 6) AS growth_slope FROM per GROUP BY 1""",
)
def w9_growth(spark, sf):
    near = neighbours.nearest_older(V.vectors(spark, sf), 5)
    return neighbours.neighbour_growth(near, V.yearly(spark, sf)).withColumn("growth_slope", F.round("growth_slope", 6))


@query(
    "f12_impact_proximity",
    f"""WITH {_UNIT}, {_CITES}, p AS (
  SELECT u.paper_id, u.e, c_mktsegment AS cat, year(o_orderdate) AS y, cites, percent_rank() OVER w AS pr,
    rank() OVER (PARTITION BY c_mktsegment, year(o_orderdate) ORDER BY cites DESC) AS r, count(*) OVER (PARTITION BY c_mktsegment, year(o_orderdate)) AS n
  FROM u JOIN orders ON o_orderkey = u.paper_id JOIN customer ON c_custkey = o_custkey JOIN cites USING (paper_id)
  WINDOW w AS (PARTITION BY c_mktsegment, year(o_orderdate) ORDER BY cites DESC)),
s AS (SELECT a.paper_id, list_dot_product(a.e, b.e) AS c FROM p a JOIN p b ON b.cat = a.cat AND b.y < a.y AND b.r - 1 < b.n * 0.1)
SELECT paper_id, round(avg(c), 9) AS mean_similarity, round(max(c), 9) AS max_similarity FROM s GROUP BY 1""",
)
def f12(spark, sf):
    papers = (
        V.vectors(spark, sf).join(V.papers(spark, sf).select("paper_id", "published", "primary_cat"), "paper_id")
        .join(_cites(spark, sf), "paper_id").withColumn("pub_year", F.year("published"))
    )
    out = neighbours.impact_proximity(papers)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_similarity", "max_similarity")})


@query(
    "a9_x3_global_importance",
    """SELECT 'feature_' || CAST(i - 1 AS VARCHAR) AS feature, round(avg(abs(v)), 9) AS importance FROM (
  SELECT unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1""",
)
def a9(spark, sf):
    phi = V.vectors(spark, sf).withColumnRenamed("embedding", "phi")
    return explain.global_importance(phi).withColumn("importance", F.round("importance", 9))


_RANKED_PHI = """e AS (SELECT vec_id AS paper_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id, v > 0 ORDER BY abs(v) DESC, i) AS INTEGER) AS position FROM e WHERE v <> 0)"""


@query(
    "w7_x4_top_features",
    f"""WITH {_RANKED_PHI} SELECT paper_id, v > 0 AS positive, position, 'feature_' || CAST(i AS VARCHAR) AS name, v AS value FROM r WHERE position <= 10""",
)
def w7(spark, sf):
    out = explain.explanations(V.vectors(spark, sf).withColumnRenamed("embedding", "phi"))
    sides = [
        out.select("paper_id", F.lit(sign).alias("positive"), F.posexplode(c).alias("p", "f"))
        for sign, c in ((True, "top_positive_features"), (False, "top_negative_features"))
    ]
    return sides[0].unionByName(sides[1]).select(
        "paper_id", "positive", (F.col("p") + 1).alias("position"), "f.name", "f.value"
    )


@query(
    "x4_explanation_totals",
    """SELECT vec_id AS paper_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS prediction, 0.0::DOUBLE AS baseline,
  vec_id AS info_id, label AS info_label FROM embeddings""",
)
def x4(spark, sf):
    out = explain.explanations(V.vectors(spark, sf).withColumnRenamed("embedding", "phi"), info=["label"])
    return out.select(
        "paper_id", F.round("prediction", 6).alias("prediction"), "baseline",
        F.col("paper_info.paper_id").alias("info_id"), F.col("paper_info.label").alias("info_label"),
    )


@query(
    "x2_linear_attributions",
    """SELECT vec_id AS paper_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i,
  round(0.5::DOUBLE * (unnest(embedding)::DOUBLE - 0.25::DOUBLE), 9) AS phi FROM embeddings""",
)
def x2_linear(spark, sf):
    width = 64
    out = explain.linear_attributions(V.vectors(spark, sf), [0.5] * width, [0.25] * width, "embedding")
    return out.select("paper_id", F.posexplode("phi").alias("i", "phi")).withColumn("phi", F.round("phi", 9))


@query(
    "a12_concept_entropy",
    """WITH c AS (SELECT l_orderkey AS paper_id, p_brand, count(*)::DOUBLE AS c FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT paper_id, c / sum(c) OVER (PARTITION BY paper_id) AS p FROM c)
SELECT paper_id, count(*) AS n_concepts, round(-sum(p * ln(p)), 9) + 0.0 AS concept_entropy FROM s GROUP BY 1""",
)
def a12(spark, sf):
    rows = _line_items(spark, sf, "part", "l_partkey", "p_partkey", "p_brand", "concept")
    return signals.concept_entropy(rows).withColumn("concept_entropy", F.round("concept_entropy", 9) + 0.0)


def _line_items(spark, sf, table, left, right, column, name):
    lines, other = V.table(spark, sf, "lineitem"), V.table(spark, sf, table)
    return lines.join(other, F.col(left) == F.col(right)).select(F.col("l_orderkey").alias("paper_id"), F.col(column).alias(name))


@query(
    "a14_institution_diversity",
    """WITH c AS (SELECT l_orderkey AS paper_id, s_nationkey, count(*)::DOUBLE AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
s AS (SELECT paper_id, c / sum(c) OVER (PARTITION BY paper_id) AS p FROM c)
SELECT paper_id, count(*) AS n_institutions, round(1 - sum(p * p), 9) AS institution_diversity FROM s GROUP BY 1""",
)
def a14(spark, sf):
    rows = _line_items(spark, sf, "supplier", "l_suppkey", "s_suppkey", "s_nationkey", "institution")
    return signals.institution_diversity(rows).withColumn("institution_diversity", F.round("institution_diversity", 9))


_STANDING = f"""{V.AUTHORS},
known AS (SELECT l_orderkey AS paper_id, CAST(sum(l_quantity) AS BIGINT) AS cites FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1),
prior AS (
  SELECT author, coalesce(cites, 0) AS cites FROM authors JOIN orders ON o_orderkey = authors.paper_id LEFT JOIN known ON known.paper_id = authors.paper_id
  WHERE o_orderdate < TIMESTAMP '2000-01-01'),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY cites DESC) AS rk FROM prior),
standing AS (
  SELECT author, count(*) AS prior_papers, CAST(sum(cites) AS BIGINT) AS prior_cites, max(CASE WHEN cites >= rk THEN rk ELSE 0 END) AS h_index FROM r GROUP BY 1)"""


_EARLY_EDGES = V.EDGES.replace(
    "FROM authors a JOIN", "FROM authors a JOIN orders o ON o.o_orderkey = a.paper_id AND o.o_orderdate <= TIMESTAMP '2000-01-01' JOIN"
)


@query("a13_author_standing", f"WITH {_STANDING} SELECT author, prior_papers, prior_cites, h_index FROM standing")
def a13(spark, sf):
    return signals.author_standing(V.authors(spark, sf), V.yearly(spark, sf), "2000-01-01")


@query(
    "a16_centroid_distance",
    f"""WITH {_UNIT}, m AS (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1)
SELECT paper_id, v.label, round(1 - list_dot_product(e, c) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(c, c)), 9) AS centroid_distance
FROM v JOIN c ON c.label = v.label""",
)
def a16(spark, sf):
    return signals.centroid_distance(V.vectors(spark, sf), "label").withColumn("centroid_distance", F.round("centroid_distance", 9))


@query(
    "g8_expert_proximity",
    f"""WITH {_STANDING}, {_EARLY_EDGES}, experts AS (SELECT author FROM standing ORDER BY h_index DESC, prior_cites DESC, author LIMIT 20),
d AS (SELECT src AS author, count(*) AS d FROM arcs GROUP BY 1),
b AS (SELECT a.src AS author, e.src AS expert, count(*) AS b FROM arcs e JOIN experts ON experts.author = e.src JOIN arcs a ON a.dst = e.dst GROUP BY 1, 2)
SELECT b.author, round(max(b::DOUBLE / (x.d + y.d - b)), 9) AS expert_proximity FROM b JOIN d x ON x.author = b.author JOIN d y ON y.author = b.expert GROUP BY 1""",
)
def g8(spark, sf):
    authors = durable(V.authors(spark, sf))
    edges = durable(coauthors.coauthor_edges(coauthors.incidence(authors, "2000-01-01")))
    experts = signals.top_experts(signals.author_standing(authors, V.yearly(spark, sf), "2000-01-01"), 20)
    out = signals.expert_proximity(coauthors.neighbours(edges), experts)
    return out.withColumn("expert_proximity", F.round("expert_proximity", 9))
