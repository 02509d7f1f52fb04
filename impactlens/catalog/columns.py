"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.ingest import _CLEAN
from impactlens.catalog.registry import query
from impactlens.functions import columns as C
from impactlens.operators import coauthors, labels
from impactlens.sources import feed


@query("p1_text_clean", f"SELECT doc_id, {_CLEAN.format(chr(39) + '  ' + chr(39) + ' || chr(10) || text || chr(9) || chr(160)')} AS cleaned FROM documents")
def p1(spark, sf):
    padded = F.concat(F.lit("  \n"), F.col("text"), F.lit("\t "))
    return V.table(spark, sf, "documents").select("doc_id", C.clean_text(padded).alias("cleaned"))


@query(
    "p2_iso_timestamps",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
  ELSE ts END AS published FROM events""",
)
def p2(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("on "), stamp))
        .when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_type") == "click", F.concat(stamp, F.lit("+05:30")))
        .otherwise(F.concat(stamp, F.lit("Z")))
    )
    return V.table(spark, sf, "events").select("event_id", C.iso_timestamp(text).alias("published"))


@query(
    "p3_id_normalise",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ARXIV:' ELSE '' END || o_orderkey || 'v2' AS tail,
  CASE WHEN o_orderstatus = 'P' THEN 'ARXIV:' ELSE 'arXiv:' END || o_orderkey || 'v2' AS prefixed,
  CAST(o_orderkey AS VARCHAR) AS join_key FROM orders""",
)
def p3(spark, sf):
    tail = F.concat(F.when(F.col("o_orderstatus") == "P", "ARXIV:").otherwise(""), F.col("o_orderkey"), F.lit("v2"))
    url = C.id_from_url(F.concat(F.lit("http://x/abs/y/abs/"), tail))
    return V.table(spark, sf, "orders").select(
        "o_orderkey", url.alias("tail"), C.prefixed_id(url).alias("prefixed"), C.join_key(url).alias("join_key")
    )


@query(
    "p4_p5_p6_dataset_columns",
    f"""WITH {V.PAPERS} SELECT paper_id, 1 AS n_authors, primary_cat, CAST(month(published) AS INTEGER) AS month,
  CAST(year(published) AS INTEGER) AS pub_year FROM papers""",
)
def p456(spark, sf):
    rows = V.papers(spark, sf).withColumn("authors", F.array("title"))
    return feed.dataset_columns(rows).select("paper_id", "n_authors", "primary_cat", "month", "pub_year")


@query(
    "p7_comma_lists",
    """SELECT p_partkey, trim(p_name) || '|' || trim(p_brand) || '||' || trim(p_type) AS authors, 3 AS n_authors,
  trim(p_name) AS primary_cat FROM part""",
)
def p7(spark, sf):
    entry = F.concat(F.col("p_name"), F.lit(" , "), F.col("p_brand"), F.lit(",,"), F.col("p_type"))
    rows = V.table(spark, sf, "part").select("p_partkey", entry.alias("authors"), entry.alias("categories"))
    return feed.from_manual_entry(rows).select("p_partkey", F.array_join("authors", "|").alias("authors"), "n_authors", "primary_cat")


@query(
    "p8_document_string",
    f"""WITH {V.DOC_PAPERS} SELECT paper_id, md5(title || ' ' || chr(10) || ' ' || abstract) AS tfidf_text,
  md5(title || chr(10) || chr(10) || abstract) AS embedding_text FROM doc_papers""",
)
def p8(spark, sf):
    t, a = F.col("title"), F.col("abstract")
    return V.doc_papers(spark, sf).select(
        "paper_id", F.md5(C.document(t, a)).alias("tfidf_text"), F.md5(C.embedding_text(t, a)).alias("embedding_text")
    )


@query(
    "p9_paper_card",
    f"""WITH {V.DOC_PAPERS}, lists AS (
  SELECT paper_id, title, abstract, string_split(title, ' ') AS words FROM doc_papers)
SELECT paper_id, title, array_to_string(words[1:5], ',') AS lead_authors,
  CAST(greatest(len(words) - 5, 0) AS INTEGER) AS more_authors,
  CASE WHEN length(abstract) > 500 THEN substring(abstract, 1, 500) || '...' ELSE abstract END AS abstract FROM lists""",
)
def p9(spark, sf):
    rows = V.doc_papers(spark, sf).withColumn("authors", F.split("title", " "))
    return feed.paper_card(rows).withColumn("lead_authors", F.array_join("lead_authors", ","))


@query(
    "p10_email_normalise",
    f"""WITH {V.SUBSCRIPTIONS} SELECT seq, lower(trim(email)) AS email,
  regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM subscription_log""",
)
def p10(spark, sf):
    email = C.normalise_email(F.col("email"))
    return V.subscription_log(spark, sf).select("seq", email.alias("email"), C.valid_email(email).alias("valid"))


_SCRIPT_SPACE = "\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


@query(
    "p10_script_spaces",
    f"""WITH odd AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN chr(65279) || 'A' || user_id || '@x.org' WHEN 1 THEN 'a' || chr(160) || user_id || '@x.org'
    WHEN 2 THEN 'a' || user_id || '@x.o' || chr(133) || 'g' || chr(160) ELSE 'a' || user_id || '@x.org' || chr(8233) END AS raw FROM events),
  trimmed AS (SELECT seq, lower(regexp_replace(raw, '^[{_SCRIPT_SPACE}]+|[{_SCRIPT_SPACE}]+$', '', 'g')) AS email FROM odd)
SELECT seq, email, regexp_matches(email, '^[^{_SCRIPT_SPACE}@]+@[^{_SCRIPT_SPACE}@]+\\.[^{_SCRIPT_SPACE}@]+$') AS valid FROM trimmed""",
)
def p10_spaces(spark, sf):
    """Spaces of scripts: stripped at the ends, refused inside; other control characters are ordinary."""
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("\ufeffA"), user, F.lit("@x.org")))
        .when(kind == 1, F.concat(F.lit("a\u00a0"), user, F.lit("@x.org")))
        .when(kind == 2, F.concat(F.lit("a"), user, F.lit("@x.o\u0085g\u00a0")))
        .otherwise(F.concat(F.lit("a"), user, F.lit("@x.org\u2029")))
    )
    email = C.normalise_email(raw)
    return V.table(spark, sf, "events").select(F.col("event_id").alias("seq"), email.alias("email"), C.valid_email(email).alias("valid"))


@query("p11_labelled_only", f"WITH {V.LABELLED} SELECT count(*) AS n, count(*) FILTER (y12 = 0) AS n_zero, CAST(sum(y12) AS BIGINT) AS total FROM labelled")
def p11(spark, sf):
    from impactlens.catalog.labels import works_table

    rows = labels.label_papers(V.papers(spark, sf), works_table(spark, sf), V.AS_OF, key="paper_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y12") == 0).alias("n_zero"), F.sum("y12").alias("total"))


@query(
    "p12_graph_papers",
    f"""WITH {V.AUTHORS} SELECT paper_id, count(*) AS n_authors FROM authors JOIN orders ON o_orderkey = paper_id
WHERE o_orderdate <= TIMESTAMP '2000-01-01' GROUP BY 1 HAVING count(*) >= 2""",
)
def p12(spark, sf):
    inc = coauthors.incidence(V.authors(spark, sf), "2000-01-01")
    return inc.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_authors"))
