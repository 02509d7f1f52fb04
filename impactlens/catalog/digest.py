"""Queries over digest items and subscribers."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.registry import query
from impactlens.operators import digest, subscribers


def _items(spark, sf):
    """Orders as digest items; zeros, empty texts and nulls occur in each field."""
    p = V.papers(spark, sf)
    second = F.col("categories")[1]
    return p.select(
        "paper_id",
        F.when(second == "5-LOW", "").when(second == "1-URGENT", None).otherwise(F.col("primary_cat")).alias("field_classification"),
        F.when(F.month("published") > 6, 0.0).otherwise(F.month("published").cast("double")).alias("field_prior_multiplier"),
        F.when(F.month("published") != 12, F.floor(F.col("price") / 1000)).alias("topic_activity_score"),
        F.struct(
            F.when(F.col("primary_cat") == "BUILDING", "").otherwise(second).alias("field_classification"),
            F.when(F.month("published") > 9, 0.0).otherwise(2.0).alias("field_prior_multiplier"),
            F.when(F.month("published") > 1, F.month("published") - 2).alias("author_h_index_avg"),
            F.when(F.month("published") < 4, "").otherwise("7").alias("author_recent_works_avg"),
            F.lit(None).cast("int").alias("venue_two_year_mean_citedness"),
        ).alias("signals"),
    )


@query(
    "d1_digest_defaults",
    f"""WITH {V.PAPERS}, i AS (SELECT *, CAST(month(published) AS INTEGER) AS m FROM papers)
SELECT paper_id,
  coalesce(nullif(CASE second_cat WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN NULL ELSE primary_cat END, ''),
           nullif(CASE WHEN primary_cat = 'BUILDING' THEN '' ELSE second_cat END, ''), 'Unknown') AS field,
  CASE WHEN m <= 6 THEN m::DOUBLE WHEN m <= 9 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS field_prior,
  CASE WHEN m > 1 THEN CAST(m - 2 AS VARCHAR) ELSE 'Unknown' END AS author_h_index_avg,
  CASE WHEN m < 4 THEN '' ELSE '7' END AS author_recent_works_avg, 'Unknown' AS venue_citedness,
  CASE WHEN m <> 12 THEN printf('%.2f', floor(price / 1000)) ELSE 'Not available' END AS topic_activity FROM i""",
)
def d1(spark, sf):
    return digest.with_defaults(_items(spark, sf))


def _breakdowns(spark, sf):
    """The words of a document's first line as its keywords, with four publications each."""
    def keyword(w):
        size = F.length(w)
        publications = F.array(
            *[F.struct(c.alias("venue")) for c in (F.col("primary_cat"), F.substring(w, 1, 1), F.col("primary_cat"), F.lit("last"))]
        )
        return F.struct(
            w.alias("keyword"), F.when(size > 3, size / F.lit(10.0)).alias("relevance"), size.cast("long").alias("num_works"),
            (size * F.lit(1.5)).alias("total_contribution"), publications.alias("top_publications"),
        )

    return V.doc_papers(spark, sf).select("paper_id", F.transform(F.split("title", " "), keyword).alias("breakdown"))


_WORDS = f"""{V.DOC_PAPERS}, w AS (
  SELECT paper_id, primary_cat, unnest(string_split(title, ' ')) AS keyword, generate_subscripts(string_split(title, ' '), 1) - 1 AS p,
    len(string_split(title, ' ')) AS n FROM doc_papers),
b AS (
  SELECT paper_id, keyword, CASE WHEN length(keyword) > 3 THEN length(keyword) / 10.0::DOUBLE END AS relevance, length(keyword) AS num_works,
    CASE WHEN substring(keyword, 1, 1) = primary_cat THEN primary_cat ELSE primary_cat || ',' || substring(keyword, 1, 1) END AS venues,
    CAST(p AS INTEGER) AS i, n FROM w)"""


@query(
    "d2_keyword_relevance",
    f"WITH {_WORDS} SELECT paper_id, i, keyword, CASE WHEN relevance IS NULL THEN 'unknown' ELSE printf('%.1f', relevance) END AS relevance FROM b",
)
def d2(spark, sf):
    rows = _breakdowns(spark, sf).select("paper_id", F.posexplode(digest.keyword_list(F.col("breakdown"))).alias("i", "k"))
    return rows.select("paper_id", "i", "k.keyword", "k.relevance")


@query(
    "d3_w8_a11_keyword_activity",
    f"WITH {_WORDS} SELECT paper_id, i, keyword, num_works, venues, CAST(greatest(n - 3, 0) AS INTEGER) AS more_keywords FROM b WHERE i < 3",
)
def d3(spark, sf):
    rows = digest.keyword_activity(_breakdowns(spark, sf)).select("paper_id", F.posexplode("activity").alias("i", "k"), "more_keywords")
    return rows.select("paper_id", "i", "k.keyword", "k.num_works", F.array_join("k.venues", ",").alias("venues"), "more_keywords")


@query(
    "d4_composite_score",
    f"""WITH {V.RANKED} SELECT paper_id, round(0.5 * (y_true - avg(y_true) OVER ()) / stddev_pop(y_true) OVER ()
  + 0.3 * (y_pred - avg(y_pred) OVER ()) / stddev_pop(y_pred) OVER () + 0.2 * (price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS composite_score FROM ranked""",
)
def d4(spark, sf):
    out = digest.composite_score(V.ranked(spark, sf), {"y_true": 0.5, "y_pred": 0.3, "price": 0.2})
    return out.select("paper_id", F.round("composite_score", 6).alias("composite_score"))


_EVENTS = f"""{V.SUBSCRIPTIONS}, valid AS (
  SELECT lower(trim(email)) AS email, action, "at", seq FROM subscription_log
  WHERE regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')),
marked AS (
  SELECT *, sum(CASE WHEN action = 'unsubscribe' THEN 1 ELSE 0 END) OVER (PARTITION BY email ORDER BY "at", seq) AS era,
    sum(CASE WHEN action = 'unsubscribe' THEN 1 ELSE 0 END) OVER (PARTITION BY email) AS last_era,
    lag(action) OVER (PARTITION BY email ORDER BY "at", seq) AS previous FROM valid)"""


@query(
    "d5_subscribers",
    f"WITH {_EVENTS} SELECT email, min(\"at\") AS created_at FROM marked WHERE era = last_era AND action = 'subscribe' GROUP BY 1",
)
def d5(spark, sf):
    return subscribers.subscribers(V.subscription_log(spark, sf))


@query(
    "d6_unsubscribe_replies",
    f"""WITH {_EVENTS} SELECT seq, email, "at", CASE WHEN previous = 'subscribe' THEN 'Unsubscribed' ELSE 'Not found' END AS reply
FROM marked WHERE action = 'unsubscribe'""",
)
def d6(spark, sf):
    return subscribers.unsubscribe_replies(V.subscription_log(spark, sf))


@query("d7_active_list", f"WITH {_EVENTS} SELECT DISTINCT email FROM marked WHERE era = last_era AND action = 'subscribe' ORDER BY email")
def d7(spark, sf):
    return subscribers.active_list(V.subscription_log(spark, sf))


@query(
    "p10_rejected_addresses",
    f"""WITH {V.SUBSCRIPTIONS} SELECT seq, lower(trim(email)) AS email FROM subscription_log
WHERE NOT regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')""",
)
def rejected(spark, sf):
    return subscribers.rejected_events(V.subscription_log(spark, sf)).select("seq", "email")
