"""Queries over sources, caches and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.catalog import views as V
from impactlens.catalog.registry import query
from impactlens.functions import columns as C
from impactlens.plans import dataset
from impactlens.sources import cache, feed, tables, works
from impactlens.storage import new_path


def _escaped(c):
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _bodies(spark, sf):
    d = V.doc_papers(spark, sf)
    return d.select(
        F.concat(
            F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://papers.example/abs/'),
            F.col("paper_id"), F.lit("v1</id><title>\n "), _escaped(F.col("title")), F.lit(" \n</title><summary> "),
            _escaped(F.col("abstract")), F.lit("\n</summary><published>2021-03-04T05:06:07Z</published><author><name>"),
            F.col("categories")[1], F.lit("</name></author><author><affiliation>x</affiliation></author><author><name>"),
            F.col("primary_cat"), F.lit('</name></author><category term="'), F.col("primary_cat"),
            F.lit('"/><category scheme="none"/><category term="'), F.col("categories")[1], F.lit('"/></entry></feed>'),
        ).alias("body")
    )


_CLEAN = r"replace(regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x85\p{{Z}}]+|[\s\x0B\x1C-\x1F\x85\p{{Z}}]+$', '', 'g'), chr(10), ' ')"


@query(
    "s1_feed_entries",
    f"""WITH {V.DOC_PAPERS}
SELECT paper_id || 'v1' AS paper_id, {_CLEAN.format('title')} AS title, {_CLEAN.format('abstract')} AS abstract,
  primary_cat || ',' || source AS categories, source || ',' || primary_cat AS authors,
  '2021-03-04T05:06:07Z' AS published, CAST(NULL AS VARCHAR) AS updated FROM doc_papers""",
)
def s1(spark, sf):
    return feed.parse_feed(_bodies(spark, sf)).withColumns(
        {"categories": F.array_join("categories", ","), "authors": F.array_join("authors", ",")}
    )


@query(
    "s2_category_window",
    f"""WITH {V.PAPERS} SELECT paper_id, published, primary_cat, title FROM papers
WHERE published BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
  AND (primary_cat = 'BUILDING' OR second_cat = 'BUILDING')""",
)
def s2(spark, sf):
    found = feed.category_window(V.papers(spark, sf), "BUILDING", "1996-01-01", "1998-12-31")
    return found.select("paper_id", "published", "primary_cat", "title")


@query(
    "s2_category_window_limit",
    f"""WITH {V.PAPERS} SELECT paper_id, published, primary_cat, title FROM papers
WHERE published BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'
  AND (primary_cat = '1-URGENT' OR second_cat = '1-URGENT') ORDER BY published, paper_id LIMIT 100""",
)
def s2_limit(spark, sf):
    found = feed.category_window(V.papers(spark, sf), "1-URGENT", "1996-01-01", "1998-12-31", 100)
    return found.select("paper_id", "published", "primary_cat", "title")


@query(
    "s3_lookup_ids",
    f"""WITH {V.PAPERS} SELECT paper_id, published, title FROM papers
WHERE paper_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def s3(spark, sf):
    wanted = V.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"))
    return feed.lookup(V.papers(spark, sf), wanted).select("paper_id", "published", "title")


def _responses(spark, sf):
    """Search responses as JSON: the paper's work first, then a decoy; no results without citations."""
    counted = works.works_from_counts(V.yearly(spark, sf), "paper_id")
    hit = F.struct(F.concat(F.lit("W"), F.col("paper_id")).alias("id"), "counts_by_year")
    decoy = F.struct(F.lit("W-decoy").alias("id"), F.slice("counts_by_year", 1, 0).alias("counts_by_year"))
    some = F.when(F.col("counts_by_year").isNotNull(), F.array(hit, decoy)).otherwise(F.array().cast(
        "array<struct<id:string,counts_by_year:array<struct<year:int,works_count:bigint,cited_by_count:bigint>>>>"
    ))
    return (
        V.papers(spark, sf).select("paper_id").join(counted, "paper_id", "left")
        .select(F.col("paper_id").alias("paper_key"), F.to_json(F.struct(some.alias("results"))).alias("body"))
    )


_WORKS = f"""{V.YEARLY}, works AS (
  SELECT o_orderkey AS paper_key, CASE WHEN count(y.year) > 0 THEN 'W' || o_orderkey END AS work_id,
         nullif(count(y.year), 0) AS n_years, CAST(sum(y.cited_by_count) AS BIGINT) AS cited
  FROM orders LEFT JOIN yearly y ON y.paper_id = o_orderkey GROUP BY o_orderkey)"""


def _flat(parsed):
    return parsed.select(
        "paper_key",
        "work_id",
        F.when(F.col("counts_by_year").isNotNull(), F.size("counts_by_year")).cast("long").alias("n_years"),
        F.aggregate("counts_by_year", F.lit(0).cast("long"), lambda s, c: s + c["cited_by_count"]).alias("cited"),
    )


@query("s4_first_work", f"WITH {_WORKS} SELECT paper_key, work_id, n_years, cited FROM works")
def s4(spark, sf):
    return _flat(works.parse_works(_responses(spark, sf)))


@query(
    "s5_work_by_id",
    f"""WITH {_WORKS} SELECT paper_key, work_id, n_years, cited FROM works
WHERE work_id IN (SELECT 'W' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def s5(spark, sf):
    ids = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.concat(F.lit("W"), F.col("o_orderkey")).alias("work_id")
    )
    return _flat(works.work_by_id(works.parse_works(_responses(spark, sf)), ids))


def _requests(spark, sf):
    return V.table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "doc_id")


def _cached(spark, sf):
    """Already computed: the texts of labelled documents."""
    docs, labels = V.table(spark, sf, "documents"), V.table(spark, sf, "labels")
    return docs.join(labels, "doc_id").groupBy(F.sha2("text", 256).alias("key")).agg(
        F.max("n_chars").cast("string").alias("payload")
    )


_CACHED = "cached AS (SELECT DISTINCT sha256(text) AS key, n_chars FROM documents JOIN labels USING (doc_id))"


@query(
    "s6_cache_misses",
    f"""WITH {_CACHED} SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents
WHERE sha256(text) NOT IN (SELECT key FROM cached) GROUP BY 1""",
)
def s6(spark, sf):
    return cache.misses(_requests(spark, sf), _cached(spark, sf))


@query(
    "s6_whole_requests",
    """SELECT CAST(user_id AS VARCHAR) AS key, event_type, event_id FROM events
WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) = 1""",
)
def s6_whole(spark, sf):
    """The representative of a key is one of its requests, not the least of each column."""
    rows = V.table(spark, sf, "events").filter("event_type <> 'click'")
    requests = rows.select(F.col("user_id").cast("string").alias("key"), "event_type", "event_id")
    return cache.misses(requests, spark.createDataFrame([], "key STRING, payload STRING"))


@query(
    "j7_cache_hits",
    f"""WITH {_CACHED} SELECT sha256(text) AS key, doc_id, CAST(c.n_chars AS VARCHAR) AS payload
FROM documents d JOIN cached c ON c.key = sha256(d.text)""",
)
def j7(spark, sf):
    return cache.hits(_requests(spark, sf), _cached(spark, sf))


@query(
    "s6_stable_key",
    """SELECT event_id, sha256('{"endpoint":"' || event_type || '","id":"' || CAST(user_id AS VARCHAR) || '"}') AS key FROM events""",
)
def s6_key(spark, sf):
    return V.table(spark, sf, "events").select(
        "event_id",
        C.stable_key(F.col("event_type").alias("endpoint"), F.col("user_id").cast("string").alias("id")).alias("key"),
    )


@query(
    "s7_dataset_sink",
    f"""WITH {V.LABELLED} SELECT CAST(year(published) AS INTEGER) AS pub_year, count(*) AS n_rows FROM labelled GROUP BY 1""",
)
def s7(spark, sf):
    from impactlens.operators.labels import label_from_long_counts

    labelled = label_from_long_counts(V.papers(spark, sf), V.yearly(spark, sf), V.AS_OF)
    return tables.write_dataset(labelled, new_path(spark, "dataset"))


@query(
    "s7_dataset_build",
    f"""WITH {V.LABELLED} SELECT CAST(year(published) AS INTEGER) AS pub_year, count(*) AS n_rows FROM labelled
WHERE primary_cat = 'BUILDING' AND published BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1""",
)
def s7_build(spark, sf):
    """Feed entries and works to a labelled table by year, end to end."""
    papers = V.papers(spark, sf)
    feed_rows = papers.select(
        F.concat(F.lit("arXiv:"), F.col("paper_id").cast("string"), F.lit("v1")).alias("paper_id"), "title", F.lit("").alias("abstract"),
        "categories", F.array("title").alias("authors"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.lit(None).cast("string").alias("updated"),
    )
    counted = works.works_from_counts(V.yearly(spark, sf), "paper_id").withColumn("paper_key", F.col("paper_id").cast("string"))
    found = counted.select("paper_key", F.concat(F.lit("W"), F.col("paper_key")).alias("work_id"), "counts_by_year")
    return dataset.run(
        feed_rows, found, new_path(spark, "built"), category="BUILDING", start="1996-01-01", end="1999-12-31", as_of=V.AS_OF
    )


@query(
    "s8_dataset_scan",
    """SELECT o_orderkey AS paper_id, o_orderdate AS published FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'""",
)
def s8(spark, sf):
    schema = "o_orderkey BIGINT, o_orderdate TIMESTAMP_NTZ"
    scan = tables.read_dataset(spark, f"{sf}/orders.parquet", schema)
    year = (F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (
        F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    )
    return scan.filter(year).select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("published"))


@query(
    "s9_result_json",
    f"""WITH {V.PAPERS} SELECT '{{"paper_id":' || paper_id || ',"published":"' || strftime(published, '%Y-%m-%d %H:%M:%S')
  || '","primary_cat":"' || primary_cat || '","note":null}}' AS json FROM papers""",
)
def s9(spark, sf):
    rows = V.papers(spark, sf).select("paper_id", "published", "primary_cat", F.lit(None).cast("string").alias("note"))
    return tables.as_json(rows)


@query(
    "s10_newest_week",
    f"""WITH {V.RANKED} SELECT paper_id, published, y_pred FROM ranked
WHERE published >= (SELECT date_trunc('week', max(published)) FROM ranked)""",
)
def s10(spark, sf):
    return tables.newest_week(V.ranked(spark, sf)).select("paper_id", "published", "y_pred")


@query("s4_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props(spark, sf):
    parsed = F.from_json("props", "k BIGINT")["k"]
    return V.table(spark, sf, "events").select("event_id", parsed.alias("k"))
