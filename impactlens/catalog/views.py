"""The paper model over the given tables, in Spark and as the same SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2001-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers, the customer's segment as their field."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.col("o_orderkey").alias("paper_id"),
        F.col("o_orderdate").alias("published"),
        F.col("c_mktsegment").alias("primary_cat"),
        F.array("c_mktsegment", "o_orderpriority").alias("categories"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("title"),
        F.col("o_totalprice").alias("price"),
    )


PAPERS = """papers AS (
  SELECT o_orderkey AS paper_id, o_orderdate AS published, c_mktsegment AS primary_cat,
         o_orderpriority AS second_cat, o_orderstatus || ' ' || o_orderpriority AS title, o_totalprice AS price
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def authors(spark: SparkSession, sf: str, column: str = "l_partkey") -> DataFrame:
    """Long authorship: the parts (or suppliers) of an order are its authors."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"), F.col(column).cast("string").alias("author")
    )
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("published"))
    return lines.distinct().join(dates, "paper_id")


AUTHORS = """authors AS (
  SELECT DISTINCT l_orderkey AS paper_id, CAST(l_partkey AS VARCHAR) AS author FROM lineitem)"""

AUTHORS_S = AUTHORS.replace("l_partkey", "l_suppkey")

# AUTHORS must precede; @cutoff is replaced by a condition on published
EDGES = """edges AS (
  SELECT a.author AS u, b.author AS v, count(*) AS weight
  FROM authors a JOIN authors b ON a.paper_id = b.paper_id AND a.author < b.author
  GROUP BY 1, 2),
arcs AS (SELECT u AS src, v AS dst, weight FROM edges UNION ALL SELECT v, u, weight FROM edges)"""


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Citations per paper and calendar year: shipped quantity."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paper_id"), F.year("l_shipdate").alias("year"))
        .agg(F.sum("l_quantity").cast("long").alias("cited_by_count"))
    )


YEARLY = """yearly AS (
  SELECT l_orderkey AS paper_id, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(l_quantity) AS BIGINT) AS cited_by_count
  FROM lineitem GROUP BY 1, 2)"""


def label_sql(horizon_days: int = 365, years_after: int = 1, as_of: str = AS_OF) -> str:
    """labelled: papers with y12 (PAPERS and YEARLY must precede)."""
    return f"""labelled AS (
  SELECT p.*, l.y12 FROM papers p JOIN (
    SELECT q.paper_id, CAST(sum(CASE WHEN y.year BETWEEN year(q.published) AND year(q.published) + {years_after}
                               THEN y.cited_by_count ELSE 0 END) AS BIGINT) AS y12
    FROM papers q JOIN yearly y ON y.paper_id = q.paper_id GROUP BY 1) l ON l.paper_id = p.paper_id
  WHERE p.published <= TIMESTAMP '{as_of} 00:00:00' - INTERVAL {horizon_days} DAY)"""


LABELLED = f"{PAPERS},\n{YEARLY},\n{label_sql()}"


def doc_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as papers: first line the title, the rest the abstract."""
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("paper_id"),
        title.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("abstract"),
        F.col("lang").alias("primary_cat"),
        F.array("lang", "source").alias("categories"),
        F.col("n_chars"),
    )


DOC_PAPERS = """doc_papers AS (
  SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title,
         substring(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
         lang AS primary_cat, source, n_chars
  FROM documents)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a truth (all citations) and a coarse, hence tied, prediction."""
    cites = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(
        F.sum("l_quantity").cast("long").alias("y_true")
    )
    return papers(spark, sf).join(cites, "paper_id").withColumn("y_pred", F.floor(F.col("price") / 5000).cast("double"))


RANKED = f"""{PAPERS},
ranked AS (
  SELECT p.*, c.y_true, CAST(floor(p.price / 5000) AS DOUBLE) AS y_pred
  FROM papers p JOIN (SELECT l_orderkey AS paper_id, CAST(sum(l_quantity) AS BIGINT) AS y_true FROM lineitem GROUP BY 1) c
    ON c.paper_id = p.paper_id)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("paper_id"), "embedding", "label")


def subscription_log(spark: SparkSession, sf: str) -> DataFrame:
    return subscription_events(table(spark, sf, "events"))


def subscription_events(events: DataFrame) -> DataFrame:
    """Sign-ups subscribe, errors unsubscribe; clicks carry an address without a domain."""
    domain = F.when(F.col("event_type") == "click", "@example").otherwise("@Example.com ")
    return events.select(
        F.concat(F.lit(" User"), F.col("user_id"), domain).alias("email"),
        F.when(F.col("event_type") == "error", "unsubscribe").otherwise("subscribe").alias("action"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        "event_type",
    ).filter(F.col("event_type").isin("signup", "error", "click"))


SUBSCRIPTIONS = """subscription_log AS (
  SELECT ' User' || user_id || CASE WHEN event_type = 'click' THEN '@example' ELSE '@Example.com ' END AS email,
         CASE WHEN event_type = 'error' THEN 'unsubscribe' ELSE 'subscribe' END AS action, ts AS "at", event_id AS seq
  FROM events WHERE event_type IN ('signup', 'error', 'click'))"""
