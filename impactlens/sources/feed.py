"""Paper feed: Atom XML to rows, category scans, lookups by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactlens import schemas
from impactlens.functions import columns as C


def _entry_columns(entry: str = "") -> list:
    col = lambda name: F.col(f"{entry}.{name}" if entry else name)
    names = F.coalesce(F.transform(col("author"), lambda a: a["name"]), F.array())
    terms = F.coalesce(F.transform(col("category"), lambda c: c["_term"]), F.array())
    return [
        C.id_from_url(col("id")).alias("paper_id"),
        C.clean_text(col("title")).alias("title"),
        C.clean_text(col("summary")).alias("abstract"),
        # a category without a term and an author without a name do not count
        F.filter(terms, lambda t: t.isNotNull() & (t != "")).alias("categories"),
        F.filter(names, lambda n: n.isNotNull()).alias("authors"),
        col("published").alias("published"),
        col("updated").alias("updated"),
    ]


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed files (splittable, one row per entry)."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schemas.FEED_ENTRY).load(path)
    return raw.select(*_entry_columns())


def parse_feed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """A table of response bodies, one `feed` document per row."""
    return (
        bodies.select(F.explode(F.from_xml(body, schemas.FEED)["entry"]).alias("e"))
        .select(*_entry_columns("e"))
    )


def category_window(
    papers: DataFrame, category: str, start: str, end: str, limit: int | None = None
) -> DataFrame:
    """Papers with `category` anywhere in their list, published from `start` to `end` inclusive.

    A bare end date means its midnight, so papers later on that day are out. Null dates are out.
    Order is by submission; `limit` None or 0 means all.
    """
    lower, upper = (F.lit(d).cast("timestamp_ntz") for d in (start, end))
    found = papers.filter(
        (F.col("published") >= lower)
        & (F.col("published") <= upper)
        & F.array_contains("categories", category)
    ).orderBy("published", "paper_id")
    return found.limit(limit) if limit else found


def lookup(papers: DataFrame, ids: DataFrame, key: str = "paper_id") -> DataFrame:
    """The papers whose id is in `ids`; at most one row per paper row."""
    return papers.join(ids.select(key), key, "left_semi")


def dataset_columns(papers: DataFrame) -> DataFrame:
    """Add n_authors, primary_cat, month and pub_year to parsed papers."""
    return papers.withColumns(
        {
            "n_authors": C.array_length(F.col("authors")),
            "primary_cat": C.first_or_null(F.col("categories")),
            "month": F.month("published"),
            "pub_year": F.year("published"),
        }
    )


def from_manual_entry(rows: DataFrame) -> DataFrame:
    """Comma-joined authors and categories to the array form.

    Empty pieces stay in the arrays, yet n_authors counts only the others.
    """
    authors = C.comma_list(F.col("authors"))
    return rows.withColumns(
        {
            "n_authors": C.count_nonempty(authors),
            "primary_cat": C.first_category(F.col("categories")),
            "authors": authors,
            "categories": C.comma_list(F.col("categories")),
        }
    )


def paper_card(papers: DataFrame, n_authors: int = 5, n_chars: int = 500) -> DataFrame:
    """Short display form of a paper."""
    return papers.select(
        "paper_id",
        "title",
        C.leading(F.col("authors"), n_authors).alias("lead_authors"),
        C.remainder(F.col("authors"), n_authors).alias("more_authors"),
        C.shorten(C.text(F.col("abstract")), n_chars).alias("abstract"),
    )


def from_flat_dataset(rows: DataFrame) -> DataFrame:
    """The flat table form (comma-joined authors, one category, ISO date text, citations_<n>mo) to arrays and y<n>."""
    horizons = {f"citations_{h}mo": f"y{h}" for h in (6, 12, 24)}
    return rows.withColumns(
        {
            "authors": C.comma_list(F.col("authors")),
            "categories": C.comma_list(F.col("categories")),
            "published": C.iso_timestamp(F.col("published")),
        }
    ).withColumnsRenamed({old: new for old, new in horizons.items() if old in rows.columns})
