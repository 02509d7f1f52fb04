"""Parquet and JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from impactlens import schemas


def write_dataset(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write a dataset by publication year, sorted by date inside each file so that date filters
    skip row groups. Returns (pub_year, rows) of what is on disk."""
    if "pub_year" not in df.columns:
        df = df.withColumn("pub_year", F.year("published"))
    # pub_year alone would send a hot year to one task; range cuts split it by date
    (
        df.repartitionByRange("pub_year", "published", "paper_id")
        .sortWithinPartitions("pub_year", "published")
        .write.mode(mode).partitionBy("pub_year").parquet(path)
    )
    return df.sparkSession.read.parquet(path).groupBy("pub_year").agg(F.count(F.lit(1)).alias("n_rows"))


def read_dataset(spark: SparkSession, path: str, schema: str = schemas.DATASET) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text per row; values JSON has no form for are rendered as text."""
    plain = [
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date", "binary", "decimal")
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    as_json(df, "value").write.mode(mode).text(path)


def newest_week(papers: DataFrame) -> DataFrame:
    """The papers of the latest submission week in the table."""
    start = papers.agg(F.date_trunc("week", F.max("published")).cast("timestamp_ntz").alias("w")).scalar()
    return papers.filter(F.col("published") >= start)
