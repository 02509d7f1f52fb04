"""Small column helpers the operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def text_of(column: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def schema_of(df: DataFrame, **columns: str) -> str:
    """A schema in DDL: each name with a type, or with the type of a column given as '=name'."""

    def kind(spec: str) -> str:
        return df.schema[spec[1:]].dataType.simpleString() if spec.startswith("=") else spec

    return ", ".join(f"`{name}` {kind(spec)}" for name, spec in columns.items())


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def number_array(values: Iterable[float]) -> Column:
    """Many numbers as one literal: a folded cast, not an expression for each number."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
