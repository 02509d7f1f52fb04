"""Exact deduplication by sorting the contents.

Sampled splitters cut the order of the normalised texts into ranges, Spark's external sort brings equal
texts of a range together, and every text is compared in full with the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from impactlens.llm.columns import ascii_lower, shuffle_partitions, text_of
from impactlens.storage import new_path, stored

# Text of a range: bounds what one task sorts.
RANGE_BYTES = 32 << 20
# Ranges at most, as their splitters are part of the plan; beyond it ranges grow and their sorts spill.
MOST_RANGES = 4096
# Sampled rows for each splitter.
SAMPLED = 20
# Characters of a splitter. Texts that share them are ordered by their hash first.
SPLITTER_CHARS = 64


def _key(norm: Column) -> Column:
    return F.struct(F.substring(norm, 1, SPLITTER_CHARS).alias("head"), F.xxhash64(norm).alias("hash"))


def _place(splitters: list, key: Column, below: bool) -> Column:
    """How many splitters are below the key, or not above it: a binary search."""
    size = 1 << (len(splitters).bit_length() - 1)
    halves = F.array(*[F.lit(size >> i) for i in range(size.bit_length())])
    heads = F.array(*[F.lit(s["head"]) for s in splitters])
    hashes = F.array(*[F.lit(s["hash"]).cast("long") for s in splitters])

    def step(low: Column, half: Column) -> Column:
        at = low + half - 1
        head, value = F.get(heads, at), F.get(hashes, at)
        past = (value < key["hash"]) if below else (value <= key["hash"])
        return F.when((low + half <= len(splitters)) & ((head < key["head"]) | ((head == key["head"]) & past)), low + half).otherwise(low)

    return F.aggregate(halves, F.lit(0), step)


def _dealt(docs: DataFrame, id_col: str, text_col: str, parts: int | None, whole: bool = False) -> DataFrame:
    """(part, cut, row, id, norm) per row, dealt to `parts` ranges of the normalised texts; with `whole` the row itself
    too, as `given`, which then travels in place of the normalised text.

    A text that fills ranges by itself is dealt over them, and `cut` is their first; it is null for all others.
    """
    spark = docs.sparkSession
    norm = ascii_lower(text_of(text_col))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given")] if whole else []
    given = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *row)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
        parts = min(MOST_RANGES, max(2 * shuffle_partitions(spark), size // RANGE_BYTES + 1))
    rows = docs.count()
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    sample = given.sample(share, seed=7) if share < 1 else given
    keys = sorted(sample.select(_key(F.col("norm")).alias("k")).select("k.head", "k.hash").collect(), key=lambda r: (r["head"].encode(), r["hash"]))
    splitters = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []

    keyed = given.withColumn("key", _key(F.col("norm")))
    if splitters:
        low, high = _place(splitters, F.col("key"), True), _place(splitters, F.col("key"), False)
    else:
        low = high = F.lit(0)
    spread = F.pmod(F.xxhash64("id", F.col("row")), F.col("high") - F.col("low") + 1).cast("int")
    dealt = (
        keyed.withColumns({"low": low, "high": high, "row": F.monotonically_increasing_id()})
        .withColumn("part", F.col("low") + spread)
        .select("part", F.when(F.col("high") > F.col("low"), F.col("low")).alias("cut"), "row", *(["given"] if whole else ["id", "norm"]))
        .repartition(parts, "part")
    )
    if not whole:
        return dealt
    return dealt.withColumns({"id": F.col("given")[id_col], "norm": ascii_lower(F.coalesce(F.col("given")[text_col].cast("string"), F.lit("")))})


def _in_order(keep: str) -> WindowSpec:
    """The rows of a range by text, of equal texts the one to keep first."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    return W.partitionBy("part").orderBy("norm", best, "row")


def _better(keep: str, key: Column, row: Column) -> Column:
    """Of the first rows of the ranges that a frequent text fills, the id and row to keep."""
    pick = F.min if keep == "smallest" else F.max
    return pick(F.struct((key.isNull() if keep == "smallest" else key.isNotNull()).alias("none"), key.alias("id"), row.alias("row")))


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", parts: int | None = None
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per row, dropped ones too.

    Texts are equal when they are after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the smallest id is kept, or the one with the largest with keep="largest". A null id is kept
    only if its group has no other, and of repeated rows, which share the id to keep, one is kept. An
    empty table gives no rows; other columns are left out.

    The texts are shuffled once. A text so frequent that it fills ranges by itself is dealt over those
    ranges by row; only their totals, one row for each such range, are brought together again.
    """
    spark, order = docs.sparkSession, _in_order(keep)
    dealt = _dealt(docs, id_col, text_col, parts)
    before = F.lag("norm").over(order)
    runs = (
        dealt.withColumn("starts", (before.isNull() | (before != F.col("norm"))).cast("long"))
        .withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .select("part", "run", "starts", "cut", "row", "id", F.sha2("norm", 256).alias("text_sha256"))
    )
    run = W.partitionBy("part", "run")
    # the first row of a run has the id to keep
    first = F.struct(F.col("id"), F.col("row"))
    grouped = runs.withColumns(
        {"first": F.max(F.when(F.col("starts") == 1, first)).over(run), "n": F.count(F.lit(1)).over(run)}
    )
    path = new_path(spark, "runs")
    grouped.select("starts", "cut", "row", "id", "text_sha256", "first", "n").write.parquet(path)
    grouped = spark.read.schema(grouped.select("starts", "cut", "row", "id", "text_sha256", "first", "n").schema).parquet(path)

    # one run for each range that a frequent text fills: at most as many rows as ranges
    across = (
        grouped.filter("cut IS NOT NULL AND starts = 1")
        .groupBy("cut", "text_sha256")
        .agg(_better(keep, F.col("first.id"), F.col("first.row")).alias("all_first"), F.sum("n").alias("all_n"))
        .select("cut", "text_sha256", F.struct(F.col("all_first.id").alias("id"), F.col("all_first.row").alias("row")).alias("all_first"), "all_n")
    )
    found = grouped.join(F.broadcast(across), ["cut", "text_sha256"], "left")
    head = F.coalesce("all_first", "first")
    return found.select(
        F.col("id").alias(id_col),
        head["id"].alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        (F.col("row") == head["row"]).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one for each distinct normalised text: the one exact_duplicates keeps; of repeated rows one.

    Whole rows are shuffled once and the first of each text in its range is written; of a text that fills ranges by
    itself, one row for each such range, the best is looked up.
    """
    order = _in_order(keep)
    before = F.lag("norm").over(order)
    first = _dealt(docs, id_col, text_col, None, whole=True).withColumn("starts", before.isNull() | (before != F.col("norm"))).filter("starts")
    sha = F.when(F.col("cut").isNotNull(), F.sha2("norm", 256)).alias("text_sha256")
    kept = stored(first.select("cut", sha, "id", "row", "given"), "kept")
    across = kept.filter("cut IS NOT NULL").groupBy("cut", "text_sha256").agg(_better(keep, F.col("id"), F.col("row"))["row"].alias("best"))
    found = kept.join(F.broadcast(across), ["cut", "text_sha256"], "left")
    return found.filter("best IS NULL OR best = row").select("given.*")
