"""SimHash near-duplicates over segment bit counts.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. Every differing bit
changes one count by one at most, so the Manhattan distance of two count vectors is a lower bound of
the number of differing bits. The segments are dealt to a few grids, so many that fingerprints within
the wanted distance are at most 2 apart in one grid; there each fingerprint visits its own cell and
the cells one step away, two of them meet in a cell, and the differing bits are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from impactlens.llm.columns import schema_of, shuffle_partitions, text_of, unused
from impactlens.llm.components import smallest_reachable
from impactlens.operators.skew import spread_join
from impactlens.storage import new_path

SEED = 42
SEGMENTS = 32
# Shingles hashed at once: bounds the memory for a long text.
AT_ONCE = 1 << 16


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Lower-case A-Z, split at ASCII white space, and hash all word shingles, some at once; signed longs."""
    parts = text.encode().lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.r_[0, ends[:-1]].tolist()
    stops = (ends - 1).tolist()
    n = max(1, len(parts) - words + 1)
    for low in range(0, n, AT_ONCE):
        high = min(n, low + AT_ONCE)
        last = stops[low + words - 1 : high + words - 1] if n > 1 or len(parts) >= words else [stops[-1]]
        shingles = map(joined.__getitem__, map(slice, starts[low:high], last))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", high - low).view("<i8")


def fingerprint(text: str, words: int) -> int:
    """The vote over the hashes of all word shingles; 0 if there is none."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row: the 64 bits as a signed long."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(hash_all, schema_of(given, id="=id", fp="long")).withColumnRenamed("id", id_col)


def segment_counts(fp: Column) -> Column:
    """The bit counts of all segments, two bits for each count, in the place of the segment."""
    odd, other = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(other).bitwiseAND(odd), fp.bitwiseXOR(other).bitwiseAND(odd)
    return F.shiftleft(both, 1).bitwiseOR(one)


def cell_visits(fps: DataFrame, max_bits: int) -> DataFrame:
    """(grid, cell, step, fp): the own cell of a fingerprint in each grid (step 0) and those a step away.

    Step ±(s + 1) moves the count of segment s by ±1, where that count can be. A cell is the counts
    of the grid's segments at their places.
    """
    grids = max_bits // 3 + 1  # then max_bits // grids <= 2
    cuts = [SEGMENTS * g // grids for g in range(grids + 1)]
    steps = ", ".join(
        f"struct({g} AS grid, {step} AS step)"
        for g in range(grids)
        for step in (0, *(sign * (s + 1) for s in range(cuts[g], cuts[g + 1]) for sign in (1, -1)))
    )
    mask = F.lit(0).cast("long")
    for g in range(grids):
        bits = ((1 << 2 * cuts[g + 1]) - 1) ^ ((1 << 2 * cuts[g]) - 1)
        mask = F.when(F.col("grid") == g, F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")).otherwise(mask)
    shift = "cast(2 * (abs(step) - 1) AS int)"
    count = F.expr(f"shiftrightunsigned(counts, {shift}) & 3L")
    flipped = F.expr(f"shiftleft((shiftrightunsigned(counts, {shift}) & 3L) ^ ((shiftrightunsigned(counts, {shift}) & 3L) + cast(signum(step) AS bigint)), {shift})")
    possible = F.when(F.col("step") > 0, count < 2).when(F.col("step") < 0, count > 0).otherwise(True)
    return (
        fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
        .select("fp", "counts", F.expr(f"inline(array({steps}))"))
        .filter(possible)
        .select(
            "grid",
            F.col("counts").bitwiseAND(mask).bitwiseXOR(F.when(F.col("step") == 0, F.lit(0).cast("long")).otherwise(flipped)).alias("cell"),
            "step",
            "fp",
        )
    )


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b), a < b, for all pairs of distinct fingerprints that differ in at most `max_bits` bits; a pair may come once per grid.

    Within a grid a pair is met once: at home of `a` if the cells are up to one step apart, else in the
    one of two cells between them where a's segment comes first. What is not within the distance
    never leaves the join.
    """
    visits = cell_visits(fps, max_bits)
    left = visits.select("grid", "cell", F.col("step").alias("step_a"), F.col("fp").alias("a"))
    right = visits.select("grid", "cell", F.col("step").alias("step_b"), F.col("fp").alias("b"))
    a, b = F.col("step_a"), F.col("step_b")
    once = (F.col("a") < F.col("b")) & ((a == 0) | ((b != 0) & ((F.abs(a) < F.abs(b)) | (a == -b))))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return left.join(right.hint("merge"), ["grid", "cell"]).filter(near & once).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) per row: fingerprint and the smallest id reachable over links of at most `max_bits` bits.

    Rows with one fingerprint are linked (so also all rows without words, of fingerprint 0), and only
    distinct fingerprints are compared, each through some fifty cells whatever the size of its group.
    Null texts count as empty. Repeated rows are kept; a null id is returned with the smallest id of its
    component (null if there is none); an empty table gives no rows; other columns are left out.
    Fingerprints and links go to the shared folder, so a lost executor costs only its running tasks.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "simhash")
    fingerprints(docs, words, id_col, text_col).withColumnRenamed(id_col, "id").write.parquet(path + "/fp")
    prints = spark.read.parquet(path + "/fp")
    prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("cnt")).write.parquet(path + "/groups")
    groups = spark.read.parquet(path + "/groups")
    # a small table whose rows each visit some fifty cells: dealt to all tasks
    dealt = groups.select("fp").repartition(shuffle_partitions(spark), "fp")
    links(dealt, max_bits).distinct().write.parquet(path + "/links")
    # A node begins with the smallest id of its fingerprint, so the smallest node of a component has the id that is
    # wanted. No fingerprint has more links than there are numbers within the distance.
    node = groups.select("fp", F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias("node"))
    pairs = spark.read.parquet(path + "/links")
    pairs = pairs.join(node.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a")
    pairs = pairs.join(node.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    linked = smallest_reachable(pairs, "x", "y").select(F.col("node.fp").alias("fp"), F.col("root.first").alias("least"), F.lit(True).alias("linked"))
    member = groups.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return spread_join(prints, member, "fp", counts=groups.select("fp", "cnt")).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, one of each component of near_duplicates: the one with the smallest id, of repeated rows one.

    Of equal ids the text decides; a null id comes after all others.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "dropped")
    key = unused(docs, "key")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("at"))
    keyed = docs.withColumn(key, order)
    found = near_duplicates(keyed.select(order.alias("key"), F.col(text_col).alias("text")), words, max_bits, "key", "text")
    found.filter(F.col("key") != F.col("component_id")).select(F.col("key").alias(key)).distinct().write.parquet(path)
    kept = keyed.join(spark.read.parquet(path), key, "left_anti")
    return kept.dropDuplicates([key]).drop(key) if _repeats(keyed, key) else kept.drop(key)


def _repeats(keyed: DataFrame, key: str) -> bool:
    """Whether a key stands in more than one row."""
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return bool(counts.filter("n > 1").limit(1).count())
