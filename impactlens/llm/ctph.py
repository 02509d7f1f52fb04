"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of a text sets the ends of its chunks, so an edit moves only
the ends next to it. A fingerprint is `block:signature:signature`: one character for each chunk at a
block size that follows from the length, and at twice that size. Fingerprints are compared by the edit
distance of the signatures at a block size both have.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from impactlens.llm.columns import schema_of, shuffle_partitions, text_of

WINDOW = 7
SMALLEST = 3  # block sizes are SMALLEST * 2 ** k
WANTED = 64  # chunks a text of random content is cut into, or up to half of it
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
# Bytes hashed at once; a longer text is gone through in slices that overlap by a window.
AT_ONCE = 1 << 20
# Text of a range: bounds what one task sorts.
RANGE_BYTES = 32 << 20


def chunk_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the bytes that end a chunk at the smallest block size, and for each the largest k it still does at."""
    ends, levels = [], []
    for low in range(0, len(data), AT_ONCE):
        part = np.zeros(min(AT_ONCE, len(data) - low) + WINDOW - 1, np.uint32)
        known = np.frombuffer(data, np.uint8)[max(0, low - WINDOW + 1) : low + AT_ONCE]
        part[len(part) - len(known) :] = known
        n = len(part) - WINDOW + 1
        plain, weighted, mixed = (np.zeros(n, np.uint32) for _ in range(3))
        for back in range(WINDOW):
            b = part[WINDOW - 1 - back : WINDOW - 1 - back + n]
            plain += b
            weighted += b * np.uint32(WINDOW - back)
            mixed ^= b << np.uint32(5 * back)  # older bits leave the 32-bit word
        rolled = plain + weighted + mixed + np.uint32(1)
        at = np.flatnonzero((rolled % SMALLEST == 0) & (rolled != 0))
        lowest = rolled[at] & (~rolled[at] + np.uint32(1))
        ends.append(at + low + 1)
        levels.append(np.log2(lowest.astype(np.float64)).astype(np.int8))
    return (np.concatenate(ends), np.concatenate(levels)) if ends else (np.zeros(0, np.int64), np.zeros(0, np.int8))


def signature(data: bytes, ends: np.ndarray) -> str:
    cuts = ends.tolist()
    if data and (not cuts or cuts[-1] < len(data)):
        cuts.append(len(data))
    view, start, out = memoryview(data), 0, []
    for end in cuts:
        out.append(ALPHABET[zlib.crc32(view[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """`block:signature:signature` of the whole text in UTF-8."""
    data = text.encode()
    ends, levels = chunk_ends(data)
    k = 0
    while SMALLEST * WANTED << k < len(data):
        k += 1
    while k and np.count_nonzero(levels >= k) < WANTED // 2 - 1:
        k -= 1
    while np.count_nonzero(levels >= k) >= 2 * WANTED:  # repetitive text; ends, as no level is above 32
        k += 1
    return f"{SMALLEST << k}:{signature(data, ends[levels >= k])}:{signature(data, ends[levels >= k + 1])}"


def likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, at the block size both fingerprints have; 0 if they have none.

    Equal fingerprints give 1. Null if one is null.
    """

    def part(x: Column, i: int) -> Column:
        return F.split_part(x, F.lit(":"), F.lit(i))

    def alike(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longer)

    block_a, block_b = part(a, 1).cast("long"), part(b, 1).cast("long")
    return (
        F.when(a == b, 1.0)
        .when(block_a == block_b, F.greatest(alike(part(a, 2), part(b, 2)), alike(part(a, 3), part(b, 3))))
        .when(block_a == 2 * block_b, alike(part(a, 2), part(b, 3)))
        .when(block_b == 2 * block_a, alike(part(a, 3), part(b, 2)))
        .when(a.isNotNull() & b.isNotNull(), 0.0)
    )


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row; null counts as empty, whose fingerprint is `3::`. Equal texts have equal ones.

    Repeated rows are kept, an empty table gives no rows, other columns are left out. Nothing is shuffled.
    """

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["id", "fingerprint"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(hash_all, schema_of(given, id="=id", fingerprint="string")).withColumnRenamed("id", id_col)


def dealt_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, copy, id, text): rows in ranges of falling id, each range sorted in a partition.

    The first row of each range also ends the range before it, as a copy (that of the first range ends
    the last one), so every row finds its successor in its own range. The texts are shuffled once.
    Ids are whole numbers; a null id comes last; equal ids are in the order of their texts.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
        parts = max(2 * shuffle_partitions(spark), size // RANGE_BYTES + 1)
    least = F.lit(-(1 << 63))
    given = docs.select(
        F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")
    ).withColumn("place", F.coalesce("id", least))
    # approximate quantiles only set the sizes of the ranges
    shares = [i / parts for i in range(1, parts)]
    found = given.agg(F.percentile_approx("place", shares, 10 * parts)).first()[0] if shares else None
    cuts = sorted(set(found or []), reverse=True)
    part = F.lit(0)
    if cuts:
        # binary search for the number of cuts above the id
        size = 1 << (len(cuts).bit_length() - 1)
        halves = F.array(*[F.lit(size >> i) for i in range(size.bit_length())])
        table = F.array(*[F.lit(c).cast("long") for c in cuts])
        part = F.aggregate(
            halves,
            F.lit(0),
            lambda low, half: F.when(
                (low + half <= len(cuts)) & (F.get(table, low + half - 1) > F.col("place")), low + half
            ).otherwise(low),
        )
    ranged = given.withColumn("part", part)
    # one row for each range: its first id
    heads = sorted((r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.max("place").alias("head")).collect())
    if not heads:
        return ranged.select("part", F.lit(False).alias("copy"), "id", "text")
    first = {part: head for part, head in heads}
    before = {part: heads[i - 1][0] for i, (part, _) in enumerate(heads)}
    numbers = range(len(cuts) + 1)
    first_of = F.array(*[F.lit(first.get(i)).cast("long") for i in numbers])
    target = F.when(
        F.get(first_of, F.col("part")) == F.col("place"), F.get(F.array(*[F.lit(before.get(i, 0)) for i in numbers]), F.col("part"))
    )
    home = F.struct(F.col("part"), F.lit(False).alias("copy"))
    places = F.when(target.isNull(), F.array(home)).otherwise(F.array(home, F.struct(target.alias("part"), F.lit(True).alias("copy"))))
    return (
        ranged.select("place", "id", "text", F.explode(places).alias("to"))
        .select("to.part", "to.copy", "place", "id", "text")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "copy", F.desc("place"), "text")
        .select("part", "copy", "id", "text")
    )


def compare_with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) per row.

    The edited text is the row's with its last floor(n / 2) characters replaced by as many of the first
    ones of the next row by falling id, or by all it has; after the last row comes the first, so a single
    row follows itself. Null texts count as empty; repeated rows follow each other; an empty table gives
    no rows; other columns are left out.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        last: tuple | None = None  # part, copy, id, text, fingerprint
        for batch in batches:
            rows = []
            for part, copy, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = (part, copy, i, text, last[4] if last and last[3] == text else fingerprint(text))
                if last and last[0] == part and not last[1]:
                    half = len(last[3]) // 2
                    edited = last[3][: len(last[3]) - half] + text[:half]
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    rows.append((last[2], len(last[3]), digest, last[4], fingerprint(edited), own[4]))
                last = own
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [batch.schema.field(2).type, pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ordered = dealt_in_order(docs, id_col, text_col)
    text = {"edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "next_fingerprint": "string"}
    return ordered.mapInArrow(pairs, schema_of(ordered, id="=id", n_chars="long", **text)).withColumnRenamed("id", id_col)
