"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

All arithmetic is on whole numbers. Parts and entries, padded with zeros to a power of two m, go through
an integer Walsh-Hadamard transform, under which squared distances grow by the factor m. Vectors differ
most in their slow coefficients, so the scaled squared differences are summed in the order of sequency,
and an entry is out as soon as its sum passes the whole distance of an entry that is known already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from impactlens.llm.columns import schema_of
from impactlens.operators.skew import spread_join
from impactlens.storage import new_path

# Parts compared with all entries in one go: what they need stays in a processor's cache.
BLOCK = 256
# Coefficients summed before entries are struck out again; the pairs left are followed one by one once they are
# no more than one in so many.
STEP = 4
FEW = 10
# Values, transformed and squared, up to which sums stay within 64 bits; beyond it Python's integers do the work.
SAFE = 1 << 62


def sequency_order(m: int) -> np.ndarray:
    """The rows of the Walsh-Hadamard matrix of m = 2^k by their number of sign changes.

    Row i of the matrix in natural order has inverse_gray(reversed bits of i) sign changes.
    """
    bits = m.bit_length() - 1
    changes = np.zeros(m, np.int64)
    for i in range(m):
        code = int(f"{i:b}".zfill(bits)[::-1], 2) if bits else 0
        while code:
            changes[i] ^= code
            code >>= 1
    return np.argsort(changes)


def transform(points: np.ndarray, m: int) -> np.ndarray:
    """The coefficients of the rows, padded with zeros to m columns, in the order of sequency."""
    out = np.zeros((len(points), m), points.dtype)
    out[:, : points.shape[1]] = points
    half = 1
    while half < m:
        pairs = out.reshape(len(out), m // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), m)
        half *= 2
    return out[:, sequency_order(m)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients its nearest entry, of equals the first, and m times the squared distance."""
    n, m = points.shape
    columns = np.ascontiguousarray(entries.T)
    reached = np.zeros((n, len(entries)), points.dtype)
    apart = np.empty_like(reached)
    bound = None
    for low in range(0, m, STEP):
        for c in range(low, min(low + STEP, m)):
            np.subtract(points[:, c, None], columns[c], out=apart)
            np.multiply(apart, apart, out=apart)
            reached += apart
        whole = ((points - entries[reached.argmin(axis=1)]) ** 2).sum(axis=1)
        bound = whole if bound is None else np.minimum(bound, whole)
        alive = reached <= bound[:, None]
        if FEW * np.count_nonzero(alive) <= alive.size:
            break
    row, entry = np.nonzero(alive)
    left = reached[row, entry]
    for low in range(low + STEP, m, STEP):
        between = points[row, low : low + STEP] - entries[entry, low : low + STEP]
        left = left + (between * between).sum(axis=1)
        stay = left <= bound[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[: len(row)]
    best = np.minimum.reduceat(left, starts) if len(row) else left
    hit = np.flatnonzero(left == np.repeat(best, np.diff(np.r_[starts, len(row)])))
    first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]][: len(hit)]]
    return entry[first], best


@dataclass
class Codebooks:
    """`books[p]`: the entries of part p, (entries, part width); `scale` turns components into whole numbers."""

    books: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    @property
    def padded(self) -> int:
        return 1 << max(0, (self.width - 1).bit_length())

    def parts(self, vectors: pa.Array) -> np.ndarray:
        """(vector, part, component) of whole numbers; a short vector is extended by zeros."""
        ends = vectors.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(ends)
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * self.scale)
        kind = self.books[0].dtype
        out = np.zeros((len(sizes), len(self.books) * self.width), kind)
        at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), at] = [int(x) for x in flat] if kind == object else flat.astype(np.int64)
        return out.reshape(len(sizes), len(self.books), self.width)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) entry numbers, and the squared distances."""
        m = self.padded
        entries = [transform(book, m) for book in self.books]
        codes = np.zeros(parts.shape[:2], np.int64)
        apart = np.zeros(parts.shape[:2], parts.dtype)
        for low in range(0, len(parts), BLOCK):
            for p, own in enumerate(entries):
                codes[low : low + BLOCK, p], scaled = nearest(transform(parts[low : low + BLOCK, p], m), own)
                apart[low : low + BLOCK, p] = scaled // m
        return codes, apart

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def fit_codebooks(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Codebooks:
    """Codebooks of `entries` entries for each of `parts` equal parts of the usable vectors.

    They begin with the vectors of the smallest ids (of equal ids and of null ids, which come last, the
    vector decides) and are moved `rounds` times to the floor of the mean of the parts nearest to them; an
    entry without parts stays. Vectors shorter than the longest are extended by zeros, as is a length that
    `parts` does not divide. Every round is one pass that hands on a sum for each entry and task; only the
    sums over all tasks, as many as there are entries, reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    size, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    width = -(-(size or 0) // parts)
    padded = 1 << max(0, (width - 1).bit_length())
    largest = int((most or 0.0) * scale) + 1
    kind = np.int64 if padded * padded * (2 * largest) ** 2 < SAFE else object
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    made = Codebooks([np.zeros((len(first), width), kind) for _ in range(parts)], scale)
    started = made.parts(pa.array([r["v"] for r in first], pa.list_(pa.float64())))
    made.books = [started[:, p] for p in range(parts)]
    for _ in range(rounds if first else 0):
        made = _moved(rows, made, spark.sparkContext.broadcast(made))
    return made


def _moved(rows: DataFrame, old: Codebooks, shared) -> Codebooks:
    """The entries at the floor of the mean of their parts."""
    entries, width = old.books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        total = np.zeros((len(books.books) * entries, width + 1), books.books[0].dtype)  # the last column counts
        for batch in batches:
            parts = books.parts(batch.column(0))
            codes, _ = books.assign(parts)
            for p in range(len(books.books)):
                own = np.ones((len(parts), width + 1), total.dtype)
                own[:, :width] = parts[:, p]
                np.add.at(total, p * entries + codes[:, p], own)
        slot, at = np.divmod(np.flatnonzero(total[:, width] > 0)[:, None] * (width + 1) + np.arange(width + 1), width + 1)
        values = [Decimal(int(x)) for x in total[slot, at].ravel()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["slot", "at", "total"]
        )

    found = rows.select("v").mapInArrow(sums, "slot int, at int, total decimal(38,0)").groupBy("slot", "at").agg(F.sum("total").alias("total"))
    total = {(r["slot"], r["at"]): int(r["total"]) for r in found.collect()}
    books = [book.copy() for book in old.books]
    for (slot, at), value in total.items():
        if at < width:
            books[slot // entries][slot % entries, at] = value // total[slot, width]
    return Codebooks(books, old.scale)


def encode_vectors(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, codes, error) per usable vector: a byte for each part, and the squared distance over all parts.

    An error beyond 64 bits is null. Repeated rows are kept, an empty table gives no rows.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, apart = shared.value.assign(shared.value.parts(batch.column(2)))
            errors = [e if e < 1 << 63 else None for e in apart.sum(axis=1).tolist()]
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(errors, pa.int64())], ["id", "label", "codes", "error"]
            )

    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    coded = given.filter(usable(F.col("v"))).mapInArrow(encode, schema_of(given, id="=id", label="=label", codes="binary", error="long"))
    return coded.withColumnsRenamed({"id": id_col, "label": label_col})


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(id, label, codes, error, label_error) per usable vector, and the codebooks.

    A component x counts as floor(scale * x). A vector that is null or holds a null or non-finite
    component is left out. `label_error` is the sum over rows of one label, nulls together; a sum beyond 64 bits is null. Repeated rows
    are kept; an empty table gives no rows and empty codebooks; other columns are left out. The vectors
    and the codes go to the shared folder, so a lost executor costs only its running tasks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession, "codes")
    given = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    given.write.parquet(path + "/given")
    given = spark.read.schema(given.schema).parquet(path + "/given")
    books = fit_codebooks(given, parts, entries, rounds, scale, "id", "v")
    coded = encode_vectors(given, books, "id", "v", "label").withColumn("key", F.struct("label"))
    coded.write.parquet(path + "/coded")
    coded = spark.read.schema(coded.schema).parquet(path + "/coded")
    coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("cnt")).write.parquet(path + "/labels")
    labels = spark.read.parquet(path + "/labels")
    found = spread_join(coded, labels.drop("cnt"), "key", counts=labels)
    return found.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error", "label_error"), books
