"""Approximate nearest older papers: random-projection hashing in several tables, with candidates verified.

Each table cuts the space by a few random planes; the sides a vector lies on are its bucket. A paper visits, in
every table, its own bucket and those next to it that it is nearest to, and is compared there with all older
members. All similarities are exact, only a neighbour that shares no visited bucket is missed. The buckets
keep their size as the table grows, as more planes are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from impactlens.storage import new_path

SEED = 42
TABLES, PROBES = 8, 8
# Members of a bucket that the number of planes aims at, and rows of either side compared in one task at once.
BUCKET = 256
BLOCK = 4096
# Planes of a table at most, and planes a visit may cross.
MOST_PLANES, CROSSED = 24, 3


def planes(tables: int, dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(tables, dim, bits): random directions, at right angles within a table as far as the dimensions allow."""
    rng = np.random.default_rng(seed)
    drawn = rng.normal(size=(tables, dim, bits))
    return np.stack([np.linalg.qr(t)[0] if bits <= dim else t for t in drawn])


def buckets(unit: np.ndarray, table: np.ndarray, probes: int) -> np.ndarray:
    """(row, probe): the own bucket and the next nearest ones by the squared distances to the planes between."""
    side = unit @ table
    bits = side.shape[1]
    crossed = [c for n in range(min(bits, CROSSED) + 1) for c in combinations(range(bits), n)]
    flips = np.array([sum(1 << i for i in c) for c in crossed], np.int64)
    uses = np.zeros((len(crossed), bits))
    for i, c in enumerate(crossed):
        uses[i, list(c)] = 1.0
    nearest = np.argsort((side * side) @ uses.T, axis=1, kind="stable")[:, :probes]
    return ((side > 0) @ (1 << np.arange(bits)).astype(np.int64))[:, None] ^ flips[nearest]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def approximate_nearest_older(
    vectors: DataFrame, k: int = 5, age: str = "paper_id", tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET
) -> DataFrame:
    """(paper_id, neighbour, similarity, position): of the papers with smaller `age` those met in a bucket with the
    highest cosine similarity, at most k, equal similarities by age and neighbour id.

    `vectors` is (paper_id, embedding, age), all vectors of one length; null vectors and those of zeros have no
    direction and are left out. A boolean column `query`, if there is one, says for whom neighbours are wanted;
    all rows are indexed. Of equal vectors the k oldest alone are members, as no others can be among anyone's
    k nearest. A bucket with more than BLOCK rows is compared in blocks by several tasks; none is cut short.
    """
    asked = F.coalesce(F.col("query"), F.lit(False)) if "query" in vectors.columns else F.lit(True)
    spark, path = vectors.sparkSession, new_path(vectors.sparkSession, "lsh")
    given = vectors.select("paper_id", F.col(age).alias("age"), F.transform("embedding", lambda x: x.cast("float")).alias("vec"), asked.alias("query"))
    given.filter(F.exists("vec", lambda x: x != 0)).write.parquet(path + "/rows")
    rows = spark.read.parquet(path + "/rows")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    bits = min(MOST_PLANES, max(1, int(np.ceil(np.log2(max(n, 2) / bucket)))))
    shared = spark.sparkContext.broadcast(planes(tables, dim or 1, bits))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("paper_id", "age")}
    schema = f"place long, paper_id {kinds['paper_id']}, age {kinds['age']}, vec array<float>"

    def placed(each: int):
        """(place, paper_id, age, vec): a row for every bucket a vector lies in or visits; a place is a table and bucket."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(_matrix(batch.column("vec"), dim))
                found = [(t << MOST_PLANES) + buckets(unit, table, each) for t, table in enumerate(shared.value)]
                at = np.concatenate(found, axis=1)
                row = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.ravel()), *(batch.column(c).take(row) for c in ("paper_id", "age", "vec"))], ["place", "paper_id", "age", "vec"]
                )

        return place

    copies = W.partitionBy("vec").orderBy("age", "paper_id")
    alone = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k).select("paper_id", "age", "vec")
    alone.mapInArrow(placed(1), schema).write.parquet(path + "/members")
    rows.filter("query").select("paper_id", "age", "vec").mapInArrow(placed(probes), schema).write.parquet(path + "/visits")
    members, visits = (spark.read.parquet(f"{path}/{side}") for side in ("members", "visits"))

    # blocks of each side of a bucket; one row for each bucket, whose size Spark knows from the files
    blocks = lambda: F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    loads = members.groupBy("place").agg(blocks().alias("m_blocks")).join(visits.groupBy("place").agg(blocks().alias("q_blocks")), "place")
    loads.write.parquet(path + "/loads")
    loads = spark.read.parquet(path + "/loads")

    def laid_out(side: DataFrame, own: str, other: str) -> DataFrame:
        dealt = F.pmod(F.xxhash64("paper_id"), F.col(f"{own}_blocks")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        laid = side.join(loads, "place").select("place", dealt, every, "paper_id", "age", "vec")
        return laid.select("place", "q", "m", *[F.col(c).alias(f"{own}_{c}") for c in ("paper_id", "age", "vec")])

    queries = laid_out(visits, "q", "m")
    candidates = laid_out(members, "m", "q").select(F.col("place").alias("at"), F.col("q").alias("q_at"), F.col("m").alias("m_at"), "m_paper_id", "m_age", "m_vec")

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values(["m_age", "m_paper_id"])
        near = _unit(np.stack(q["q_vec"])) @ _unit(np.stack(m["m_vec"])).T if len(q) and len(m) else np.zeros((len(q), len(m)))
        near[m["m_age"].to_numpy()[None, :] >= q["q_age"].to_numpy()[:, None]] = -np.inf
        best = np.argsort(-np.round(near, 12), axis=1, kind="stable")[:, :k]  # equal vectors tie
        value = np.take_along_axis(near, best, axis=1).ravel()
        asker, best = np.repeat(np.arange(len(q)), best.shape[1])[value > -np.inf], best.ravel()[value > -np.inf]
        return pd.DataFrame(
            {"paper_id": q["q_paper_id"].to_numpy()[asker], "neighbour": m["m_paper_id"].to_numpy()[best],
             "neighbour_age": m["m_age"].to_numpy()[best], "similarity": value[value > -np.inf]}
        )

    met = (
        queries.groupBy("place", "q", "m")
        .cogroup(candidates.groupBy("at", "q_at", "m_at"))
        .applyInPandas(compare, f"paper_id {kinds['paper_id']}, neighbour {kinds['paper_id']}, neighbour_age {kinds['age']}, similarity double")
    )
    # a pair is met once for each bucket that both share
    pairs = met.groupBy("paper_id", "neighbour", "neighbour_age").agg(F.max("similarity").alias("similarity"))
    order = W.partitionBy("paper_id").orderBy(F.desc(F.round("similarity", 12)), "neighbour_age", "neighbour")
    return pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).select("paper_id", "neighbour", "similarity", "position")


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, recall): the share of the exact neighbours that were found."""
    both = exact.select("paper_id", "neighbour").join(
        found.select("paper_id", "neighbour", F.lit(1).alias("hit")), ["paper_id", "neighbour"], "left"
    )
    return both.agg(
        F.count_distinct("paper_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") / F.count(F.lit(1))).alias("recall")
    )
