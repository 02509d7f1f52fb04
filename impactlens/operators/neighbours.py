"""Exact nearest older papers by embedding, and statistics over them.

Papers are grouped around pivots, the oldest papers, which are neighbours open to all younger ones:
a paper's k-th nearest pivot bounds how far its k-th neighbour can be. By the triangle inequality
most groups lie beyond that bound and are never compared. What is left is compared in tasks of two
blocks of bounded size, each of which hands on only k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from impactlens.functions import columns as C
from impactlens.operators.ordering import ordered_counts
from impactlens.operators.skew import spread_join, spread_join_on
from impactlens.storage import durable

PIVOTS = 256
BLOCK = 4096
# Papers on either side of a task, and queries it compares at once.
TASK = 65_536
ASKED = 1024
# For rounding, where a cell is left out.
SLACK = 1e-9


def nearest_older(
    vectors: DataFrame, k: int = 5, age: str = "paper_id", pivots: int = PIVOTS, block: int = BLOCK
) -> DataFrame:
    """(paper_id, neighbour, similarity, position): the k papers with smaller `age` and highest
    cosine similarity, equal similarities by neighbour id. Papers with fewer than k older ones get
    them all. `vectors` is (paper_id, embedding, age). A boolean column `candidate`, if there is
    one, says who may be a neighbour, a column `query` for whom neighbours are wanted. A vector of zeros has no direction: it neither has nor is one.
    """
    candidate = F.col("candidate") if "candidate" in vectors.columns else F.lit(True)
    asked = F.col("query") if "query" in vectors.columns else F.lit(True)
    rows = durable(
        vectors.select("paper_id", F.col(age).alias("age"), "embedding", candidate.alias("candidate"), asked.alias("query")).filter(
            F.exists("embedding", lambda x: x != 0)
        )
    )
    spark = rows.sparkSession
    # about one pivot per block of papers, at most `pivots`
    n_rows = rows.count()
    n_pivots = max(k, min(pivots, n_rows // block))
    oldest = rows.filter("candidate").orderBy("age", "paper_id").limit(n_pivots).collect()
    if not oldest:
        kind = rows.schema["paper_id"].dataType.simpleString()
        return spark.createDataFrame([], f"paper_id {kind}, neighbour {kind}, similarity DOUBLE, position INT")
    centres = spark.sparkContext.broadcast((_unit([r["embedding"] for r in oldest]), np.array([r["age"] for r in oldest])))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, ages = centres.value
        for f in frames:
            d = _distance(_unit(f["embedding"]), points)
            older = np.where(ages[None, :] < f["age"].to_numpy()[:, None], d, np.inf)
            kth = np.partition(older, k - 1, axis=1)[:, k - 1] if older.shape[1] >= k else np.full(len(f), np.inf)
            cell = d.argmin(axis=1)
            yield f[["paper_id", "age", "candidate", "query"]].assign(
                cell=cell.astype("int32"), radius=d[np.arange(len(f)), cell], reach=kth,
                vec=f["embedding"].map(lambda e: (np.asarray(e, dtype=np.float64) + 0.0).tobytes()),
            )

    id_type = rows.schema["paper_id"].dataType.simpleString()
    age_type = rows.schema["age"].dataType.simpleString()
    placed = durable(
        rows.mapInPandas(
            place, f"paper_id {id_type}, age {age_type}, candidate BOOLEAN, query BOOLEAN, cell INT, radius DOUBLE, reach DOUBLE, vec BINARY"
        )
    )
    # Of equal vectors only the k first by id can be among anyone's k nearest (ties go to the smaller
    # age, then id), so a mass of copies shrinks to k candidates. The limit applies before the shuffle.
    copies = W.partitionBy("vec").orderBy("age", "paper_id")
    members = durable(
        placed.filter("candidate").select("paper_id", "age", "cell", "radius", "vec")
        .withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k).drop("_copy")
    )
    # one row per pivot
    known = members.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("inner"), F.max("radius").alias("outer"), F.min("age").alias("first")
    ).orderBy("cell").collect()
    load = {r["cell"]: r["count"] for r in placed.filter("query").groupBy("cell").count().collect()}
    # a task compares two blocks: large ones are copied seldom, but a small table still fills the cores
    per_side = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    size = min(TASK, max(block // 4, 1, -(-n_rows // per_side)))
    q_blocks, m_blocks = _packed(load, size), _packed({r["cell"]: r["n"] for r in known}, size)

    def numbered(df: DataFrame, name: str, blocks: dict[int, tuple[int, int]]) -> DataFrame:
        first, parts = (F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b[i])])[F.col("cell")] for i in (0, 1))
        return df.withColumn(name, first + F.pmod(F.hash("paper_id"), parts))

    asking = numbered(placed.filter("query").select("paper_id", "age", "cell", "reach", "vec"), "_q", q_blocks or {0: (0, 1)})

    def visited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks with a member that may be within reach and older."""
        points = centres.value[0][[r["cell"] for r in known]]
        inner, outer = (np.array([r[c] for r in known]) for c in ("inner", "outer"))
        first = np.array([r["first"] for r in known])
        for f in frames:
            d, reach = _distance(_unit(_stacked(f["vec"])), points), f["reach"].to_numpy()[:, None] + SLACK
            near = (first[None, :] < f["age"].to_numpy()[:, None]) & (d - outer <= reach) & (inner - d <= reach)
            for q in f["_q"].unique():
                cells = np.flatnonzero(near[(f["_q"] == q).to_numpy()].any(axis=0))
                blocks = {b for c in cells for b in range(m_blocks[known[c]["cell"]][0], sum(m_blocks[known[c]["cell"]]))}
                yield pd.DataFrame({"_q": q, "_m": sorted(blocks)}).astype("int32")

    # two numbers for each pair of blocks, of which there are few: a thousand blocks hold 65 million papers
    pairs = F.broadcast(durable(asking.select("vec", "age", "reach", "_q").mapInPandas(visited, "_q INT, _m INT").distinct()))
    queries = asking.join(pairs, "_q")
    candidates = numbered(members, "_m", m_blocks).join(pairs, "_m")
    # both sides stem from the same rows: fresh names keep their columns apart in the cogroup
    candidates = candidates.select(*[F.col(c).alias(f"m_{c}") for c in ("paper_id", "age", "vec", "cell", "radius", "_q", "_m")])

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame(columns=["paper_id", "neighbour", "neighbour_age", "similarity"])
        m = m.sort_values(["m_age", "m_paper_id"], ignore_index=True)
        q = q.sort_values(["cell", "age"], ignore_index=True)
        at, similarity = _nearest(q, m, centres.value[0], k, block)
        i, j = np.nonzero(similarity > -np.inf)
        at = at[i, j]
        return pd.DataFrame(
            {"paper_id": q["paper_id"].to_numpy()[i], "neighbour": m["m_paper_id"].to_numpy()[at],
             "neighbour_age": m["m_age"].to_numpy()[at], "similarity": similarity[i, j]}
        )

    keys = ["_q", "_m"]
    near = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*[f"m_{c}" for c in keys]))
        .applyInPandas(compare, f"paper_id {id_type}, neighbour {id_type}, neighbour_age {age_type}, similarity DOUBLE")
    )
    order = W.partitionBy("paper_id").orderBy(F.desc(F.round("similarity", 12)), "neighbour_age", "neighbour")
    return (
        near.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("paper_id", "neighbour", "similarity", "position")
    )


def _packed(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """cell -> (first block, blocks): small cells share a block of about `size`, a larger one has several of its own."""
    out, at, held = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > size:
            at, held = at + 1, 0
        parts = -(-n // size)
        out[cell] = at, parts
        at, held = (at, held + n) if parts == 1 else (at + parts, 0)
    return out


def _nearest(q: pd.DataFrame, m: pd.DataFrame, points: np.ndarray, k: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `m`, ordered by age and id, of each query's k nearest older members, and their similarities (-inf: none).

    Cells are visited nearest first, by the queries they may still hold a better member for.
    """
    mine, theirs = _unit(_stacked(q["vec"])), _unit(_stacked(m["m_vec"]))
    older = np.searchsorted(m["m_age"].to_numpy(), q["age"].to_numpy())  # so many members are older
    places = [np.flatnonzero(m["m_cell"] == c) for c in m["m_cell"].unique()]
    radius, points = m["m_radius"].to_numpy(), points[m["m_cell"].unique()]
    best, at = np.full((len(q), k), -np.inf), np.full((len(q), k), len(m))
    exact, reaches = best.copy(), q["reach"].to_numpy()
    for low in range(0, len(q), ASKED):
        asked = np.arange(low, min(low + ASKED, len(q)))
        d = _distance(mine[asked], points)
        for c in d.min(axis=0).argsort():
            held = places[c]
            worst = np.sqrt(np.maximum(2 - 2 * best[asked, -1] + 4e-12, 0.0))
            reach = np.minimum(reaches[asked], worst) + SLACK
            near = asked[(d[:, c] - radius[held].max() <= reach) & (radius[held].min() - d[:, c] <= reach)]
            for start in range(0, len(held), block):
                near = near[older[near] > held[start]]
                if not len(near):
                    break
                some = held[start : start + block]
                some = some[: np.searchsorted(some, older[near].max())]
                s = mine[near] @ theirs[some].T
                floor = best[near, -1] - 2e-12
                found = s >= floor[:, None]
                if np.count_nonzero(found) > 8 * k * len(near) and s.shape[1] > k:
                    s[some[None, :] >= older[near][:, None]] = -np.inf
                    floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k] - 2e-12)
                    found = s >= floor[:, None]
                i, j = np.nonzero(found)
                ours = (some[j] < older[near[i]]) & (s[i, j] > -np.inf)
                i, j = i[ours], j[ours]
                if not len(i):
                    continue
                rows = np.unique(i)
                old = near[rows]
                who = np.r_[i, np.repeat(rows, k)]
                what, place = np.r_[s[i, j], exact[old].ravel()], np.r_[some[j], at[old].ravel()]
                level = np.round(what, 12)  # equal vectors tie
                order = np.lexsort((place, -level, who))
                first = np.searchsorted(who[order], rows)
                order = order[(first[:, None] + np.arange(k)).ravel()]
                best[old], exact[old], at[old] = (x[order].reshape(-1, k) for x in (level, what, place))
    return at, exact


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def neighbour_statistics(
    neighbours: DataFrame, papers: DataFrame, cites: str = "cites", tau_days: float = 365.0
) -> DataFrame:
    """(paper_id, n, weighted_mean, max, median, variance) of the neighbours' citations, recent
    neighbours weighing more: exp(-days between the papers / tau)."""
    own = papers.select("paper_id", F.col("published").alias("_at"))
    theirs = papers.filter(F.col(cites).isNotNull()).select(F.col("paper_id").alias("neighbour"), F.col("published").alias("_then"), F.col(cites).alias("_c"))
    days = F.datediff("_at", "_then")
    weight = F.exp(-F.greatest(days, F.lit(0)) / F.lit(tau_days))
    # the join counts its left side before it reads it; a paper has at most k neighbours, so an exact median per paper is small
    asked = durable(neighbours.select("paper_id", "neighbour").join(own, "paper_id"))
    return (
        spread_join(asked, theirs, "neighbour")
        .withColumn("_w", weight)
        .groupBy("paper_id")
        .agg(
            F.count(F.lit(1)).alias("n_neighbours"),
            (F.sum(F.col("_w") * F.col("_c")) / F.sum("_w")).alias("weighted_mean"),
            F.max("_c").alias("max_cites"),
            F.median("_c").alias("median_cites"),
            F.var_pop("_c").alias("var_cites"),
        )
    )


def neighbour_growth(neighbours: DataFrame, yearly: DataFrame) -> DataFrame:
    """(paper_id, growth_slope): slope over years of the citations the neighbours got per year."""
    theirs = yearly.select(F.col("paper_id").alias("neighbour"), "year", "cited_by_count")
    per_year = (
        spread_join(durable(neighbours.select("paper_id", "neighbour")), theirs, "neighbour")
        .groupBy("paper_id", "year").agg(F.sum("cited_by_count").cast("double").alias("c"))
    )
    slope = F.covar_pop(F.col("year").cast("double"), F.col("c")) / F.nullif(F.var_pop("year"), F.lit(0.0))
    return per_year.groupBy("paper_id").agg(slope.alias("growth_slope"))


def impact_proximity(papers: DataFrame, top_share: float = 0.1) -> DataFrame:
    """(paper_id, mean_similarity, max_similarity) to the most cited papers of earlier years in the
    same field: the top share of each field and year by `cites`.

    `papers` is (paper_id, primary_cat, pub_year, cites, embedding). The mean cosine to a set is the
    product with the set's mean unit vector, so it needs sums only. For the maximum the field joins
    the vector as extra axes, as many as its number has bits, long enough that another field's paper
    is never nearer.
    """
    unit = F.transform("embedding", lambda x: x.cast("double") / F.nullif(C.norm(F.col("embedding")), F.lit(0.0)))
    rows = durable(papers.dropna(subset=["primary_cat", "pub_year"]).withColumn("_unit", unit))
    counts = ordered_counts(rows, "cites", ("primary_cat", "pub_year"))
    sizes = durable(counts.groupBy("primary_cat", "pub_year").agg(F.first("total").alias("cnt")))
    leading = counts.filter((F.col("total") - F.col("before") - F.col("cnt")) < F.col("total") * top_share)
    bar = leading.groupBy("primary_cat", "pub_year").agg(F.min("cites").alias("_bar"))
    marked = durable(
        spread_join_on(rows, bar, ["primary_cat", "pub_year"], "left", sizes).withColumn("candidate", F.coalesce(F.col("cites") >= F.col("_bar"), F.lit(False)))
    )
    # one row per field, year and dimension
    sums = (
        marked.filter("candidate").select("primary_cat", "pub_year", F.posexplode("_unit").alias("i", "x"))
        .groupBy("primary_cat", "pub_year", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("m"))
    )
    earlier = W.partitionBy("primary_cat", "i").orderBy("pub_year").rangeBetween(W.unboundedPreceding, -1)
    years = marked.select("primary_cat", "pub_year").distinct()
    axes = sums.select("primary_cat", "i").distinct()
    history = (
        years.join(axes, "primary_cat").join(sums, ["primary_cat", "pub_year", "i"], "left")
        .select("primary_cat", "pub_year", "i", F.sum("s").over(earlier).alias("s"), F.sum("m").over(earlier).alias("m"))
        .filter("m IS NOT NULL")
        .groupBy("primary_cat", "pub_year")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.expr("s / m")))), lambda t: t["col2"]).alias("_mean"))
    )
    means = spread_join_on(marked, history, ["primary_cat", "pub_year"], counts=sizes).select(
        "paper_id", C.dot(F.col("_unit"), F.col("_mean")).alias("mean_similarity")
    )
    # the number of a field in their order, in binary: two fields differ in one axis at least, however many there are
    numbers = ordered_counts(marked.select("primary_cat").distinct(), "primary_cat").select("primary_cat", F.col("before").alias("_field"), "total")
    numbers = durable(numbers)
    n_axes = max(1, ((numbers.agg(F.max("total")).first()[0] or 1) - 1).bit_length())
    far = 2.0
    axis = F.array(*[F.when(F.getbit("_field", F.lit(i)) == 1, far).otherwise(-far) for i in range(n_axes)])
    placed = spread_join(marked, numbers.drop("total"), "primary_cat").select(
        "paper_id", "pub_year", "candidate", F.concat("_unit", axis).alias("embedding")
    )
    field = marked.select("paper_id", "primary_cat")
    nearest = nearest_older(placed, 1, "pub_year").select("paper_id", "neighbour", "similarity")
    best = (
        nearest.join(field, "paper_id")
        .join(field.select(F.col("paper_id").alias("neighbour"), F.col("primary_cat").alias("_theirs")), "neighbour")
        .filter(F.col("primary_cat") == F.col("_theirs"))
        .select("paper_id", (F.col("similarity") * (1 + n_axes * far * far) - n_axes * far * far).alias("max_similarity"))
    )
    return means.join(best, "paper_id")
