"""Co-authorship: who wrote with whom, how often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from impactlens.operators.skew import ROWS_PER_TASK, count_keys, spread_join
from impactlens.storage import dropped, durable, stored

# Papers above this many authors are paired block by block, so that one task never holds
# more than two blocks of a paper.
BLOCK = 512


def authorship(papers: DataFrame) -> DataFrame:
    """Papers with an authors array to distinct (paper_id, author, published) rows."""
    return papers.select("paper_id", "published", F.explode(F.array_distinct("authors")).alias("author")).filter(
        F.col("author").isNotNull()
    )


def before_cutoff(cutoff: str | None) -> Column:
    """Published, and no later than the cutoff (inclusive) if there is one."""
    known = F.col("published").isNotNull()
    return known if cutoff is None else known & (F.col("published") <= F.lit(cutoff).cast("timestamp_ntz"))


def graph_papers(papers: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Papers that enter the graph: dated, not after the cutoff, two or more different authors."""
    return papers.filter(before_cutoff(cutoff) & (F.size(F.array_distinct("authors")) >= 2))


def incidence(authors: DataFrame, cutoff: str | None = None) -> DataFrame:
    """(paper_id, author, n_authors) of the papers that enter the graph, from distinct authorship rows.

    Linear in the input, and all that centrality needs: a paper's co-author pairs are never
    written out for it.
    """
    rows = authors.filter(before_cutoff(cutoff)).select("paper_id", "author")
    sizes = durable(count_keys(rows, "paper_id").filter("cnt >= 2"))
    numbered = sizes.select("paper_id", F.col("cnt").cast("int").alias("n_authors"))
    return spread_join(rows, numbered, "paper_id", counts=sizes)


def block_cells(rows: DataFrame, key: str, item: str, size: str, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, item, carry..., _block, _lo, _hi): every item in each pair of blocks of its key that it belongs to.

    `size` names the column with the number of items of the key. Items of a large key are hashed
    into blocks; ordinary keys are one block.
    """
    return (
        rows.withColumn("_blocks", F.ceil(F.col(size) / block).cast("int"))
        .withColumn("_block", F.when(F.col("_blocks") == 1, 0).otherwise(F.pmod(F.hash(item), F.col("_blocks"))))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(key, item, *carry, "_block", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"))
    )


def block_pairs(rows: DataFrame, key: str, item: str, size: str, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, u, v, u_<column>, v_<column>) with u < v for every two items of a key.

    Each pair of blocks of a large key is a join key of its own, so the pairs of one key are made
    by many tasks.
    """
    cells = block_cells(rows, key, item, size, block, carry)
    a, b = cells.alias("a"), cells.alias("b")
    same_cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "_lo", "_hi")]
    once = (F.col("a._lo") == F.col("a._hi")) | (F.col("a._block") != F.col("b._block"))
    return a.join(b, [*same_cell, F.col(f"a.{item}") < F.col(f"b.{item}"), once]).select(
        F.col(f"a.{key}").alias(key), F.col(f"a.{item}").alias("u"), F.col(f"b.{item}").alias("v"),
        *[F.col(f"{side}.{c}").alias(f"{end}_{c}") for c in carry for side, end in (("a", "u"), ("b", "v"))],
    )


def author_pairs(inc: DataFrame, block: int = BLOCK) -> DataFrame:
    """(paper_id, u, v) with u < v for every two authors of a paper."""
    return block_pairs(inc, "paper_id", "author", "n_authors", block)


def coauthor_edges(inc: DataFrame, block: int = BLOCK, pairs_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(u, v, weight): weight is the number of papers the two share.

    Papers are dealt to tasks that make about `pairs_per_task` pairs each, at any size of the table, and count
    them there; what is left of a pair is added up by as many tasks.
    """
    known = F.col("paper_id").isNotNull() & F.col("author").isNotNull()  # nulls meet nothing
    inc = stored(inc.select("paper_id", "author", "n_authors").filter(known), "incidence")
    parallel = int(inc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = inc.agg(F.sum(F.col("n_authors") - 1)).first()[0] or 0
    tasks = max(parallel, made // (2 * pairs_per_task) + 1)
    cells = block_cells(inc, "paper_id", "author", "n_authors", block)
    dealt = cells.withColumn("_task", F.pmod(F.hash("paper_id", "_lo", "_hi"), F.lit(tasks))).repartitionById(tasks, "_task")
    # the task's number is the first key throughout, so nothing is shuffled until its pairs are counted
    side = lambda inside: F.collect_list(F.when(inside, F.col("author")))
    first = F.col("_block") == F.col("_lo")
    met = dealt.groupBy("_task", "paper_id", "_lo", "_hi").agg(side(first).alias("_near"), side(~first).alias("_far"))
    same = F.col("_lo") == F.col("_hi")
    behind = F.when(same, F.slice("_near", F.col("_place") + 2, F.greatest(F.size("_near"), F.lit(1)))).otherwise(F.col("_far"))
    ends = met.select("*", F.posexplode("_near").alias("_place", "_a")).select("_task", "_a", F.explode(behind).alias("_b"))
    pairs = ends.select("_task", F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).filter("u < v")
    counted = pairs.groupBy("_task", "u", "v").agg(F.count(F.lit(1)).alias("weight"))
    return counted.repartition(tasks, "u", "v").groupBy("u", "v").agg(F.sum("weight").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("author")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (author, neighbour, weight)."""
    ends = F.explode(
        F.array(
            F.struct(F.col("u").alias("author"), F.col("v").alias("neighbour")),
            F.struct(F.col("v").alias("author"), F.col("u").alias("neighbour")),
        )
    )
    return edges.select(ends.alias("_e"), "weight").select("_e.author", "_e.neighbour", "weight")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(author, n_coauthors, degree) with degree = co-authors / (nodes - 1)."""
    counts = edges.select(F.explode(F.array("u", "v")).alias("author")).groupBy("author").agg(
        F.count(F.lit(1)).alias("n_coauthors")
    )
    others = counts.agg((F.count(F.lit(1)) - 1).alias("n")).scalar()
    return counts.withColumn("degree", F.col("n_coauthors").cast("double") / others)


def numbered_authors(edges: DataFrame) -> DataFrame:
    """(author, d, id): co-authors of each author and its place by (d, author), as a short whole number.

    Numbers have gaps but keep the order; they are ints unless more than 2^31 are needed.
    """
    counts = edges.select(F.explode(F.array("u", "v")).alias("author")).groupBy("author").agg(F.count(F.lit(1)).alias("d"))
    degrees = stored(counts, "degrees")
    ordered = stored(degrees.orderBy("d", "author").withColumn("_at", F.monotonically_increasing_id()), "numbers")
    dropped(degrees)
    # the upper bits are the partition's number, the lower 33 the place in it
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts, longest = ordered.agg(F.max(part) + 1, F.max(place) + 1).first()
    kind = "int" if (parts or 0) * (longest or 0) < 1 << 31 else "long"
    return ordered.select("author", "d", (part * F.lit(longest or 1) + place).cast(kind).alias("id"))


def numbered_edges(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """(u, v, weight): both ends as numbers of `numbered_authors`, kept as a table.

    One end is numbered after the other, so that the disk holds the shuffle of one join.
    """
    counts = authors.select("author", F.col("d").alias("cnt"))  # an author has at most d rows as u or as v
    half = None
    for end in ("u", "v"):
        number = authors.select(F.col("author").alias(end), F.col("id").alias("_id"))
        met = spread_join(edges if half is None else half, number, end, counts=counts.withColumnRenamed("author", end))
        done = stored(met.drop(end).withColumnRenamed("_id", end).select("u", "v", "weight"), "edges")
        if half is not None:
            dropped(half)
        half = done
    return done
