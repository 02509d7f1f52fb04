"""Source divergence audit: how far each source's use of words is from its language's and from every other source's.

A kept term is a row of its counts by source. The distance of two sources is a sum over all kept terms, most of
which most sources do not have, so what absent terms give is taken for all pairs at once, and only terms that
both sources have need a correction. For these the rows are inserted into a frequent-pattern tree, their nonzero
counts in the order of the sources, equal rows once with their multiplicity: a path that rows share is one
path, and each of its nodes corrects the pairs with its ancestors once for all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from impactlens.llm.columns import shuffle_partitions, text_of
from impactlens.operators.skew import spread_join_on
from impactlens.storage import new_path

# What becomes of each byte of a text: A-Z lower-case, other ASCII but letters blank. All of a character beyond
# ASCII belongs to a term, so terms are cut without decoding.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Bytes cut into terms at once, and distinct terms a task holds before it hands their counts on.
AT_ONCE = 1 << 22
HELD = 300_000
# Corrections a task holds before it hands them on.
CELLS = 4_000_000


def cut_terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at once."""
    data = data.translate(BYTES)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + AT_ONCE)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, cnt, docs): occurrences and documents of each term; the empty term counts the documents.

    Texts are counted where they lie, so only totals of distinct terms are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                cnt, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(cnt)
                own = {b""}
                cnt[b""] += 1
                for terms in cut_terms(text.as_py()):
                    cnt.update(terms)
                    own.update(terms)
                docs.update(own)
                size += len(cnt) - before
                if size >= HELD:
                    yield from handed_on(held)
                    size = 0
        yield from handed_on(held)

    def handed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (cnt, docs) in held.items():
            terms = list(cnt)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(cnt.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "cnt", "docs"],
            )
        held.clear()

    given = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("text"))
    counted = given.mapInArrow(count, "lang string, source string, term string, cnt long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def share(cnt: Column, total: Column, kept: Column, scale: int, smoothing: int) -> Column:
    """1 + floor(scale * (cnt + smoothing) / (total + smoothing * kept)) in whole numbers; null without kept terms."""
    exact = "decimal(20,0)"
    above = F.lit(scale).cast(exact) * (cnt + smoothing).cast(exact)
    below = F.nullif((total + smoothing * kept).cast(exact), F.lit(0).cast(exact))
    return F.call_function("div", above, below) + 1


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, gain): for sources at places a < b the sum over the rows that have both of
    max(0, min(p_a, p_b) - max(z_a, z_b)).

    `rows` is (lang, row, n): n terms have `row`, an array of (place, cnt, p, z) by place, where p is the
    share of the count and z that of no occurrence. The rows are dealt to ranges of their order, and a task
    walks its part of the tree in that order with the present path alone in memory.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, cells = None, 0
        path = np.zeros((0, 4), np.int64)  # place, cnt, p, z of the nodes from the root on
        passed: list[int] = []  # terms through each node, as far as counted
        gains: dict[int, np.ndarray] = {}

        def leave(depth: int) -> None:
            """Count the nodes below this depth: all their terms have been seen."""
            nonlocal cells
            for at in range(len(passed) - 1, depth - 1, -1):
                n = passed.pop()
                if at:
                    passed[at - 1] += n
                    place, _, p, z = path[at]
                    above = path[:at]
                    if place not in gains:
                        gains[place] = np.zeros(place, np.int64)
                        cells += place
                    gains[place][above[:, 0]] += n * np.maximum(0, np.minimum(p, above[:, 2]) - np.maximum(z, above[:, 3]))

        def handed_on() -> Iterator[pa.RecordBatch]:
            nonlocal cells
            for b, row in gains.items():
                a = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(np.full(len(a), b)), pa.array(row[a])], ["lang", "a", "b", "gain"]
                )
            gains.clear()
            cells = 0

        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            items = np.stack([lists.values.field(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            for i, (own, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                row = items[ends[i] : ends[i + 1]]
                shared = 0
                if own == lang:
                    most = min(len(row), len(path))
                    same = (row[:most, :2] == path[:most, :2]).all(axis=1)
                    shared = most if same.all() else int(same.argmin())
                leave(shared)
                if own != lang or cells > CELLS:
                    yield from handed_on()
                    lang = own
                path = row.copy()
                passed.extend([0] * (len(row) - shared))
                if len(row):
                    passed[-1] += n
        leave(0)
        yield from handed_on()

    ordered = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "lang", "row").sortWithinPartitions("lang", "row")
    found = ordered.select("lang", "row", "n").mapInArrow(walk, "lang string, a long, b long, gain long")
    return found.groupBy("lang", "a", "b").agg(F.sum("gain").alias("gain"))


def audit_sources(
    docs: DataFrame,
    least_documents: int = 30,
    smoothing: int = 5,
    scale: int = 1_000_000_000,
    top: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language that occurs; null counts as ''.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those
    in at least `least_documents` of its documents. A source has each kept term with the share
    1 + floor(scale * (count + smoothing) / (all its counts + smoothing * kept terms)), a language likewise.
    Part `pair` ranks all other sources of the language by the sum of the differences of shares, 0 without
    kept terms; part `term` the `top` terms that the source has and the language has less of, by the
    difference; ties by item in UTF-8. Repeated rows count again, an empty table gives no rows.

    Steps go to the shared folder, so a lost executor costs only its running tasks. A kept term's row, one
    entry for each source that has it, is the largest value a task holds whole.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "divergence")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    per_term = W.partitionBy("lang", "term")
    counted = count_terms(docs, text_col, lang_col, source_col).withColumns(
        {
            "in_docs": F.sum("docs").over(per_term),
            "lang_cnt": F.sum("cnt").over(per_term),
            "head": F.row_number().over(per_term.orderBy("source")) == 1,
        }
    )
    counted = kept(counted.filter((F.col("term") == "") | (F.col("in_docs") >= least_documents)).drop("docs", "in_docs"), "counted")
    real = F.col("term") != ""
    number = lambda value: F.coalesce(F.sum(F.when(real, value)), F.lit(0).cast("long"))
    lang = W.partitionBy("lang")
    groups = (
        counted.groupBy("lang", "source")
        .agg(number(F.col("cnt")).alias("total"), number(F.lit(1)).alias("cnt"), number(F.col("head").cast("long")).alias("heads"))
        .withColumns({"kept": F.sum("heads").over(lang), "lang_total": F.sum("total").over(lang), "place": F.row_number().over(lang.orderBy("source")) - 1})
        .withColumn("z", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept"), scale, smoothing), F.lit(0).cast("long")))
        .drop("heads")
    )
    groups = kept(groups, "groups")
    valued = spread_join_on(counted.filter(real), groups.drop("cnt"), ["lang", "source"], counts=groups.filter("cnt > 0"))
    own = share(F.col("cnt"), F.col("total"), F.col("kept"), scale, smoothing)
    whole = share(F.col("lang_cnt"), F.col("lang_total"), F.col("kept"), scale, smoothing)
    valued = kept(valued.select("lang", "source", "place", "term", "cnt", "z", own.alias("p"), whole.alias("q")), "valued")

    result = ("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select(*result).withColumn("rank", F.row_number().over(order))
    terms = valued.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = _distances(groups, valued).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return ranked(terms).filter(F.col("rank") <= top).unionByName(ranked(pairs))


def _distances(groups: DataFrame, valued: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of every source from every other one of its language.

    |x - y| = x + y - 2 min(x, y), so what is needed is the sum over terms of the smaller share. Were no term in
    both sources, that would be the smaller share of an absent term for all terms, plus, for the source with
    the smaller one, what its own terms have above it, up to the other's; the tree adds what terms in both have.
    """
    rows = valued.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("long"), "cnt", "p", "z"))).alias("row"))
    rows = rows.filter(F.size("row") > 1).groupBy("lang", "row").agg(F.count(F.lit(1)).alias("n"))
    gains = tree_corrections(rows)

    sums = valued.groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"))
    none = F.lit(0).cast("long")
    sides = groups.join(sums, ["lang", "place"], "left").select(
        "lang", "source", "place", "z", "kept", F.coalesce("n", none).alias("n"), F.coalesce("p_sum", none).alias("p_sum")
    )
    # both sides are one row for each source; the slots deal the pairs of one language, which are the result, to many tasks
    slots = shuffle_partitions(groups.sparkSession)
    side = lambda name: F.struct("source", "place", "z", "n", "p_sum").alias(name)
    left = sides.select("lang", "kept", F.pmod("place", F.lit(slots)).alias("slot"), side("x"))
    right = sides.select("lang", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), side("y"))
    pairs = left.join(right, ["lang", "slot"]).filter(F.col("x.place") < F.col("y.place"))
    swapped = F.col("x.z") > F.col("y.z")
    pairs = pairs.select("lang", "kept", "x", "y", F.when(swapped, F.col("y")).otherwise(F.col("x")).alias("low"), F.greatest("x.z", "y.z").alias("bar"))

    # the terms of `low` with a share up to the bar, by a running sum over its shares and its bars
    shares = valued.groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("n")).select("lang", "place", F.col("p").alias("at"), "n", F.lit(None).alias("pair"))
    asked = pairs.select("lang", F.col("low.place").alias("place"), F.col("bar").alias("at"), none.alias("n"), F.struct("kept", "x", "y", "low").alias("pair"))
    upto = W.partitionBy("lang", "place").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    found = (
        shares.unionByName(asked)
        .withColumns({"n_up": F.sum("n").over(upto), "p_up": F.sum(F.col("n") * F.col("at")).over(upto)})
        .filter("pair IS NOT NULL")
        .select("lang", "pair.*", F.col("at").alias("bar"), "n_up", "p_up")
    )
    above = F.col("p_up") + F.col("bar") * (F.col("low.n") - F.col("n_up")) - F.col("low.n") * F.col("low.z")
    whole = lambda s: F.col(f"{s}.p_sum") + (F.col("kept") - F.col(f"{s}.n")) * F.col(f"{s}.z")
    found = found.join(
        gains.select("lang", F.col("a").alias("x_place"), F.col("b").alias("y_place"), "gain"),
        (found["lang"] == gains["lang"]) & (F.col("x.place") == F.col("x_place")) & (F.col("y.place") == F.col("y_place")),
        "left",
    ).select(found["lang"], "x", "y", (whole("x") + whole("y") - 2 * (F.col("kept") * F.col("low.z") + above + F.coalesce("gain", none))).alias("value"))
    both = F.array(F.struct(F.col("x.source").alias("source"), F.col("y.source").alias("item")), F.struct(F.col("y.source").alias("source"), F.col("x.source").alias("item")))
    return found.select("lang", "value", F.explode(both).alias("s")).select("lang", "s.source", "s.item", "value")
