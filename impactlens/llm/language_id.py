"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes, counted on labelled texts. A byte is
coded in its longest context, or after an escape in the next shorter one, down to a uniform code; the
statistics stay as they were learned, so the length of a text's code is a sum of table entries. The
language with the shortest code is predicted. All languages share one tree of byte strings; a node
holds a cost for every language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from impactlens.llm.columns import text_of, unused

UNDECIDED = "und"
# Bytes scored at once; a longer text is gone through in slices, each behind the bytes of its context.
AT_ONCE = 1 << 18
# Texts lower-cased and encoded at once.
TEXTS = 200
# Steps of the costs that bounds are chosen among, for each bit a byte.
STEPS = 1000
# Of so many labelled texts one may be in another language than its label says.
STRANGE = 400
# Languages with no more labelled texts have them dealt to the halves in turn.
FEW = 300
# Byte strings counted at once, and distinct ones a task holds of a language and half.
COUNTED = 1 << 21
# Ends a text where several are counted at once: no text has this byte.
END = 255
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    found = LETTER.search(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def words_alone(text: str) -> bytes:
    """Lower-case letters, and a blank for whatever is between them: numbers, addresses and signs are in no language."""
    return NO_LETTERS.sub(" ", text.lower()).encode()


class Model:
    """Costs in bits of byte strings of up to order + 1 bytes, the last byte coded in the context of the others.

    Level n has the strings of n bytes seen in any language, in the order of their node numbers, which
    begin at 1; node 0 is every unseen string.
    """

    def __init__(self, languages: list[str], order: int, grams: list[np.ndarray], counts: list[np.ndarray]):
        """grams[n - 1]: the sorted distinct strings of n bytes as big-endian numbers, counts: (string, language)."""
        self.languages, self.order = languages, order
        self.parents: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        width = len(languages)
        none = np.zeros((1, width))
        shorter, shorter_cost = None, np.full((1, width), 8.0)
        for n, (own, count) in enumerate(zip(grams, counts, strict=True), 1):
            last = (own & 255).astype(np.int64)
            if n == 1:
                parent, suffix, size = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), 1
            else:
                parent = np.searchsorted(shorter, own >> 8) + 1
                suffix = np.searchsorted(shorter, own & ((1 << 8 * (n - 1)) - 1)) + 1
                size = len(shorter) + 1
            total, kinds = np.zeros((size, width)), np.zeros((size, width))
            np.add.at(total, parent, count)
            np.add.at(kinds, parent, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                cost = np.where(
                    count > 0, np.log2((total + kinds)[parent] / count), escape[parent] + shorter_cost[suffix]
                )
            self.parents.append(parent)
            self.last.append(last)
            self.escapes.append(escape.astype(np.float32))
            if n == 1:
                self.unseen = (escape[:1] + 8.0).astype(np.float32)
            shorter, shorter_cost = own, np.r_[none, cost]
            self.costs.append(shorter_cost.astype(np.float32))

    @cached_property
    def steps(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of each byte value among those seen (0: none), and the node behind (node, byte) by level."""
        seen = np.zeros(256, np.int32)
        seen[self.last[0]] = np.arange(1, len(self.last[0]) + 1)
        width, size, tables = len(self.last[0]) + 1, 1, []
        for parent, last in zip(self.parents, self.last, strict=True):
            table = np.zeros(size * width, np.int32)
            table[parent * width + seen[last]] = np.arange(1, len(last) + 1)
            tables.append(table)
            size = len(last) + 1
        return seen, tables

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, bytes, int]] = []  # text, slice, bytes of it that are context only
        size = 0
        for i, text in enumerate(texts):
            for low in range(0, len(text), AT_ONCE):
                lead = min(low, self.order)
                group.append((i, text[low - lead : low + AT_ONCE], lead))
                size += len(group[-1][1])
                if size >= AT_ONCE:
                    self._add(group, out)
                    group, size = [], 0
        if group:
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        seen, tables = self.steps
        width = len(self.last[0]) + 1
        data = seen[np.frombuffer(b"".join(part for _, part, _ in group), np.uint8)]
        starts = np.r_[0, np.cumsum([len(part) for _, part, _ in group])[:-1]]
        nodes: list[np.ndarray] = []
        context: list[np.ndarray] = [np.zeros(len(data), np.int32)]
        for n, table in enumerate(tables):
            nodes.append(table[context[n] * width + data])
            before = np.r_[np.int32(0), nodes[n][:-1]]
            before[starts] = 0
            context.append(before)
        bits = self.costs[-1][nodes[-1]]
        left = np.flatnonzero(nodes[-1] == 0)
        for n in range(len(tables) - 1, -1, -1):
            if not len(left):
                break
            bits[left] += self.escapes[n][context[n][left]]
            if n:
                at = nodes[n - 1][left]
                bits[left] += self.costs[n - 1][at]
                left = left[at == 0]
            else:
                bits[left] += np.float32(8.0)
        for start, (_, _, lead) in zip(starts.tolist(), group, strict=True):
            if lead:
                bits[start : start + lead] = 0
        np.add.at(out, [i for i, _, _ in group], np.add.reduceat(bits, starts, axis=0, dtype=np.float64))

    def _lengths(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
        """The bytes of each text, none if it has no letter, and their bits in each language."""
        known = [t.lower().encode() if t is not None and self.languages and has_letter(t) else b"" for t in texts]
        parts = [self.code_lengths(known[i : i + TEXTS]) for i in range(0, len(known), TEXTS)]
        return known, np.concatenate([np.zeros((0, len(self.languages))), *parts])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior, if all languages are as likely before; of equals the first by name."""
        known, lengths = self._lengths(texts)
        best = lengths.argmin(axis=1) if self.languages else np.zeros(len(texts), int)
        langs = [self.languages[b] if t else UNDECIDED for t, b in zip(known, best.tolist(), strict=True)]
        if not self.languages:
            return langs, [0.0] * len(texts)
        with np.errstate(under="ignore"):
            share = 1 / np.exp2(np.minimum(lengths.min(axis=1, keepdims=True) - lengths, 0)).sum(axis=1)
        return langs, [s if t else 0.0 for t, s in zip(known, share.tolist(), strict=True)]

class Halves:
    """Two models, each of half of the labelled texts, so that no text is judged by one that has counted it.

    A language that has few texts, or texts in one half alone, is counted by both models.
    """

    def __init__(self, models: list[Model], bounds: np.ndarray):
        self.models, self.languages = models, models[0].languages
        # bits a byte up to which a text is taken to be in each language
        self.bounds = bounds

    def code_lengths(self, texts: list[bytes], halves: np.ndarray) -> np.ndarray:
        """Bits of each text in each language: by the model of the other half, the mean of both for a text in neither (-1)."""
        out = np.zeros((len(texts), len(self.languages)))
        for side, model in enumerate(self.models):
            asked = np.flatnonzero(halves != side)
            out[asked] += model.code_lengths([texts[i] for i in asked.tolist()])
        out[halves < 0] /= 2
        return out

    def within(self, texts: list[str | None], halves: np.ndarray) -> tuple[list[str], list[bool]]:
        """The language with the shortest code, `und` if there is none, and whether a text of it may cost so much.

        The words of a text may cost their bytes times the bound, and 8 bits for each byte at the start without
        a full context.
        """
        langs, fits = [], []
        for low in range(0, len(texts) if self.languages else 0, TEXTS):
            some, own = texts[low : low + TEXTS], halves[low : low + TEXTS]
            known = [t.lower().encode() if t is not None and has_letter(t) else b"" for t in some]
            best = self.code_lengths(known, own).argmin(axis=1)
            said = [words_alone(t) if b else b"" for t, b in zip(some, known, strict=True)]
            spent = self.code_lengths(said, own)[range(len(said)), best]
            fits += (spent <= self.bounds[best] * np.array([max(len(t), 1) for t in said], np.int64) + 8.0 * self.models[0].order).tolist()
            langs += [self.languages[b] if t else UNDECIDED for t, b in zip(known, best.tolist(), strict=True)]
        return (langs, fits) if self.languages else ([UNDECIDED] * len(texts), [False] * len(texts))


def bound(own: dict[int, int], other: dict[int, int]) -> float:
    """The bits a byte half way between what texts cost in their language and in the best other one.

    That is between the median of the former and what one in twenty texts stays below of the latter, but no
    less than what all but one in `STRANGE` cost in their own language. Given are the texts of each step.
    """

    def at(found: dict[int, int], share: float) -> float:
        steps, upto = sorted(found), np.cumsum([found[s] for s in sorted(found)])
        return steps[int(np.searchsorted(upto, np.ceil((upto[-1] - 1) * share), side="right"))] / STEPS

    return max((at(own, 0.5) + at(other, 0.05)) / 2, at(own, 1 - 1 / STRANGE))


def fit(
    labelled: DataFrame,
    order: int = 3,
    per_language: int = 300,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from whole texts of at most `per_language` rows of each language, those whose id and text hash lowest.

    `per_language` bounds the model, not the rows it is applied to. Rows without a language or a text are
    left out. Byte strings are counted where the texts lie and only their totals reach the driver.
    """
    rows = _labelled(labelled, id_col, text_col, lang_col)
    # Hashes are even, so about twice the wanted rows of a language lie below its limit, and no more are shuffled.
    limit = F.least(F.lit(1.0), 2.0 * per_language / F.col("rows")) * float(1 << 63)
    limits = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).select("lang", limit.alias("limit"))
    # One row a language, as the model has a column for each: sent to the texts, which are else all shuffled by language.
    near = rows.join(F.broadcast(limits), "lang").filter(F.col("place") <= F.col("limit"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("place", "id", "text"))
    chosen = near.select("lang", "text", number.alias("number")).filter(F.col("number") <= per_language)
    found, languages = _counted(chosen.select("lang", F.lit(0).alias("half"), "text"), order)
    return _model(found, languages, order)


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, text, place) of the rows with a language and a text; place is the hash of id and text."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    place = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    return rows.filter("lang IS NOT NULL AND text != ''").withColumn("place", place)


def half_of(text: Column) -> Column:
    """The half a text is in; equal texts are in the same one."""
    return F.xxhash64(text).bitwiseAND(F.lit(1)).cast("int")


def fit_halves(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Halves, list[str]]:
    """Learn from all labelled texts; also the languages whose texts are halved by `half_of`.

    Each half, scored by a model of the other, shows what unseen texts cost in their own language and in the
    best of the others (8 bits if there is none), as a text of a language that was not learned would. A language
    with no such text has no bound. A language with at most `FEW` texts deals them to the halves in turn.

    Byte strings are counted where the texts lie and only their totals reach the driver, as does a histogram of the costs.
    """
    rows = _labelled(docs, id_col, text_col, lang_col)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = F.col("lang").isin([lang for lang, n in sizes.items() if n <= FEW])
    turn = F.row_number().over(W.partitionBy("lang").orderBy("place", "id", "text")) % 2
    many = rows.filter(~few).select("lang", half_of(F.col("text")).alias("half"), "text")
    halved = many.unionByName(rows.filter(few).select("lang", turn.alias("half"), "text"))
    found, languages = _counted(halved, order)
    # of each half, the languages it has texts of
    learned = [np.isin(np.arange(len(languages)), found["lang"][found["half"] == side].unique()) for side in (0, 1)]
    apart = learned[0] & learned[1] & np.array([sizes[lang] > FEW for lang in languages], bool)
    models = [_model(found[found["half"] == side], languages, order) for side in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: Counter = Counter()
        for batch in batches:
            at, halves = np.searchsorted(languages, batch.column(0).to_pylist()), batch.column(1).to_numpy()
            for side, model in enumerate(shared.value):
                asked = np.flatnonzero((halves != side) & learned[side][at])
                for low in range(0, len(asked), TEXTS):
                    some = asked[low : low + TEXTS]
                    texts = [words_alone(batch.column(2)[i].as_py()) or b" " for i in some.tolist()]
                    each = model.code_lengths(texts) / np.array([[len(t)] for t in texts])
                    own = each[range(len(some)), at[some]].copy()
                    each[range(len(some)), at[some]] = np.inf
                    other = each.min(axis=1) if len(languages) > 1 else np.full(len(some), 8.0)
                    for kind, cost in enumerate((own, other)):
                        steps.update(zip(at[some].tolist(), [kind] * len(some), np.ceil(cost * STEPS).astype(int).tolist(), strict=True))
        parts = [[k[i] for k in steps] for i in range(3)]
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int32()) for n, v in zip(("lang", "kind", "step"), parts, strict=True)} | {"n": pa.array(list(steps.values()), pa.int64())})

    bounds = np.full(len(languages), np.inf)
    if languages:
        spent = halved.mapInArrow(costs, "lang int, kind int, step int, n long").groupBy("lang", "kind", "step").agg(F.sum("n").alias("n")).collect()
        each: dict[int, list[dict[int, int]]] = {}
        for r in spent:
            each.setdefault(r["lang"], [{}, {}])[r["kind"]][r["step"]] = r["n"]
        for at, (own, other) in each.items():
            bounds[at] = bound(own, other)
    if not apart.all():
        models = [_model(found[(found["half"] == side) | ~apart[found["lang"]]], languages, order) for side in (0, 1)]
    return Halves(models, bounds), [lang for lang, own in zip(languages, apart, strict=True) if own]


def _counted(texts: DataFrame, order: int) -> tuple[pd.DataFrame, list[str]]:
    """(lang, half, n, gram, cnt) of the byte strings of (lang, half, text), lang as a place among the languages given with it."""

    def some(held: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"\xff".join(held), np.uint8).astype(np.int64)
        grams, over, out = data, data == END, []
        for n in range(1, order + 2):
            if n > 1:
                grams, over = grams[:-1] << 8 | data[n - 1 :], over[:-1] | (data[n - 1 :] == END)
            out.append(np.unique(grams[~over], return_counts=True))
        return out

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([c for _, c in parts]), len(values)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = {}
        sizes: dict[tuple[str, int], int] = {}
        kept: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(key: tuple[str, int]) -> None:
            new = some(held.pop(key))
            kept[key] = [added(list(both)) for both in zip(kept[key], new, strict=True)] if key in kept else new
            sizes[key] = 0

        def given(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
            for n, (values, counts) in enumerate(kept.pop(key), 1):
                same = [pa.array([v] * len(values), t) for v, t in ((key[0], pa.string()), (key[1], pa.int32()), (n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(values), pa.array(counts)], ["lang", "half", "n", "gram", "cnt"])

        for batch in batches:
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key, data = (lang, half), text.as_py().lower().encode()
                held.setdefault(key, []).append(data)
                sizes[key] = sizes.get(key, 0) + len(data) + 1
                if sizes[key] >= COUNTED:
                    close(key)
                    if len(kept[key][-1][0]) >= COUNTED:
                        yield from given(key)
        for key in list(held):
            close(key)
        for key in list(kept):
            yield from given(key)

    counted = texts.select("lang", "half", "text").mapInArrow(count, "lang string, half int, n int, gram long, cnt long")
    got = counted.groupBy("lang", "half", "n", "gram").agg(F.sum("cnt").alias("cnt")).toArrow()
    names = got["lang"].combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    place = np.searchsorted(languages, names.dictionary.to_pylist()).astype(np.int32)
    found = got.drop_columns(["lang"]).to_pandas()
    found.insert(0, "lang", place[names.indices.to_numpy()] if len(place) else np.zeros(0, np.int32))
    return found, languages


def _model(found: pd.DataFrame, languages: list[str], order: int) -> Model:
    """The model of (lang, half, n, gram, cnt), lang as a place among the languages."""
    found = found.groupby(["lang", "n", "gram"], as_index=False)["cnt"].sum()
    grams, counts = [], []
    for n in range(1, order + 2):
        part = found[found["n"] == n]
        own, at = np.unique(part["gram"].to_numpy(np.int64), return_inverse=True)
        count_of = np.zeros((len(own), len(languages)))
        np.add.at(count_of, (at, part["lang"].to_numpy()), part["cnt"].to_numpy())
        grams.append(own)
        counts.append(count_of)
    return Model(languages, order, grams, counts)


def predictor(docs: DataFrame, model: Model):
    """A function of a text column that gives struct<lang_pred: string, score: double>.

    It is declared as not deterministic, or a filter on its result would have Spark score every text twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict.asNondeterministic()


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether the checksum of the id, as text, falls into the fold kept from learning; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def predict_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, read from the text alone.

    A null text and one without a letter are `und` with score 0, as is every text where nothing could be
    learned; the score is else the language's posterior. Repeated rows are kept, an empty table gives no
    rows. Columns of these two names are replaced.
    """
    predict, name = predictor(docs, model), unused(docs, "predicted")
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*kept, predict(F.col(text_col).cast("string")).alias(name)).select(*kept, f"{name}.*")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose text is in a language learned from the labelled ones, unlabelled rows labelled.

    All labelled texts are learned from, and each is judged by a model of those of the other half. Rejected are
    texts that are `und`, and those whose bytes cost more in the best language than its bound, whether they have a
    label or not; that several languages are about as likely, as for a short text, rejects none. Repeated rows are
    kept, an empty table gives no rows.
    """
    halves, apart = fit_halves(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    own = F.when(F.col(lang_col).cast("string").isin(apart), half_of(text_of(text_col))).otherwise(F.lit(-1))
    found = within_bounds(docs, halves, text_col, own)
    name = found.columns[-1]
    kept = found.filter((F.col(f"{name}.lang") != UNDECIDED) & F.col(f"{name}.within"))
    label = F.coalesce(F.col(lang_col), F.col(f"{name}.lang")).cast(docs.schema[lang_col].dataType).alias(lang_col)
    return kept.select(*[label if c.lower() == lang_col.lower() else F.col(c) for c in docs.columns])


def within_bounds(docs: DataFrame, halves: Halves, text_col: str, own: Column) -> DataFrame:
    """`docs` and, last, struct<lang, within>: the language with the shortest code, `und` without a letter, and
    whether that code is within what a text of the language may cost; `own` is the half that has counted the text, or -1."""
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    @pandas_udf("lang string, within boolean")
    def judge(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        langs, fits = shared.value.within([None if t is None else t for t in texts], own.to_numpy(np.int32))
        return pd.DataFrame({"lang": langs, "within": fits})

    return docs.withColumn(unused(docs, "judged"), judge.asNondeterministic()(F.col(text_col).cast("string"), own))
