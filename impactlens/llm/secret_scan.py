"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The two models are tables of transitions between ASCII characters, learned from labelled samples: random
strings are what the fixed patterns find and digests of sampled ids, ordinary identifiers are the words of
the same texts. A token is a secret if it is by far likelier under the first model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from impactlens.llm.columns import number_array, text_of, unused

# The patterns and least lengths of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"
ASSIGNED_LEAST = 8

KINDS = ("assign", "access", "hex", "random")
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"

# Runs the models are asked about, and the characters that part a run: a secret begins and ends at one, or with the run.
TOKEN = r"[A-Za-z0-9+/_=-]{8,}"
SEPARATORS = "+/_=-"
# Ordinary identifiers: words and plain numbers.
WORD = r"[A-Za-z0-9_-]{4,}"


def _spans(text: Column, pattern: str, kind: str, wanted: Callable[[Column], Column] = lambda match: F.lit(True)) -> Column:
    """The `wanted` ones of all leftmost matches that do not overlap, as spans in code points; `found` is the match.

    The text between matches gives their places: places are running sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        found,
        lambda gap, match: F.struct(F.char_length(gap).cast("long").alias("gap"), match.alias("match")),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,match:string>>").alias("out"))
    placed = F.aggregate(
        parts,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.char_length(p["match"])).alias("at"),
            F.when(wanted(p["match"]), F.concat(acc["out"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["match"].alias("match")))))
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,found:string>>")
    spans = F.transform(
        placed,
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            (s["start"] + F.char_length(s["match"])).alias("end"),
            s["match"].alias("found"),
        ),
    )
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, found>> of the fixed patterns, by start and then kind as listed."""
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(
        F.zip_with(
            _spans(text, ASSIGN, "assign"),
            F.when(text.rlike(ASSIGN), value).otherwise(F.array().cast("array<string>")),
            lambda s, v: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), v.alias("found")
            ),
        ),
        lambda s: F.char_length(s["found"]) >= ASSIGNED_LEAST,
    )
    return _in_order(F.concat(assigned, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def _in_order(spans: Column) -> Column:
    """Sorted by start and then kind as listed."""
    listed = F.array(*map(F.lit, KINDS))
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(listed, s["kind"]).alias("b"), s.alias("s")))),
        lambda x: x["s"],
    )


def _transitions(tokens: DataFrame) -> DataFrame:
    """(random, a, b, cnt) of neighbouring ASCII characters in (random, token) rows."""
    chars, rest = F.split("token", ""), F.char_length("token") - 1
    pairs = F.zip_with(F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda a, b: F.concat(a, b))
    rows = tokens.filter(F.char_length("token") > 1).select("random", F.explode(pairs).alias("pair"))
    code = F.ascii("pair").alias("a"), F.ascii(F.substring("pair", 2, 1)).alias("b")
    return rows.select("random", *code).filter("a < 128 AND b < 128").groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("cnt"))


def train(docs: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios, random over ordinary, of all transitions a -> b at place 128 a + b.

    The samples are the whole texts of at most `sample_rows` ids, those that hash lowest; the
    bound concerns learning alone. Labels: values found by the fixed patterns, and four encodings of a
    digest of every sampled id, are random; words outside such values are ordinary. Add-one smoothing
    over the characters of tokens gives every transition a ratio, also with an empty sample.
    """
    given = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    chosen = given.select("id").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = given.join(F.broadcast(chosen.distinct()), "id", "left_semi")
    digest = F.sha2(F.col("id"), 512)
    made = F.array(
        digest,
        F.base64(F.unhex(digest)),
        F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)),
        F.translate(F.base64(F.unhex(F.substring(digest, 1, 64))), "+/", "-_"),
    )
    values = F.transform(base_spans(F.col("text")), lambda s: s["found"])
    rest = F.regexp_replace(F.regexp_replace(F.col("text"), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    labelled = sample.select(
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("random"), F.concat(made, values).alias("tokens")),
                F.struct(F.lit(False).alias("random"), F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)).alias("tokens")),
            )
        ).alias("s")
    ).select("s.random", F.explode("s.tokens").alias("token"))
    signs = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    counts = {(r["random"], r["a"], r["b"]): r["cnt"] for r in _transitions(labelled).collect()}

    def share(random: bool, a: int, b: int, total: int) -> float:
        return (counts.get((random, a, b), 0) + 1) / (total + len(signs))

    ratios = [0.0] * (128 * 128)
    for a in signs:
        totals = {r: sum(counts.get((r, a, b), 0) for b in signs) for r in (True, False)}
        for b in signs:
            ratios[128 * a + b] = log(share(True, a, b, totals[True]) / share(False, a, b, totals[False]))
    return ratios


def best_parts(token: Column, ratios: Column, min_score: float) -> Column:
    """array<struct<start, end, score>>: the parts of a token with a score of `min_score` or more, in one pass.

    A part goes from one end of the token or separator to another, and its score is the sum of the ratios
    of its transitions. Whenever the sum falls below 0 at a separator a new part begins behind it, and the
    part before it is closed where its sum was greatest.
    """
    separators = F.array(*map(F.lit, SEPARATORS))
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    zero, sums = F.lit(0), F.lit(0.0)
    start = F.struct(
        zero.alias("last"), zero.alias("at"), zero.alias("start"), sums.alias("sum"), zero.alias("end"), sums.alias("best"), none.alias("out")
    )

    def closed(acc: Column, end: Column, best: Column) -> Column:
        part = F.struct(acc["start"].alias("start"), end.alias("end"), best.alias("score"))
        return F.when(best >= min_score, F.concat(acc["out"], F.array(part))).otherwise(acc["out"])

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        parts = F.array_contains(separators, c)
        # a part that ends in front of this character has the sum without it
        better = parts & (acc["sum"] > acc["best"])
        end, best = F.when(better, acc["at"]).otherwise(acc["end"]), F.when(better, acc["sum"]).otherwise(acc["best"])
        fresh = parts & (acc["sum"] < 0)
        behind = acc["at"] + 1
        ratio = F.when(acc["last"] == 0, 0.0).otherwise(F.get(ratios, 128 * acc["last"] + code))
        return F.struct(
            F.when(fresh, 0).otherwise(code).alias("last"),
            behind.alias("at"),
            F.when(fresh, behind).otherwise(acc["start"]).alias("start"),
            F.when(fresh, 0.0).otherwise(acc["sum"] + ratio).alias("sum"),
            F.when(fresh, behind).otherwise(end).alias("end"),
            F.when(fresh, 0.0).otherwise(best).alias("best"),
            F.when(fresh, closed(acc, end, best)).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        better = acc["sum"] > acc["best"]
        return closed(acc, F.when(better, acc["at"]).otherwise(acc["end"]), F.greatest(acc["sum"], acc["best"]))

    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step, finish)


def most_score(token: Column, ratios: Column) -> Column:
    """No part of a token can have a higher score: the sum of `ratios`, those above 0, of its transitions."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))  # no token has the character 0, and its ratios are 0
    return F.aggregate(
        F.split(token, ""),
        start,
        lambda acc, c: F.struct(F.ascii(c).alias("last"), (acc["sum"] + F.get(ratios, 128 * acc["last"] + F.ascii(c))).alias("sum")),
        lambda acc: acc["sum"],
    )


def _blanked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by as many blanks, so that places stay."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        low = F.greatest(acc["at"], s["start"])
        before = F.substring(text, (acc["at"] + 1).cast("int"), (low - acc["at"]).cast("int"))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - low, F.lit(0).cast("long")).cast("int"))
        return F.struct(F.greatest(low, s["end"]).alias("at"), F.concat(acc["out"], before, blank).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def find_spans(docs: DataFrame, ratios: Sequence[float], min_score: float = 15.0, text_col: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with `name`: array<struct<kind, start, end, score>> by start and then kind.

    Kinds assign, access and hex are the matches of the fixed patterns, all of them, with a null score;
    random are the parts with a score of `min_score` or more of runs in what those leave of the text.
    Places are code points, ends exclusive. A null or empty text has no spans; repeated rows are kept, an
    empty table gives no rows; a column of that name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    text_name, base_name, rest_name, runs_name = (unused(docs, n) for n in ("text", "base", "rest", "runs"))
    table, above = number_array(ratios), number_array(max(r, 0.0) for r in ratios)
    base, text, rest = F.col(base_name), F.col(text_name), F.col(rest_name)
    none = F.lit(None).cast("double")
    fixed = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), none.alias("score")))
    runs = _spans(rest, TOKEN, "random", lambda match: most_score(match, above) >= min_score)
    scored = F.flatten(
        F.transform(
            F.col(runs_name),
            lambda t: F.transform(
                best_parts(t["found"], table, min_score),
                lambda p: F.struct(
                    t["kind"].alias("kind"), (t["start"] + p["start"]).alias("start"), (t["start"] + p["end"]).alias("end"), p["score"].alias("score")
                ),
            ),
        )
    )
    return (
        docs.select(*docs.columns, text_of(text_col).alias(text_name))
        .select(*docs.columns, text_name, base_spans(text).alias(base_name))
        .select(*docs.columns, base_name, _blanked(text, base).alias(rest_name))
        .select(*kept, base_name, runs.alias(runs_name))
        .select(*kept, _in_order(F.concat(fixed, scored)).cast(f"array<{SPAN}>").alias(name))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping ones, replaced by the mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the secrets in its texts replaced; rows and other columns stay, texts without secrets too."""
    name = unused(docs, "spans")
    found = find_spans(docs, train(docs, id_col=id_col, text_col=text_col), text_col=text_col, name=name)
    text = F.col(text_col)
    return found.withColumn(text_col, F.when(text.isNull(), text).otherwise(redacted(text, F.col(name)))).select(*docs.columns)
