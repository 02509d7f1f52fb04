"""The registered queries of this subpackage: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from impactlens.llm import (
    chat,
    ctph,
    divergence,
    exact_dedup,
    language_id,
    licences,
    packing,
    pieces,
    secret_scan,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences every document names, and its best coefficient."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"), least=0.8)
    names = F.transform("licences", lambda x: x["licence"])
    return found.select(
        "doc_id",
        F.array_join(names, ",").alias("licences"),
        F.size("licences").cast("long").alias("n_licences"),
        F.array_max(F.transform("licences", lambda x: x["dice"])).alias("best_dice"),
    )


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, and the components of those at most four bits apart."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    found = ctph.compare_with_successor(table(spark, sf_dir, "documents"))
    own = F.col("fingerprint")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        ctph.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        ctph.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of binary lengths, each a sequence without padding."""
    packed = packing.pack_powers(table(spark, sf_dir, "documents"), BYTE_LEVEL, end_id=0, longest=1024)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest id stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document in the pieces of the 32k vocabulary."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES, limit=4096)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    parts = rows.withColumn("content", chat.full_parts(chat.text_part(F.col("text"))))
    formatted = chat.format_turns(parts).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    read = formatted.withColumn(
        "learned", F.array_join(chat.masked_texts(F.col("formatted"), chat.loss_spans(F.col("turns"))), "")
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by fixed patterns and by the Markov models."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find_spans(docs.select("doc_id", "text"), secret_scan.train(docs), min_score=15.0)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces, and decoded again from them."""
    decoded = pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()), order=3, per_language=300)
    found = language_id.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of every source are from those of its language and of each other source."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least_documents=30)


# The rules of the URL filter.
URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, and by models of the addresses that the rules accept and reject."""
    pages = table(spark, sf_dir, "pages")
    machine = url_filter.train(url_filter.ruled(pages, URL_RULES), order=4, most_states=3000, whole=True)
    return url_filter.judge(pages, URL_RULES, machine)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four codes, and their errors."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return coded.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_licence_scan,
        op2_simhash_near_duplicates,
        op3_piecewise_fingerprints,
        op4_power_of_two_packing,
        op5_content_sort_dedup,
        op6_token_counts,
        op7_chat_formatting,
        op8_secret_scan,
        op9_piece_encoding,
        op10_language_id,
        op11_source_divergence,
        op12_url_filter,
        op13_vector_codes,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _licence_sql(least: float) -> str:
    """The scan in SQL, with the size bounds left out: they change no result."""
    rows = ", ".join(
        f"('{name}', [{', '.join(repr(g) for g in licences.template_bigrams(text))}])" for name, text in licences.TEMPLATES
    )
    return rf"""
WITH templates(licence, grams) AS (VALUES {rows}),
norm AS (SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS t FROM documents),
passages AS (
  SELECT r, unnest(list_concat(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n(?: ?\n)+')), [t])) AS p FROM norm),
worded AS (SELECT r, list_filter(regexp_split_to_array(p, '[ \n]+'), lambda w: w <> '') AS w FROM passages),
grams AS (SELECT r, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM worded WHERE len(w) > 1),
scored AS (
  SELECT r, licence, max(2.0::DOUBLE * len(list_intersect(g.g, t.grams)) / (len(g.g) + len(t.grams))) AS dice
  FROM grams g JOIN templates t ON len(g.g) <= 8 * len(t.grams) GROUP BY 1, 2),
kept AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licences, count(*) AS n, max(dice) AS best
         FROM scored WHERE dice >= {least} GROUP BY 1)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n, 0) AS n_licences, best AS best_dice
FROM norm LEFT JOIN kept USING (r)"""


SQL: dict[str, str] = {
    "op1_licence_scan": _licence_sql(0.8),
    "op5_content_sort_dedup": f"""
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY t)""",
    "op7_chat_formatting": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + length(role)
    + 4 * (length(text || role) - length(replace(text || role, '&', '')))
    + 3 * (length(text || role) - length(replace(text || role, '<', '')))
    + 4 * (length(text || role) - length(replace(replace(text || role, '[', ''), ']', ''))) + 9 AS n
  FROM rows),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
         CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM whole""",
    "op11_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
sources AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
dense AS (
  SELECT s.lang, s.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
  FROM sources s JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS BIGINT) AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50""",
}
