"""Packing, token counts and piece encoding against the libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from impactlens.llm import packing, pieces, token_counts
from impactlens.llm.queries import BYTE_LEVEL, PIECES, QUERIES

LETTERS = "abcdeth erinon  \n\t0123'.,-é你🙂▁\xa0\x1c\x85"


def odd_texts():
    rng = random.Random(5)
    fixed = [
        None, "", " ", "  ", "   a  b ", "\n\n x\t y \n z", "</s><s>[INST] ok", "<0x0A><unk>", "a" * 500, "ab" * 300,
        "<|endoftext|> hi <|endoftext|>", "it's they'll 123 4 56", "\r\n \r\n", "﻿abc", "the" * 3000, "aaaab" * 999,
        "".join(rng.choice("thewhatandin") for _ in range(5000)), "word " * 30_000,
    ]
    return fixed + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 200))) for _ in range(300)]


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS id")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


TOKENIZER = Tokenizer.from_file(BYTE_LEVEL)


def packed_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_every_id_lies_in_one_piece(docs, texts):
    got = {}
    rows = packing.pack_powers(docs, BYTE_LEVEL).collect()
    for r in sorted(rows, key=lambda r: r.start):
        assert r.length <= 1024 and r.length & (r.length - 1) == 0 and len(r.ids) == 4 * r.length
        assert r.start == len(got.get(r.doc_id, [])) and r.offset == 0
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert got == {i: packed_ids(t) for i, t in enumerate(texts)}
    assert all(r.doc_tokens == len(got[r.doc_id]) for r in rows)
    assert packing.pack_powers(docs.limit(0), BYTE_LEVEL).count() == 0


def test_packing_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = {i: packed_ids(t) for i, t in texts.items()}
    for r in QUERIES["op4_power_of_two_packing"](spark, sf).collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (5, [4, 1]), (16, [8, 8]), (23, [8, 8, 4, 2, 1])])
def test_binary_lengths(n, want):
    assert packing.binary_lengths(n, 8) == want


def test_counts_are_those_of_the_library(docs, texts, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, PIECES, limit=50).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50), t
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("alphabet", ["thewhatandin", "ab", "aaaaa é🙂0", "XYZabc019+/=", "=-", "abcdefghijklmnopqrstuvwxyz"])
def test_long_units_are_counted_as_short_ones(alphabet, library):
    merger = token_counts.unit_counts(PIECES).merger
    rng = random.Random(alphabet)
    for _ in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300)))
        units = merger.vocabulary.units(text)
        assert [merger.count_long(u) for u in units] == merger.counts(units).tolist()
    text = "".join(rng.choices(alphabet, k=100_000))
    start = time.process_time()
    assert sum(map(merger.count_long, merger.vocabulary.units(text))) == len(library.encode(text))
    assert time.process_time() - start < 5


def test_encoding_and_decoding_are_those_of_the_library(docs, texts, library):
    encoded = pieces.encode_texts(docs, PIECES)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in pieces.decode_texts(encoded, PIECES).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i] == (ids, library.decode(ids)), t
    assert pieces.decode_texts(encoded.limit(0), PIECES).count() == 0
    once = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in pieces.round_trip(docs, PIECES).collect()}
    assert once == got and pieces.round_trip(docs.limit(0), PIECES).count() == 0


def test_any_ids_decode_as_in_the_library(library):
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 12))]
        assert pieces.decode_ids(np.array(ids, "<u4").tobytes(), PIECES) == library.decode(ids)


def test_token_queries(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    counted = {r.doc_id: r for r in QUERIES["op6_token_counts"](spark, sf).collect()}
    encoded = {r.doc_id: r for r in QUERIES["op9_piece_encoding"](spark, sf).collect()}
    assert counted.keys() == encoded.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert counted[i].n_tokens == len(ids) - 2 and encoded[i].n_tokens == len(ids)
        assert encoded[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert encoded[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
