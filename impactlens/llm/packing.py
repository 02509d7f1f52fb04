"""Packing by powers of two: each document is cut into pieces whose lengths are powers of two.

A piece is a sequence of its own, so no sequence crosses documents and none needs padding; pieces
of one length form a bucket, from which batches of one shape are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from impactlens.llm.columns import schema_of, text_of

# Distinct words a Python worker keeps the ids of, in two generations; beyond it the words not seen for longest go.
REMEMBERED = 1_000_000
# Characters of a word that is kept.
SHORT = 100
# Rows of a result batch sent back at once.
ROWS = 20_000

# Byte-level pre-tokenisers never join a word to the blank behind it, so a text may be cut in front of
# any blank that a visible character follows.
WORD_STARTS = re.compile(r" (?=\S)")
# Nor do they join a line end between visible characters to either: a text without other white space than
# such line ends and blanks falls into the words of its lines.
ODD_SPACE = re.compile(r"[^\S \n]")
RUNS = ("  ", " \n", "\n ", "\n\n")
# Signs that are a token of their own behind a word of letters.
SIGNS = ".,;:!?"
# Letters below this are letters to every version of Unicode.
LATIN_END = "\u0250"


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file is of the byte-level kind, whose ids of a text are those of its words."""
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return bool(plain and spec["model"]["type"] == "BPE" and not spec["normalizer"])


class WordIds(dict):
    """Ids of a word behind a blank as little-endian bytes, encoded by the tokenizers library when first asked for.

    A text with added tokens in it, and any text for a file of another kind, goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        # Printable Latin-1 characters stand for their own byte, the other bytes for characters from U+0100 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in shown]
        self.spelling = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.line_end = self.direct("\n")
        self.signs = {sign: self.direct(sign) for sign in SIGNS}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a blank and the word; of the word alone if it begins with a line end."""
        ids = self.older.get(word)
        if ids is None:
            plain = word[1:] if word[:1] == "\n" else " " + word
            if word[-1:] in self.signs and word[:-1].lstrip("\n").isalpha():
                ids = self[word[:-1]] + self.signs[word[-1]]
            elif plain.lstrip().isalpha() and max(plain) < LATIN_END:
                # letters are one token to be, which the file's model merges without the steps before it
                spelled = "".join(map(self.spelling.__getitem__, plain.encode()))
                ids = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            else:
                ids = self.direct(plain)
        if len(word) <= SHORT:
            if 2 * len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The tokenizer's ids of a whole text, without added special tokens."""
        if not self.by_word or any(s in text for s in self.special):
            return self.direct(text)
        if any(run in text for run in RUNS) or text[:1] in " \n" or text[-1:] in " \n" or ODD_SPACE.search(text):
            first, *rest = WORD_STARTS.split(text)
            return (self.direct(first) if first else b"") + b"".join(map(self.__getitem__, rest))
        get = self.__getitem__
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(get("\n" + first) + b"".join(map(get, rest)))
        return self.line_end.join(lines)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as full pieces of `longest`, a power of two, and then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_powers(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    longest: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) per piece.

    `tokenizer` is the path of a byte-level tokenizer file, `ids` the piece's ids as little-endian
    unsigned 32-bit integers, `length` also names the bucket. A document is its ids and then
    `end_id`; a null or empty text is the end alone, a repeated row is packed again, an empty table
    gives no pieces, other columns are left out. Cost and memory follow the text of one batch; no
    shuffle is needed, and a lost task is redone on its own.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])

            def flush() -> pa.RecordBatch:
                row, start, length, ids, total = rows
                out = [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(total, pa.int64()),
                ]
                for column in rows:
                    column.clear()
                return pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids", "doc_tokens"])

            for i, text in enumerate(batch.column(1)):
                data = encoder.encode(text.as_py()) + end
                n, at = len(data) // 4, 0
                for length in binary_lengths(n, longest):
                    for column, value in zip(rows, (i, at, length, data[4 * at : 4 * (at + length)], n), strict=True):
                        column.append(value)
                    at += length
                if len(rows[0]) >= ROWS:
                    yield flush()
            if rows[0]:
                yield flush()

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    pieces = given.mapInArrow(
        cut, schema_of(given, id="=id", start="long", length="long", ids="binary", doc_tokens="long")
    )
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
