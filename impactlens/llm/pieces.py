"""Sentencepiece encoding and decoding: exact merge-type encoding by backtracking.

An encoding is right exactly if all its neighbours are compatible, that is, if merging the text of
two neighbours again gives the two. So the longest pieces are tried first, found by Aho-Corasick;
where a piece does not fit its predecessor, or ends where nothing goes on (a bitfield), a shorter
one is tried, and if none is left the predecessor is taken back.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from impactlens.llm.columns import schema_of, text_of
from impactlens.llm.vocabulary import SPACE, vocabulary

# Units and pairs a Python worker remembers at most; what was not asked for lately goes first, results do not change.
REMEMBERED = 500_000
REMEMBERED_PAIRS = 300_000


class Encoder(dict):
    """Ids of a unit as little-endian bytes, encoded when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = v = vocabulary(path)
        self.older: dict[str, bytes] = {}  # what was remembered before this dictionary last was full
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        # How each piece comes about: before every merge inside it, its rank and the first and last symbol.
        self.steps: dict[int, list[tuple[int, str, str]]] = {}
        for piece, i in v.ids.items():
            steps = self.remerge(piece)
            if steps[-1][1] == piece:  # others are never the outcome of merging
                self.automaton.add_word(piece, (i, len(piece)))
                self.steps[i] = steps
        self.automaton.make_automaton()

    def __missing__(self, unit: str) -> bytes:
        known = self.older.get(unit)
        if known is not None:
            return self.remember(unit, known)
        v, ids, at = self.vocabulary, [], 0
        for strange in v.strange.finditer(unit):
            ids += self.backtrack(unit[at : strange.start()])
            ids += [v.bytes[b] for b in strange[0].encode()]
            at = strange.end()
        ids += self.backtrack(unit[at:])
        data = np.array(ids, "<u4").tobytes()
        return self.remember(unit, data) if len(unit) <= 100 else data

    def remember(self, unit: str, data: bytes) -> bytes:
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[unit] = data
        return data

    def remerge(self, text: str) -> list[tuple[int, str, str]]:
        """Merge the best pair, the leftmost of equals, until none is left: (rank, first, last) before each step."""
        rank, parts, steps = self.vocabulary.rank, list(text), []
        none = len(rank)
        while True:
            best, i = min(((rank.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1)), default=(none, 0))
            steps.append((best, parts[0], parts[-1]))
            if best == none:
                return steps
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives the two: no merge across comes first at any step."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        rank, none = self.vocabulary.rank, len(self.vocabulary.rank)
        a, b = self.steps[left], self.steps[right]
        i = j = 0
        while True:
            ra, rb, across = a[i][0], b[j][0], rank.get(a[i][2] + b[j][1], none)
            if across < ra and across <= rb:
                known = False
            elif ra == rb == none:
                known = True
            elif ra <= rb:
                i += 1
                continue
            else:
                j += 1
                continue
            break
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text made of known characters only.

        Where the longest pieces from left to right all fit, they are what the search would take.
        """
        longest = [i for _, (i, _) in self.automaton.iter_long(text)]
        if all(map(self.compatible, longest, longest[1:])):
            return longest
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (id, end), the longest last
        for last, (i, size) in self.automaton.iter(text):
            starts[last + 1 - size].append((i, last + 1))
        failed = bytearray(n // 8 + 1)
        taken: list[tuple[int, int, int]] = []  # id, start, place among the pieces that begin there
        at, choice = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            before = taken[-1][0] if taken else None
            for k in range(choice, -1, -1):
                i, end = starts[at][k]
                if not failed[end >> 3] >> (end & 7) & 1 and (before is None or self.compatible(before, i)):
                    taken.append((i, at, k))
                    at = end
                    choice = len(starts[at]) - 1 if at < n else 0
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                _, at, k = taken.pop()
                choice = k - 1
        return [i for i, _, _ in taken]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    assert isinstance(error, UnicodeDecodeError)
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


@lru_cache(maxsize=4)
def surfaces(path: str) -> list[bytes]:
    """What each piece stands for in a decoded text."""
    v = vocabulary(path)
    of = {i: bytes([b]) for b, i in v.bytes.items()}
    plain = {v.CONTROL: "", v.UNKNOWN: v.unk_surface}
    return [
        of.get(i) or plain.get(kind, piece.replace(SPACE, " ")).encode()
        for i, (piece, kind) in enumerate(zip(v.pieces, v.kinds, strict=True))
    ]


def decode_ids(ids: bytes, path: str) -> str:
    """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD each."""
    v, parts = vocabulary(path), surfaces(path)
    numbers = np.frombuffer(ids, "<u4").tolist()
    text = b"".join(map(parts.__getitem__, numbers)).decode("utf-8", "each_byte")
    if v.prefix:
        first = next((i for i in numbers if v.kinds[i] != v.CONTROL), None)
        if first is not None and v.pieces[first].startswith(SPACE):
            return text[1:]
    return text


def encode_texts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", edges: bool = True
) -> DataFrame:
    """(id, ids) per row: the sentencepiece ids of the whole text as little-endian unsigned 32-bit integers.

    `edges` adds the begin and end ids. A null or empty text has no other ids; control strings inside
    a text are ordinary characters; repeated rows are encoded again, an empty table gives no rows,
    other columns are left out. Work stays within the task that reads a text; nothing is shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)
        v = known.vocabulary
        begin, end = (np.array([i], "<u4").tobytes() if edges else b"" for i in (v.begin, v.end))
        for batch in batches:
            ids = [b"".join([begin, *map(known.__getitem__, v.units(t.as_py())), end]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(encode, schema_of(given, id="=id", ids="binary")).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text) per row, as decode_texts(encode_texts(docs)) gives them, in one pass over the texts."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)
        v = known.vocabulary
        begin, end = (np.array([i], "<u4").tobytes() for i in (v.begin, v.end))
        for batch in batches:
            ids = [b"".join([begin, *map(known.__getitem__, v.units(t.as_py())), end]) for t in batch.column(1)]
            texts = [decode_ids(x, model) for x in ids]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "text"])

    given = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return given.mapInArrow(both, schema_of(given, id="=id", ids="binary", text="string")).withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) per row, the text decoded from the ids; null ids give an empty text and stay null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(x.as_py() or b"", model) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["id", "ids", "text"])

    given = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    decoded = given.mapInArrow(decode, schema_of(given, id="=id", ids="binary", text="string"))
    return decoded.withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col)
