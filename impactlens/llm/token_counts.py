"""Token counts by rank-synchronous merging over ragged numpy arrays."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from impactlens.llm.columns import schema_of, text_of
from impactlens.llm.vocabulary import vocabulary

# Distinct units a Python worker keeps the counts of; beyond it the memory is emptied, results do not change.
REMEMBERED = 600_000
# Characters merged in one go, and characters from which on a unit is merged by itself.
TOGETHER = 500_000
LONG = 2_000
NONE = np.iinfo(np.int64).max


class Merger:
    """Counts the pieces of units. Symbols are piece ids; a character without a piece is -(bytes of it)."""

    def __init__(self, path: str):
        self.vocabulary = v = vocabulary(path)
        self.size = len(v.pieces)
        pairs = [
            (v.ids[p[:k]] * self.size + v.ids[p[k:]], r, v.ids[p])
            for p, r in v.rank.items()
            for k in range(1, len(p))
            if p[:k] in v.ids and p[k:] in v.ids
        ]
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.reach = 2 * max(map(len, v.rank))
        # A piece may be made at all its places at once unless another piece that it is an end of comes
        # first, or shares its rank; such pieces are made at the leftmost place only.
        self.alone = np.zeros(len({*v.rank.values()}), bool)
        shared = np.bincount(list(v.rank.values())) > 1
        self.alone[: len(shared)] |= shared
        for p, r in v.rank.items():
            for k in range(1, len(p)):
                for part, rest in ((p[:k], p[k:]), (p[k:], p[:k])):
                    if part in v.ids and rest in v.ids and len(part) > 1 and v.rank[part] > r:
                        self.alone[v.rank[part]] = True

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of neighbours."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], -1)

    def counts(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit, none of them empty."""
        ids = self.vocabulary.ids
        symbols = np.array([ids[c] if c in ids else -len(c.encode()) for u in units for c in u], np.int64)
        lengths = np.array([len(u) for u in units], np.int64)
        sequence = np.repeat(np.arange(len(units)), lengths)
        total = np.zeros(len(units), np.int64)

        def pairs(at: np.ndarray) -> None:
            """Look up anew the pairs that begin at these places."""
            inside = at + 1 < len(symbols)
            at = at[inside]
            r, m = self.look(symbols[at], symbols[at + 1])
            same = sequence[at] == sequence[at + 1]
            rank[at], made[at] = np.where(same, r, NONE), m

        rank, made = np.full(len(symbols), NONE), np.full(len(symbols), -1, np.int64)
        pairs(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = best == NONE
            if done.any():
                over = np.repeat(done, sizes)
                np.add.at(total, sequence[over], np.maximum(-symbols[over], 1))
                symbols, sequence, rank, made = (x[~over] for x in (symbols, sequence, rank, made))
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # neighbours cannot both merge: within a run of hits every second one, from the left
            fresh = np.r_[True, (np.diff(hit) != 1) | (sequence[hit[1:]] != sequence[hit[:-1]])]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            keep = (np.arange(len(hit)) - run) % 2 == 0
            leftmost = np.r_[True, sequence[hit[1:]] != sequence[hit[:-1]]]
            hit = hit[keep & (leftmost | ~self.alone[rank[hit]])]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            new = np.cumsum(stay)[hit] - 1
            symbols, sequence, rank, made = (x[stay] for x in (symbols, sequence, rank, made))
            rank[new] = NONE
            pairs(np.union1d(new, new[new > 0] - 1))
        return total


    def count_long(self, unit: str) -> int:
        """Tokens of one long unit: the same merges, but each round touches the places of one rank and their neighbours only.

        Places wait by rank; a place whose pair has changed since is passed over. A symbol that was merged
        away leaves the chain of neighbours.
        """
        ids = self.vocabulary.ids
        symbols = np.array([ids[c] if c in ids else -len(c.encode()) for c in unit], np.int64)
        n = len(symbols)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        rank, made = np.full(n, NONE), np.full(n, -1, np.int64)
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def renew(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places, and let them wait by rank."""
            inside = after[at] < n
            rank[at[~inside]] = NONE
            at = at[inside]
            rank[at], made[at] = self.look(symbols[at], symbols[after[at]])
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            starts = np.flatnonzero(np.r_[len(at) > 0, ranks[1:] != ranks[:-1]]).tolist()
            for low, high in zip(starts, [*starts[1:], len(at)], strict=False):
                own = int(ranks[low])
                if own not in waiting:
                    waiting[own] = []
                    heapq.heappush(heap, own)
                waiting[own].append(at[low:high])

        def followed(at: np.ndarray, lowest: int) -> np.ndarray:
            """Whether the piece made at each place could merge on with a neighbour, as it is or merged, before any other."""
            piece, right, left = made[at], after[after[at]], before[at]
            first = np.zeros(len(at), bool)
            for neighbour in (piece, np.where(right < n, symbols[np.minimum(right, n - 1)], -1)):
                first |= self.look(piece, neighbour)[0] < lowest
            for neighbour in (piece, np.where(left >= 0, symbols[left], -1)):
                first |= self.look(neighbour, piece)[0] < lowest
            return first

        renew(np.arange(n))
        while heap:
            lowest = heapq.heappop(heap)
            hit = np.unique(np.concatenate(waiting.pop(lowest)))
            found = hit = hit[rank[hit] == lowest]
            if not len(hit):
                continue
            fresh = np.r_[True, after[hit[:-1]] != hit[1:]]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            if self.alone[lowest]:
                # What follows a merge at once lies within a piece around it, so a place as far behind one that has
                # such a follower as two pieces are long cannot be touched by it; nearer ones wait.
                last = np.maximum.accumulate(np.where(followed(hit, lowest), hit, -self.reach))
                wait = hit - np.r_[-self.reach, last[:-1]] < self.reach
                if wait.any():
                    waiting[lowest] = [found]
                    heapq.heappush(heap, lowest)
                    hit = hit[~wait]
            gone = after[hit]
            symbols[hit] = made[hit]
            alive[gone] = False
            rank[gone] = NONE
            after[hit] = after[gone]
            before[after[hit]] = hit
            left = before[hit]
            renew(np.union1d(hit, left[left >= 0]))
        return int(np.maximum(-symbols[alive], 1).sum())


class UnitCounts(dict):
    """Tokens by unit, merged in bounded batches."""

    def __init__(self, path: str):
        super().__init__()
        self.merger = Merger(path)
        self.held = 0  # characters

    def fill(self, units: set[str]) -> None:
        """Make sure of all these units; what else is known may go."""
        if len(self) + len(units) > REMEMBERED or self.held > 16 * REMEMBERED:
            self.clear()
            self.held = 0
        batch: list[str] = []
        size = 0
        for unit in units:
            if unit in self:
                continue
            if len(unit) >= LONG:
                self[unit] = self.merger.count_long(unit)
                self.held += len(unit)
                continue
            batch.append(unit)
            size += len(unit)
            if size >= TOGETHER:
                self.merge(batch)
                batch, size = [], 0
        if batch:
            self.merge(batch)

    def merge(self, batch: list[str]) -> None:
        self.update(zip(batch, self.merger.counts(batch).tolist(), strict=True))
        self.held += sum(map(len, batch))


@lru_cache(maxsize=4)
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)


def count_tokens(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row: the length of a text in UTF-8 and in pieces of `model`.

    Counts are those of the sentencepiece library without begin and end; control strings inside a
    text are ordinary characters. A null or empty text has no bytes and no tokens, repeated rows are
    counted again, an empty table gives no rows, other columns are left out. Texts are worked on in
    groups of bounded size where they lie; nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unit_counts(model)
        units_of = known.merger.vocabulary.units
        for batch in batches:
            tokens: list[int] = []
            group: list[list[str]] = []
            size = 0

            def settle() -> None:
                known.fill({u for units in group for u in units})
                tokens.extend(sum(map(known.__getitem__, units)) for units in group)
                group.clear()

            for text in batch.column(1):
                units = units_of(text.as_py())
                group.append(units)
                size += len(units)
                if size >= REMEMBERED // 4:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    text = text_of(text_col)
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = given.mapInArrow(count, schema_of(given, id="=id", n_bytes="long", n_tokens="long"))
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
