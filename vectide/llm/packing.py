"""Best-fit packing of token sequences by exact-complement hashing.

Which pieces share a sequence depends on lengths alone, so the plan is made on the histogram of lengths:
at most ``capacity`` counters, however many documents there are. An index has the single lengths, pairs and triples
by their sum. First each length, from the longest, consumes the combinations that fill its gap exactly, as often as
the counts of lengths left allow; what remains goes by best fit, and gaps that it leaves are looked up again. Every
piece then finds its place from its rank among the pieces of its length. Ranks come from per-partition counters, written with the pieces,
and prefix sums over (partition, length), so that a length which a third of all pieces have is never
gathered in one task.

Defined results: a null or empty text is the end token alone; a very long text is cut into pieces that each find
their own place; rows that repeat (also whole rows) are documents of their own; which of equal lengths stands where is
arbitrary; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .tokens import encoder, together

CAPACITY, END_ID = 4096, 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class SumIndex:
    """Pairs and triples of lengths by their sum: at most capacity**2 / 4 pairs (a >= b), and as triples for each sum the
    greatest lengths a that leave the sum of a pair."""

    def __init__(self, lengths: list[int], capacity: int):
        x = np.array(sorted(lengths, reverse=True), np.int16 if capacity < 1 << 15 else np.int32)
        up = x[::-1]
        # b from the largest that fits beside a
        below = [up[: np.searchsorted(up, min(int(a), capacity - int(a)), "right")] for a in x]
        a, b = np.repeat(x, [len(y) for y in below]), np.concatenate([*below, x[:0]])
        self.pair_at, (self.a, self.b) = self._by_sum(a, b, capacity)
        sums = np.flatnonzero(np.diff(self.pair_at)).astype(x.dtype)
        rests = [sums[: np.searchsorted(sums, min(2 * int(a), capacity - int(a)), "right")] for a in x]
        a, rest = np.repeat(x, [len(y) for y in rests]), np.concatenate([*rests, x[:0]])
        self.triple_at, (self.first, _) = self._by_sum(a, rest, capacity)

    @staticmethod
    def _by_sum(a: np.ndarray, b: np.ndarray, capacity: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        total = a.astype(np.int32) + b
        order = np.argsort(total, kind="stable")  # the greatest a first in each sum
        return np.searchsorted(total[order], np.arange(capacity + 2)), (a[order], b[order])

    def pair(self, total: int, counts: np.ndarray, most: int) -> tuple[int, int] | None:
        """The pair with the greatest length of at most ``most`` that counts allow."""
        if total <= 0:
            return None
        own = slice(self.pair_at[total], self.pair_at[total + 1])
        a, b = self.a[own], self.b[own]
        fits = np.flatnonzero((a <= most) & (counts[a] > (a == b)) & (counts[b] > 0))
        return (int(a[fits[0]]), int(b[fits[0]])) if len(fits) else None

    def triple(self, total: int, counts: np.ndarray) -> tuple[int, int, int] | None:
        own = self.first[self.triple_at[total] : self.triple_at[total + 1]]
        for a in own[counts[own] > 0].tolist():
            counts[a] -= 1
            found = self.pair(total - a, counts, a)
            counts[a] += 1
            if found:
                return a, *found
        return None


class _Planner:
    """Fills sequences of ``capacity`` from counts of lengths; everything goes by counts, never by piece."""

    def __init__(self, counts: dict[int, int], capacity: int, index: SumIndex, most: int = 3, exact: bool = True):
        self.capacity, self.index, self.most, self.exact = capacity, index, most, exact
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.none: set[int] = set()  # sums that nothing left adds up to; counts only fall
        self.patterns: list[tuple[int, tuple[int, ...]]] = []
        self.open: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        self.gaps: list[int] = []

    def _take(self, x: int, n: int) -> None:
        self.counts[x] -= n

    def _times(self, items: tuple[int, ...]) -> int:
        """How often the lengths left allow these items."""
        return min(int(self.counts[x]) // items.count(x) for x in set(items))

    def _complement(self, gap: int) -> tuple[int, ...] | None:
        """Up to ``most`` (one, two or three) lengths left that add up to gap; the largest lengths first."""
        if self.counts[gap]:
            return (gap,)
        if gap in self.none:
            return None
        found = self.index.pair(gap, self.counts, gap) if self.most > 1 else None
        if not found and self.most > 2:
            found = self.index.triple(gap, self.counts)
        if not found:
            self.none.add(gap)
        return found

    def _beside(self, length: int) -> tuple[int, ...] | None:
        """The exact complement of one piece of this length."""
        gap = self.capacity - length
        if not gap:
            return ()
        self.counts[length] -= 1
        known = gap in self.none
        found = self._complement(gap)
        if not known:
            self.none.discard(gap)  # the piece set aside could be part of it elsewhere
        self.counts[length] += 1
        return found

    def _shut(self, gap: int, n: int, items: tuple[int, ...]) -> None:
        """n sequences hold items and lack gap: fill exactly while lengths allow, leave the rest open."""
        while n and gap and (found := self._complement(gap)):
            k = min(n, self._times(found))
            for x in found:
                self._take(x, k)
            self.patterns.append((k, items + found))
            n -= k
        if not n:
            return
        if not gap:
            self.patterns.append((n, items))
            return
        if not self.open[gap]:
            insort(self.gaps, gap)
        self.open[gap].append((n, items))

    def _fill_exactly(self) -> None:
        """Each length, from the longest, with the combinations that fill its gap."""
        for length in range(self.capacity, 0, -1):
            while self.counts[length] and (found := self._beside(length)) is not None:
                items = (length, *found)
                k = self._times(items)
                for x in items:
                    self._take(x, k)
                self.patterns.append((k, items))

    def plan(self) -> list[tuple[int, tuple[int, ...]]]:
        """(how many sequences, lengths in order) for all sequences."""
        if self.exact:
            self._fill_exactly()
        for length in range(self.capacity, 0, -1):
            while n := int(self.counts[length]):
                at = bisect_left(self.gaps, length)
                if at < len(self.gaps):  # the tightest open sequence
                    gap = self.gaps[at]
                    had, items = self.open[gap].pop()
                    if not self.open[gap]:
                        self.gaps.pop(at)
                    k = min(n, had)
                    if had > k:
                        if not self.open[gap]:
                            insort(self.gaps, gap)
                        self.open[gap].append((had - k, items))
                    self._take(length, k)
                    self._shut(gap - length, k, (*items, length))
                    continue
                if 2 * length > self.capacity:
                    self._take(length, n)
                    self._shut(self.capacity - length, n, (length,))
                    continue
                # one beside its exact complement before sequences of equal lengths
                if found := self._beside(length):
                    items = (length, *found)
                    k = self._times(items)
                    for x in items:
                        self._take(x, k)
                    self.patterns.append((k, items))
                    continue
                most = self.capacity // length
                each, k = (most, n // most) if n >= most else (n, 1)
                self._take(length, each * k)
                self._shut(self.capacity - each * length, k, (length,) * each)
        for gap in self.gaps:
            self.patterns += self.open[gap]
        return self.patterns


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences for ``counts`` pieces of each length, as (number of sequences, lengths in them).

    Taking triples early can cost a later pair, and filling long pieces first can cost the short ones that others need:
    plans with complements of up to three, two and one lengths, before best fit and beside it, are made, and the one
    with the fewest sequences is taken.
    """
    index = SumIndex(list(counts), capacity)
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: list[tuple[int, tuple[int, ...]]] | None = None
    for exact in (True, False):
        for most in (3, 2, 1):
            plan = _Planner(counts, capacity, index, most, exact).plan()
            if best is None or sum(n for n, _ in plan) < sum(n for n, _ in best):
                best = plan
            if sum(n for n, _ in best) == least:
                return best
    return best


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of ranks."""
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for n, items in patterns:
        offset = 0
        for x in items:
            runs[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, the end id included, with a rank among the equal lengths of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer_path).ids_of, np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), chain.from_iterable(encode(x) for x in together(texts)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    n = len(piece) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = write_table(tokenize_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_sequences(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                first, start, at = runs[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = start[k] + rank[rows] - first[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
