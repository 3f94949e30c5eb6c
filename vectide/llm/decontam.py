"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, neighbouring numbers or names one placeholder. Windows of
``window`` template tokens are hashed, and the windows of documents and benchmark are joined on the hash, so that a
question with other parameters still matches. A window with more placeholders than words says little about its item:
it is hashed with the values of its slots and matches as it stands. Items shorter than a window are one window of their
own; those under ``shortest`` tokens match where they stand as a sentence or line of their own.

Joined windows are verified token by token, then slots are checked: along one alignment of an item, each of its values
must stand for one value of the document; a window that breaks what earlier ones say doesn't count. Windows of
alignments that differ by at most ``slip`` tokens count together, as a word more or less shifts what follows. A
document leaks an item if the windows left cover ``share`` of the item's template tokens, or ``enough`` of them.

The benchmark is cut into windows in Spark and only a filter of its hashes, of at most 2**30 bits whatever its size, is
broadcast: it spares most windows of documents the shuffle and the join decides about the rest. Documents are
scanned once. Equal texts are one text until the end, so a text that a third of all documents have costs no more.

Defined results: null and empty texts leak nothing, null and empty items aren't leaked; items of equal id and text are
one, null item_ids are items of their own by text; rows that repeat give rows that repeat; items that cover a document
equally are all reported; a very long text is looked at whole; an empty benchmark or table gives no rows; other columns
are ignored, or returned as they came.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, worker_cache, write_table

WINDOW, SHORTEST, SHARE, ENOUGH, SLIP = 8, 4, 0.5, 13, 3
#: Bits of the filter: for each window, and at most (as a power of two).
BITS_EACH, MOST_BITS = 256, 30

# Words for numbers, and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years kmh mph dollar dollars euro euros cent cents percent degree degrees watt watts kw volt volts ampere amperes joule joules newton newtons meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split()
)
NUM, UNIT, NAME, END = (np.uint64(x) for x in (1, 2, 3, 4))

_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*[%$€£]?")
_EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%$€£]+$")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")


def _hash(word: str) -> int:
    return max(16, xxhash.xxh64_intdigest(word, 11))


class _Pieces(dict):
    """Code of each piece between blanks; tables by code: token (0: none), value (hash of what a slot says), whether it starts with a capital, whether it ends a sentence."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, bool, bool]] = []  # those that the tables lack
        self.tables = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)]
        self.n = 0
        self[""] = self._add(0, 0, False, False)
        self["\n"] = self._add(0, 0, False, True)
        self[" "] = self._add(int(END), int(END), False, True)  # never a piece

    def _add(self, *row) -> int:
        self.rows.append(row)
        return len(self.rows) - 1 + self.n

    def of(self, pieces: list[str]) -> list[np.ndarray]:
        """The tables' entries of these pieces."""
        codes = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.rows:
            while len(self.tables[0]) < self.n + len(self.rows):
                self.tables = [np.concatenate((x, np.zeros(max(1024, len(x)), x.dtype))) for x in self.tables]
            for table, column in zip(self.tables, zip(*self.rows, strict=True), strict=True):
                table[self.n : self.n + len(self.rows)] = np.array(column, table.dtype)
            self.n += len(self.rows)
            self.rows = []
        return [x[codes] for x in self.tables]

    def __missing__(self, piece: str) -> int:
        end = False
        if piece.isalpha():
            core = piece
        elif piece[-1] in ",." and piece[:-1].isalpha():
            core, end = piece[:-1], piece[-1] == "."
        else:
            return self._odd(piece)
        low = core.lower()
        said = _hash(low)
        if low in NUMBER_WORDS:
            code = self._add(int(NUM), said, False, end)
        elif low in UNITS:
            code = self._add(int(UNIT), said, False, end)
        else:
            code = self._add(said, said, core[0].isupper() and core != "I", end)
        self[piece] = code
        return code

    def _odd(self, piece: str) -> int:
        """Not just letters."""
        core = _EDGES.sub("", piece)
        end = piece.rstrip("\"')]»”’")[-1:] in tuple(".!?:;")
        low = core.lower()
        if not core:
            code = self._add(0, 0, False, end)
        elif low in NUMBER_WORDS or _NUMBER.fullmatch(core):
            code = self._add(int(NUM), _hash(low), False, end)
        elif low in UNITS:
            code = self._add(int(UNIT), _hash(low), False, end)
        else:
            code = self._add(_hash(_DIGITS.sub("0", low)), _hash(low), core[0].isupper() and core != "I", end)
        self[piece] = code
        return code


#: Pieces a worker keeps at most.
MOST_PIECES = 400_000

_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT, _SENTENCE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _slot(piece: str) -> str:
    return _EDGES.sub("", piece).lower()


class Template:
    """Template tokens of some texts, one text after the other: tokens (placeholders are 1 to 3, the end of a text is END),
    values (hashes of what stands there), begins (whether a sentence or line begins there)."""

    def __init__(self, texts: list[str | None]):
        kept = worker_cache("decontam")
        pieces = kept.get("pieces")
        if pieces is None or len(pieces) > MOST_PIECES:
            pieces = kept["pieces"] = _Pieces()
        raw: list[str] = []
        for text in texts:
            if text:
                for blank in "\t\r\x0b\x0c\xa0":
                    if blank in text:
                        text = text.replace(blank, " ")
                raw += text.replace("\n", " \n ").split(" ")
            raw.append(" ")
        token, value, capital, end = pieces.of(raw)
        at = np.flatnonzero(token)
        # a capital makes a name unless a sentence starts there; pieces without a token pass the end of a sentence on
        last = np.maximum.accumulate(np.where((token != 0) | end, np.arange(len(end)), -1))
        before = np.where(at > 0, last[at - 1], -1)
        begins = (before < 0) | end[before]
        tokens = token[at]
        tokens[capital[at] & ~begins] = NAME
        # neighbouring numbers or names are one
        new = np.ones(len(at), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | ((tokens[1:] != NUM) & (tokens[1:] != NAME))
        self.heads = np.flatnonzero(new)
        place = np.arange(len(at)) - self.heads[np.cumsum(new) - 1]
        self.tokens, self.begins = tokens[self.heads], begins[self.heads]
        self.values = np.add.reduceat(value[at] * _FACTORS[place % 64], self.heads)
        self.raw, self.at = raw, at

    def said(self, k: int) -> str:
        """What stands at token k."""
        stop = self.heads[k + 1] if k + 1 < len(self.heads) else len(self.at)
        return " ".join(_slot(self.raw[i]) for i in self.at[self.heads[k] : stop].tolist())

    def slots(self, first: int, size: int) -> list[str]:
        return [self.said(first + int(k)) for k in np.flatnonzero(self.tokens[first : first + size] < END)]

    def hashes(self, size: int, shortest: int) -> np.ndarray:
        """A hash for each window of ``size`` tokens; 0 where none counts."""
        n = len(self.tokens) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if size < shortest:
            at = np.flatnonzero(self.begins[:n] & (np.append(self.begins[1:], True) | np.append(self.tokens[1:] == END, True))[size - 1 :])
            got = np.zeros(n, np.uint64)
            got[at] = _window_hashes(self.values, at, size) ^ _SENTENCE
            return got
        got = _window_hashes(self.tokens, slice(0, n), size)
        slots = np.cumsum(self.tokens < END, dtype=np.int32)
        few = 2 * (slots[size - 1 :] - np.concatenate(([0], slots[: n - 1]))) > size
        at = np.flatnonzero(few)
        got[at] = _window_hashes(self.values, at, size) ^ _EXACT
        return got


def _window_hashes(tokens: np.ndarray, at: slice | np.ndarray, size: int) -> np.ndarray:
    """A hash for the runs of ``size`` tokens that begin at these places: a range, or some."""
    if isinstance(at, slice):
        got = tokens[at] * _FACTORS[0]
        term = np.empty_like(got)
        for j in range(1, size):
            np.multiply(tokens[at.start + j : at.stop + j], _FACTORS[j % 64], out=term)
            got += term
    else:
        got = np.zeros(len(at), np.uint64)
        for j in range(size):
            got += tokens[at + j] * _FACTORS[j % 64]
    got ^= got >> np.uint64(31)
    got *= np.uint64(0x9E3779B97F4A7C15)
    got ^= got >> np.uint64(29)
    return got


WINDOWS = "item long, item_id long, item_tokens long, size int, h long, q long, tokens array<long>, slots array<string>"
HITS = "k1 long, k2 int, size int, h long, p long, tokens array<long>, slots array<string>"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def item_windows(benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """The windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Template([text])
                n = len(own.tokens) - 1  # without the end
                if n:
                    size = min(window, n)
                    signed = own.tokens.view(np.int64)
                    for q, h in enumerate(own.hashes(size, shortest)[: n - size + 1].view(np.int64).tolist()):
                        if h:
                            rows.append((item, item_id, n, size, h, q, signed[q : q + size].tolist(), own.slots(q, size)))
            yield _table(rows, WINDOWS)

    item_id, text = F.col("item_id").cast("long"), F.col("text").cast("string")
    items = benchmark.select(item_id.alias("item_id"), text.alias("text")).where("text <> ''").distinct()
    return items.select(F.xxhash64(F.coalesce(item_id.cast("string"), F.lit("\x00")), "text").alias("item"), "item_id", "text").mapInArrow(run, WINDOWS)


class Filter:
    """Bits that the hashes of the benchmark's windows set: two for each, by its first and its last bits."""

    def __init__(self, windows: DataFrame):
        n = windows.select("h").distinct().count()
        self.log = min(MOST_BITS, max(16, (BITS_EACH * n - 1).bit_length())) if n else 16
        self.bits = np.zeros(1 << (self.log - 3), np.uint8)
        ends = windows.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - self.log), F.col("h").bitwiseAND(F.lit((1 << self.log) - 1)))).alias("x")).distinct()
        # at most 2**(MOST_BITS - 16) rows of at most 2**16 numbers, a partition at a time
        for row in ends.groupBy(F.shiftright("x", 16).alias("chunk")).agg(F.collect_list(F.col("x").bitwiseAND(F.lit(0xFFFF)).cast("int")).alias("low")).toLocalIterator():
            x = (row["chunk"] << 16) + np.array(row["low"], np.int64)
            np.bitwise_or.at(self.bits, x >> 3, (1 << (x & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        def at(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.int64)
            return (self.bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1

        found = np.flatnonzero(at(h >> np.uint64(64 - self.log)))
        return found[at(h[found] & np.uint64((1 << self.log) - 1)).astype(bool)]


#: Characters that are looked at together.
TOGETHER = 1 << 20


def _some(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts some at a time, with the row of the first."""
    held: list[str | None] = []
    first, size = 0, 0
    for row, x in enumerate(column):
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= TOGETHER:
            yield first, held
            held, first, size = [], row + 1, 0
    if held:
        yield first, held


def _key(text="text"):
    """Two columns that stand for a text."""
    text = F.col(text).cast("string")
    return F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")


def window_hits(docs: DataFrame, sizes: list[int], shared, shortest: int = SHORTEST) -> DataFrame:
    """Windows of documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, texts in _some(batch.column(2)):
                own = Template(texts)
                ends = np.flatnonzero(own.tokens == END)
                starts = np.concatenate(([0], ends[:-1] + 1))
                signed = own.tokens.view(np.int64)
                rows: list[tuple] = []
                for size in sizes:
                    h = own.hashes(size, shortest)
                    for p in passes.has(h).tolist():
                        doc = int(np.searchsorted(ends, p))
                        if h[p] and p + size <= ends[doc]:
                            rows.append((int(k1[row + doc]), int(k2[row + doc]), size, int(h[p].view(np.int64)), p - int(starts[doc]), signed[p : p + size].tolist(), own.slots(p, size)))
                yield _table(rows, HITS)

    return docs.where("text IS NOT NULL").select(*_key(), F.col("text").cast("string").alias("text")).mapInArrow(run, HITS)


class Judge:
    """Follows the joined windows of one text and item, in order of their alignments."""

    def __init__(self, slip: int = SLIP):
        self.slip, self.near, self.shift, self.best = slip, deque(), None, (0, 0)

    def add(self, shift: int, q: int, size: int, tokens: list[int], said: list[str], there: list[str]) -> None:
        """A window of the item at q, where said stands in its slots and there in the document's."""
        if shift != self.shift:
            self.close()
            self.shift, self.values, self.covered, self.changed = shift, {}, set(), set()
        pairs = list(zip(said, there, strict=True))
        own = dict(pairs)
        if len(own) == len(set(pairs)) and all(self.values.get(a, b) == b for a, b in pairs):
            self.values |= own
            self.covered.update(range(q, q + size))
            slots = [q + k for k, x in enumerate(tokens) if 0 < x < 4]
            self.changed.update(k for k, (a, b) in zip(slots, pairs, strict=True) if a != b)

    def close(self) -> None:
        if self.shift is None:
            return
        self.near.append((self.shift, self.covered, self.changed))
        while self.near[0][0] < self.shift - self.slip:
            self.near.popleft()
        covered, changed = (set().union(*(x[k] for x in self.near)) for k in (1, 2))
        self.best = max(self.best, (len(covered), -len(changed)))


JUDGED = "k1 long, k2 int, item_id long, covered long, item_tokens long, changed_slots long"


def leaked_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, enough: int = ENOUGH, window: int = WINDOW, shortest: int = SHORTEST, slip: int = SLIP) -> DataFrame:
    """k1, k2 (see ``_key``), item_id, covered, item_tokens, changed_slots for each text and item that it leaks."""
    spark = docs.sparkSession
    windows = write_table(item_windows(benchmark, window, shortest), "decontam-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window``
    shared = spark.sparkContext.broadcast(Filter(windows))
    # equal texts have equal hits: they are one before the shuffle
    hits = window_hits(docs, sizes, shared, shortest).groupBy("k1", "k2", "size", "p").agg(F.first("h").alias("h"), F.first("tokens").alias("tokens"), F.first("slots").alias("slots"))
    hits = write_table(hits, "decontam-hits")
    said = windows.withColumnRenamed("slots", "said").withColumnRenamed("tokens", "own")
    placeholders = F.size(F.filter("tokens", lambda x: (x > 0) & (x < 4)))
    exact = (F.col("size") < shortest) | (2 * placeholders > F.col("size"))
    met = hits.join(said, ["h", "size"]).where((F.col("tokens") == F.col("own")) & (~exact | (F.col("slots") == F.col("said"))))
    dealt = met.select("k1", "k2", "item", (F.col("p") - F.col("q")).alias("shift"), "q", "item_id", "item_tokens", "size", "tokens", "said", "slots")
    dealt = dealt.repartition(parallelism(spark), "k1", "k2", "item").sortWithinPartitions("k1", "k2", "item", "shift", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, judge, about = None, None, None

        def verdict() -> list[tuple]:
            judge.close()
            n, changed = judge.best
            return [(now[0], now[1], about[0], n, about[1], -changed)] if n >= min(enough, share * about[1]) else []

        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, item, shift, q, item_id, n, size, tokens, said, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (k1, k2, item):
                    if now is not None:
                        rows += verdict()
                    now, judge, about = (k1, k2, item), Judge(slip), (item_id, n)
                judge.add(shift, q, size, tokens, said, there)
            yield _table(rows, JUDGED)
        if now is not None:
            yield _table(verdict(), JUDGED)

    return write_table(dealt.mapInArrow(run, JUDGED), "decontam-leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, item_id, covered, item_tokens, changed_slots: a row for each document and item that it leaks."""
    found = leaked_items(docs, benchmark, **params)
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *_key())
    return keyed.join(found, ["k1", "k2"]).select("doc_id", "item_id", "covered", "item_tokens", "changed_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents that leak no item; all columns of ``docs``."""
    found = leaked_items(docs, benchmark, **params).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = _key()
    return docs.withColumns({"__k1": k1, "__k2": k2}).join(found, ["__k1", "__k2"], "left_anti").select(*docs.columns)
