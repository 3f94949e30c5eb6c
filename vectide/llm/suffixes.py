"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte goes that a string of ``length`` bytes covers which also starts earlier, by (doc_id, start). The
strings of a text are its windows. Two equal windows have the same smallest hash among their ``gram``-byte
strings, and have it first at the same place, so windows are dealt into suffix buckets by that hash, as runs of
neighbouring windows that have it at one place: at most length - gram + 1 windows, so a run has a bounded size and no
window twice. Buckets never need each other.

1. Hashes that only one place has can't repeat: they are counted, and only the others' runs go on. Copies of a
   whole text count as one place.
2. Equal runs are combined within a part of a text, and before and after the shuffle: all but the earliest repeat in
   full. A passage or copy that a third of all documents have is one run from there on, and so is a period of a text.
3. A bucket with more than ``hot`` different runs is split by the next smallest hash of each window, which equal
   windows share too; its runs are combined anew, and so on until all buckets are small.
4. Blocks of whole buckets are sorted one at a time in bounded memory: suffixes by their first ``cover`` bytes, ties
   by the ranks of a difference-cover sample, which are computed first. Neighbours in that order that share
   ``length`` bytes are the same string.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; very long texts are taken in
parts; a null doc_id comes first; rows of one doc_id are told apart by their text, and rows that repeat whole get equal
results (neither is the earlier); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, worker_cache, write_table

LENGTH, GRAM, COVER, HOT = 100, 32, 32, 8_000
#: Bytes of runs that are sorted together, and of texts that are hashed together.
BLOCK, CHUNK = 2 << 20, 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash, never 0, of each string of ``gram`` bytes."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, (len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def minimizers(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of ``gram`` bytes in ``data`` (texts that end at ``ends``); for each window start the smallest
    one, 0 where no window fits its text; and the places of those that are smallest in some window."""
    width = length - gram + 1
    h = _gram_hashes(data, gram)
    least = _sliding(h, width, np.minimum)
    if not len(least):
        return h, least, np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    mark = np.zeros(len(data) + 1, np.int32)  # a window must start at or before its text's end - length
    fits = ends - starts >= length
    np.add.at(mark, starts[fits], 1)
    np.add.at(mark, ends[fits] - length + 1, -1)
    least = np.where(np.cumsum(mark)[: len(least)] > 0, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    return h, least, np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), width, np.maximum) == h)


def _per_text(h: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct smallest hashes of each text: number of the text, hash, how many places have it."""
    doc = np.searchsorted(ends, at, "right")
    order = np.lexsort((h[at], doc))
    m, doc = h[at][order], doc[order]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], m[heads], np.diff(np.append(heads, len(m)))


def _texts(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch's texts some at a time, long ones in parts that overlap by less than a window: row and offset of each part, the parts' bytes, and their ends."""
    rows, bases, parts, size = [], [], [], 0
    for row, x in enumerate(batch.column(column)):
        data = memoryview(x.as_buffer())
        step = len(data) if len(data) <= 4 * CHUNK else CHUNK
        for at in range(0, max(1, len(data) - length + 1), max(1, step)):
            rows.append(row)
            bases.append(at)
            parts.append(data[at : at + step + length - 1])
            size += len(parts[-1])
            if size >= CHUNK:
                yield np.array(rows), np.array(bases), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(y) for y in parts])
                rows, bases, parts, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(bases), np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(y) for y in parts])


def _hash_places(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """t, m, twice: the smallest hashes of each text's windows, and whether the text has m twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("suffixes")
        for batch in batches:
            t, n_bytes = np.asarray(batch.column(0)), np.array([x.as_buffer().size for x in batch.column(1)])
            for rows, _, data, ends in _texts(batch, 1, length):
                h, _, at = minimizers(data, ends, length, gram)
                doc, m, n = _per_text(h, at, ends)
                row = rows[doc]
                # the parts of a long text aren't compared here: all its hashes go on
                yield pa.RecordBatch.from_arrays([pa.array(t[row]), pa.array(m.view(np.int64)), pa.array((n > 1) | (n_bytes[row] > 4 * CHUNK))], names=["t", "m", "twice"])

    return docs.select("t", "data").mapInArrow(run, "t long, m long, twice boolean")


RUN = "m long, d long, t long, start long, stop long, run binary"


def _run_batch(m: np.ndarray, d: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray, parts: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(d), pa.array(t), pa.array(start), pa.array(stop), pa.array(parts, pa.binary())], names=[x.split()[0] for x in RUN.split(", ")])


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, first window and end of the windows of each run, and whether its text has the hash in two places."""
    h, least, at = minimizers(data, ends, length, gram)
    new = np.diff(least, prepend=np.uint64(0)) != 0
    new[1:] |= h[: max(0, len(least) - 1)] == least[:-1]  # the window before began with the smallest
    starts = np.concatenate(([0], ends[:-1]))
    new[starts[starts < len(least)]] = True  # a run stops at the end of its text
    cut = np.flatnonzero(new)
    doc, m = np.searchsorted(ends, cut, "right"), least[cut]
    again, hash_, n = _per_text(h, at, ends)
    again, hash_ = again[n > 1], hash_[n > 1]
    twice = np.zeros(len(cut), bool)
    for i in np.unique(again):
        rows, own = slice(*np.searchsorted(doc, (i, i + 1))), slice(*np.searchsorted(again, (i, i + 1)))
        twice[rows] = np.isin(m[rows], hash_[own])
    return doc, m, cut, np.append(cut[1:], len(least)), twice


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows with one of the hashes in ``wanted``; equal runs of a part of a text are one, the others' bytes are
    rows without a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, wanted = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            for part_rows, bases, data, ends in _texts(batch, 2, length):
                doc, m, cut, stop, twice = runs_of(data, ends, length, gram)
                keep = np.zeros(len(cut), bool)
                for i in np.unique(doc):
                    rows = slice(*np.searchsorted(doc, (i, i + 1)))
                    keep[rows] = np.isin(m[rows], np.asarray(wanted[int(part_rows[i])].values).view(np.uint64))
                keep &= m != 0
                doc, m, cut, stop, twice = doc[keep], m[keep], cut[keep], stop[keep] + length - 1, twice[keep]
                raw, seen, parts, later = data.tobytes(), set(), [], np.zeros(len(cut), bool)
                for k, (x, y, check, i) in enumerate(zip(cut.tolist(), stop.tolist(), twice.tolist(), doc.tolist(), strict=True)):
                    part = raw[x:y]
                    if check and (i, part) in seen:
                        later[k] = True
                        continue
                    if check:
                        seen.add((i, part))
                    parts.append(part)
                starts = np.concatenate(([0], ends[:-1]))
                place = lambda i, x: x - starts[i] + bases[i]
                rows = part_rows[doc]
                if later.any():
                    g, a, b = doc[later], cut[later], stop[later]
                    head = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (a[1:] > b[:-1]))))
                    g, a, b = g[head], a[head], np.maximum.reduceat(b, head)
                    yield _run_batch(np.zeros(len(g), np.int64), d[part_rows[g]], t[part_rows[g]], place(g, a), place(g, b), [None] * len(g))
                doc, rows, first = doc[~later], rows[~later], ~later
                yield _run_batch(m[first], d[rows], t[rows], place(doc, cut[first]), place(doc, stop[first]), parts)

    return docs.select("d", "t", "data", "wanted").mapInArrow(run, RUN)


_MIX = np.uint64(0xD6E8FEB86659FD93)


def _split(members: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs dealt anew by the smallest hash of each window above ``last``."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                m, last, d, t, start = (np.asarray(part.column(k)) for k in range(5))
                runs = part.column(5).to_pylist()
                sizes = np.array([len(x) for x in runs], np.int64)
                first = np.cumsum(sizes) - sizes
                h = _gram_hashes(np.frombuffer(b"".join(runs), np.uint8), gram)
                owner = np.repeat(np.arange(len(runs)), sizes - length + 1)
                off = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
                own = np.lib.stride_tricks.sliding_window_view(h, width)[first[owner] + off]
                none = np.uint64(2**64 - 1)
                following = np.where(own > last.view(np.uint64)[owner, None], own, none).min(1)
                cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (following[1:] != following[:-1]))))
                o, x, y, f = owner[cut], off[cut], off[np.append(cut[1:], len(owner)) - 1] + length, following[cut]
                mixed = (m.view(np.uint64)[o] ^ (f * _MIX)) * _MIX
                mixed ^= mixed >> np.uint64(32)
                parts = [runs[i][a:b] for i, a, b in zip(o.tolist(), x.tolist(), y.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(f.view(np.int64)), pa.array(d[o]), pa.array(t[o]), pa.array(start[o] + x), pa.array(parts, pa.binary())], names=["m", "last", "d", "t", "start", "run"])

    return members.select("m", "last", "d", "t", "start", "run").mapInArrow(run, "m long, last long, d long, t long, start long, run binary")


@lru_cache(4)
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues such that every difference modulo v is one of two of them."""
    chosen, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda x: len({(x - y) % v for y in chosen} & missing | {(y - x) % v for y in chosen} & missing))
        chosen.append(best)
        missing -= {(best - y) % v for y in chosen} | {(y - best) % v for y in chosen}
    return tuple(sorted(chosen))


@lru_cache(4)
def _shifts(v: int) -> np.ndarray:
    """[i, j]: the least k for which i + k and j + k are both in the cover."""
    cover = set(difference_cover(v))
    return np.array([[next(k for k in range(v) if (i + k) % v in cover and (j + k) % v in cover) for j in range(v)] for i in range(v)], np.int64)


def sort_suffixes(data: np.ndarray, at: np.ndarray, length: int = LENGTH, v: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in an order that brings equal strings of ``length`` bytes together, and where each differs from the one before."""
    words = -(-length // 8)
    text = np.concatenate((data, np.zeros(8 * words + 2 * v + 16, np.uint8)))
    n = len(data) + 8 * words + 2 * v
    word = np.empty(n, np.uint64)
    for r in range(8):
        got = text[r : r + (n - r + 7) // 8 * 8].view(">u8")
        word[r::8] = got[: len(word[r::8])]
    # ranks of the cover sample: by ``length`` bytes and some
    sample = np.flatnonzero(np.isin(np.arange(len(data) + v) % v, difference_cover(v)))
    order = sample[np.lexsort([word[sample + 8 * k] for k in reversed(range(words))])]
    new = np.zeros(len(order), bool)
    for k in range(words):
        new[1:] |= word[order[1:] + 8 * k] != word[order[:-1] + 8 * k]
    rank = np.zeros(len(data) + v, np.int64)
    rank[order] = np.cumsum(new)
    # by the first v bytes
    keys = [word[at + 8 * k] for k in range(v // 8)]
    at = at[np.lexsort(keys[::-1])]
    group = np.zeros(len(at), np.int64)
    for k in range(v // 8):
        group[1:] |= word[at[1:] + 8 * k] != word[at[:-1] + 8 * k]
    group = np.cumsum(group)
    # ties: each group is split around one of its members, by the sample's ranks, until its members are equal
    shifts, live = _shifts(v), np.arange(len(at))
    while len(live):
        g = group[live]
        head = np.flatnonzero(np.diff(g, prepend=-1))
        size = np.diff(np.append(head, len(g)))
        many = np.repeat(size > 1, size)
        live, g = live[many], g[many]
        if not len(live):
            break
        head = np.flatnonzero(np.diff(g, prepend=-1))
        size = np.diff(np.append(head, len(g)))
        p, q = at[live], np.repeat(at[live[head + size // 2]], size)
        k = shifts[p % v, q % v]
        side = np.sign(rank[p + k] - rank[q + k])
        order = np.lexsort((side, g))
        at[live], side = p[order], side[order]
        base = np.repeat(live[head], size)  # a group's number becomes the place of its first member
        low, same = (np.repeat(np.add.reduceat((side == x).astype(np.int64), head), size) for x in (-1, 0))
        group[live] = base + np.where(side < 0, 0, np.where(side == 0, low, low + same))
        live = live[side != 0]
    # equal strings are neighbours now
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = False
        for k in [*range(0, length - 7, 8), length - 8]:
            new[1:] |= word[at[1:] + k] != word[at[:-1] + k]
    return at, new


def _spans(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of the last window of each run of set flags."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length


def repeated_in_block(d: np.ndarray, t: np.ndarray, start: np.ndarray, runs: list[bytes], length: int = LENGTH, v: int = COVER) -> list[tuple[int, int, int]]:
    """(run, from, to) in each run's own bytes: windows that start earlier in the block."""
    sizes = np.array([len(x) for x in runs], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    data = np.frombuffer(b"".join(runs), np.uint8)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(runs)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
    at, new = sort_suffixes(data, at, length, v)
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=len(at))[group] > 1
    at, group = at[many], group[many]
    owner = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((start[owner] + at - first[owner], t[owner], d[owner], group))
    at, group = at[order], group[order]
    later = np.zeros(len(at), bool)
    later[1:] = group[1:] == group[:-1]
    flags = np.zeros(len(data) + 1, bool)
    flags[at[later]] = True  # windows of different runs aren't neighbours: a run's last start is length - 1 before its end
    a, b = _spans(flags, length)
    own = np.searchsorted(first, a, "right") - 1
    return list(zip(own.tolist(), (a - first[own]).tolist(), (b - first[own]).tolist(), strict=True))


SPAN = "d long, t long, a long, b long"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["d", "t", "a", "b"])


def _sorted_blocks(members: DataFrame, length: int, v: int) -> DataFrame:
    """Spans of windows that start earlier in their bucket; whole buckets are sorted some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sort() -> pa.RecordBatch:
            held[:] = {r[1:4]: r for r in held}.values()  # repeated rows of a document are one
            d, t, start = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
            return _span_batch([(int(d[i]), int(t[i]), int(start[i]) + a, int(start[i]) + b) for i, a, b in repeated_in_block(d, t, start, [r[4] for r in held], length, v)])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield sort()

    return members.select("m", "d", "t", "start", "run").repartition(parallelism(members.sparkSession), "m").sortWithinPartitions("m").mapInArrow(run, SPAN)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, v: int = COVER, hot: int = HOT) -> DataFrame:
    """d, t, a, b: byte spans of the text t of document d (see ``_keyed``) that are repeated; they can overlap."""
    places = write_table(_hash_places(docs.where(F.col("n") >= length), length, gram), "suffix-places")
    again = places.groupBy("m").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("twice").alias("twice")).where("t0 <> t1 OR twice").select("m")
    wanted = write_table(places.join(again, "m", "left_semi").groupBy("t").agg(F.collect_set("m").alias("wanted")), "suffix-wanted")
    copies = write_table(docs.where(F.col("n") >= length).groupBy("t", "n").agg(F.min("d").alias("d")), "suffix-copies")
    chosen = wanted.join(copies, "t").select("t", "d", "wanted")
    runs = write_table(_runs(docs.join(chosen, ["t", "d"]), length, gram), "suffix-runs")
    whole = docs.join(copies.withColumnRenamed("d", "d0"), ["t", "n"]).where("d > d0").select("d", "t", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))
    spans = [whole, runs.where("run IS NULL").select("d", "t", F.col("start").alias("a"), F.col("stop").alias("b"))]
    members = runs.where("run IS NOT NULL").select("m", F.col("m").alias("last"), "d", "t", "start", "run")
    for level in range(length - gram + 1):  # a window has no more hashes
        members = members.withColumn("h", F.xxhash64("run")).withColumn("size", F.octet_length("run"))
        earliest = members.groupBy("m", "h", "size").agg(F.min(F.struct("d", "t", "start")).alias("first"))
        is_first = F.struct("d", "t", "start") == F.col("first")
        placed = members.join(earliest, ["m", "h", "size"]).select("m", "last", "d", "t", "start", "size", is_first.alias("is_first"), F.when(is_first, F.col("run")).alias("run"))
        placed = write_table(placed, "suffix-first")
        spans.append(placed.where(~F.col("is_first")).select("d", "t", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
        # a run has no window twice, so a bucket with one run has no repeats
        buckets = write_table(placed.where("is_first").groupBy("m").agg(F.count("*").alias("k")).where("k > 1"), "suffix-buckets")
        of = lambda p, placed=placed, buckets=buckets: placed.where("is_first").join(buckets.where(p).select("m"), "m", "left_semi")
        large = F.col("k") > hot
        if level == length - gram or buckets.where(large).isEmpty():
            spans.append(_sorted_blocks(of(F.lit(True)), length, v))
            break
        spans.append(_sorted_blocks(of(~large), length, v))
        members = write_table(_split(of(large), length, gram), "suffix-split")
    return reduce(DataFrame.union, spans)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id in order, null first), t (hash of the text), n (bytes), data."""
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    return df.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("data").alias("t"), F.octet_length("data").alias("n"), "data")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, **params) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and kept (the bytes left) if asked for."""
    docs = _keyed(docs)
    spans = write_table(repeated_spans(docs, length, **params).groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (doc_id, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                data = memoryview(batch.column(1)[i].as_buffer())
                n, parts, removed, at, count = len(data), [], 0, 0, 0
                if found.is_valid:
                    a, b = (np.asarray(found.values.field(k)) for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    end = -1
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if x > end:
                            parts.append(data[at:x])
                            count += 1
                            removed += y - x
                        elif y > end:
                            removed += y - end
                        end = max(end, y)
                        at = end
                kept = b"".join([*parts, data[at:]])
                rows.append((doc_id, n, removed, count, hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.join(spans, ["d", "t"], "left").select("doc_id", "data", "spans").mapInArrow(run, schema)


#: The same in SQL, for tables that one machine holds: every window in hexadecimal, the earliest of equal ones kept.
SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, dense_rank() OVER (ORDER BY coalesce(doc_id, -9223372036854775808), coalesce(text, '')) o, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT rid, o, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) m FROM (SELECT rid, o, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) i FROM d)),
f AS (SELECT m, min({{'o': o, 'i': i}}) f FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) p FROM w JOIN f USING (m) WHERE o > f.o OR (o = f.o AND i > f.i)),
g AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) g FROM r),
s AS (SELECT rid, min(i) a, max(i) + {LENGTH} b FROM g GROUP BY rid, g),
e AS (SELECT rid, a, b FROM s UNION ALL SELECT rid, length(h) // 2, length(h) // 2 FROM d),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a, b), 0) c FROM e)
SELECT d.doc_id, any_value(length(h) // 2)::BIGINT n_bytes, sum(b - a)::BIGINT n_removed, (count(*) - 1)::BIGINT n_spans, sha256(unhex(string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a, b))) kept_sha256
FROM k JOIN d USING (rid) GROUP BY d.rid, d.doc_id
"""
