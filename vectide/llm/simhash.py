"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit votes over 3-word shingles. Every two distinct fingerprints are compared by
exclusive-or and bit count, tile by tile in numpy; tile pairs whose population counts differ beyond the
radius are skipped. Population counts are taken for each 16-bit quarter: the distance of two fingerprints
is at least the sum of the differences of their quarters' counts. Blocks of fingerprints go by those
counts, so most block pairs and tile pairs are skipped.

No fingerprints, blocks, links or components are gathered on the driver: it sees the histogram of quarter
counts (at most 17**4 rows by construction). Block pairs come from a join of neighbouring quarter counts, of
which each has at most 129 within a radius of 3. A block pair gives a spanning forest of its links, not all of
them. Components come from alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and link like any
other; rows that repeat have equal results; a component whose doc_ids are all null has a null id; a very long
text is hashed shingle by shingle in one task; of equal doc_ids either row may stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, worker_cache, write_table

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a block (a task holds two) and in a tile (a task holds one tile pair's matrix).
BLOCK, TILE = 32768, 1024
#: Pairs of blocks that a task is meant to compare, and tasks at most.
PAIRS_OF_A_TASK, MOST_TASKS = 4, 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: 1 - shingle - 1] + 1)).tolist()
        slices = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(seed)), np.uint64, len(slices))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64-bit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            got = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least distance that counts between these bounds allow."""
    return np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum(axis=-1)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over the links a-b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (differ := x != y).sum() == 0:
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(label, up := label[label]):
            label = up


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Sorted by quarter counts, cut into tiles, with each tile's bounds."""
    q = _quarters(fps)
    order = np.lexsort((fps, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    fps, q = fps[order], q[order]
    cuts = [(i, min(i + TILE, len(fps))) for i in range(0, len(fps), TILE)]
    return fps, cuts, np.array([q[a:b].min(0) for a, b in cuts]), np.array([q[a:b].max(0) for a, b in cuts])


def links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``left`` and ``right`` (None: within ``left``), as fingerprints and their roots."""
    a, cuts_a, low_a, high_a = _tiles(left)
    b, cuts_b, low_b, high_b = (a, cuts_a, low_a, high_a) if right is None else _tiles(right)
    n = len(a) + (0 if right is None else len(b))
    label = np.arange(n)
    for i, (i0, i1) in enumerate(cuts_a):
        near = np.flatnonzero(_apart(low_a[i], high_a[i], low_b, high_b) <= radius)
        for j in near[near >= i] if right is None else near:
            j0, j1 = cuts_b[j]
            x, y = np.nonzero(np.bitwise_count(a[i0:i1, None] ^ b[None, j0:j1]) <= radius)
            if right is None and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                step = _forest(n, label[x + i0], label[y + j0 + (0 if right is None else len(a))])
                label = step[label]
    nodes = a if right is None else np.concatenate((a, b))
    moved = np.flatnonzero(label != np.arange(n))
    return nodes[moved], nodes[label[moved]]


def _cells(counts: list[tuple[int, int]], block: int) -> list[tuple[int, int, int]]:
    """(quarter counts, first block, number of blocks) for (quarter counts, fingerprints): neighbours in order share a
    block up to ``block`` fingerprints, counts with more are spread over some."""
    rows, at, room = [], 0, block
    for p, n in sorted(counts, key=lambda x: [x[0] // 17**k % 17 for k in range(4)]):
        if n > room and room < block:
            at, room = at + 1, block
        spans = -(-n // block)
        rows.append((p, at, spans))
        room -= n
        if spans > 1 or room <= 0:
            at, room = at + spans, block
    return rows


def _near(cells: DataFrame, radius: int) -> DataFrame:
    """i, j (i <= j): blocks with quarter counts that differ by ``radius`` at most in all. ``cells`` has profile, first, spans."""
    # a move and its opposite find the same pairs
    moves = [m for m in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius and m >= (0, 0, 0, 0)]
    placed = cells.select("profile", F.explode(F.expr("sequence(first, first + spans - 1)")).alias("block"))
    quarter = lambda k: F.pmod(F.floor(F.col("profile") / 17**k), F.lit(17)).cast("int")
    moved = placed.select(F.col("block").alias("i"), "profile", F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"m{k}") for k, x in enumerate(m)]) for m in moves])).alias("m"))
    fits = reduce(lambda a, b: a & b, [(quarter(k) + F.col(f"m.m{k}")).between(0, 16) for k in range(4)])
    left = moved.where(fits).select("i", (F.col("profile") + sum(F.col(f"m.m{k}") * 17**k for k in range(4))).alias("profile"))
    met = left.join(placed.select("profile", F.col("block").alias("j")), "profile")
    return met.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def forest_edges(unique: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links u-v (u < v as signed numbers) that connect whatever is within ``radius``."""
    spark = unique.sparkSession
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    profile = sum((quarter(k) * 17**k for k in range(1, 4)), quarter(0))
    keyed = unique.withColumn("profile", profile.cast("int"))
    counts = [(r["profile"], r["n"]) for r in keyed.groupBy("profile").agg(F.count("*").alias("n")).collect()]  # at most 17**4 rows, whatever the input
    cells = spark.createDataFrame(_cells(counts, block), "profile int, first int, spans int")
    number = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("spans")).cast("int")
    # the cells are at most 17**4 rows too
    blocks = write_table(keyed.join(F.broadcast(cells), "profile").select(number.alias("block"), "fp").groupBy("block").agg(F.collect_list("fp").alias("fps")), "simhash-blocks")
    pairs = write_table(_near(cells, radius), "simhash-pairs")

    def compare(table: pa.Table) -> pa.Table:
        fps = [np.asarray(x.values).view(np.uint64) for chunk in table.column("fps").chunks for x in chunk]
        if len(fps) == 1 and table["i"][0] != table["j"][0]:  # the other block is empty
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        u, v = links(fps[0], fps[1] if len(fps) > 1 else None, radius)
        u, v = u.view(np.int64), v.view(np.int64)
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    wanted = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # partitions by the number of pairs: their work isn't told by their bytes
    tasks = min(max(parallelism(spark), pairs.count() // PAIRS_OF_A_TASK), MOST_TASKS)
    sides = blocks.join(wanted, "block").select("i", "j", "fps").repartition(tasks, "i", "j")
    return sides.groupBy("i", "j").applyInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of ``edges`` (u, v) reaches.

    Large-star links each node's larger neighbours to the smallest of its neighbourhood, small-star its smaller
    ones, until nothing changes; every round is written out.
    """
    edges = write_table(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "cc")
    for _ in range(most_rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").where("u < v").distinct()
        new = write_table(small, "cc")
        # unchanged: the same set of links
        stars = new.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u"))
        bad = stars.where("n > 1").limit(1).count() or new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        edges = new
        if not bad:
            break
    else:
        raise RuntimeError("components didn't settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select("u", "u").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    fps = write_table(fingerprints(docs), "simhash-fps")
    # the smallest doc_id of each fingerprint: combined before the shuffle, so a hot fingerprint is one row a task
    unique = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-unique")
    roots = components(forest_edges(unique.select("fp"), radius))
    linked = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    table = write_table(linked.join(ids, "root").select("fp", "component_id"), "simhash-ids")
    return fps.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the smallest doc_id (nulls last); all columns of ``docs``.

    The rows are written with their fingerprint and a number of their own, so that repeated rows can be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker_cache("simhash")
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            got = np.array([fingerprint(x.as_py()) for x in texts], dtype=np.uint64)
            names = [*batch.schema.names, "__fp", "__row"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64)), pa.array(np.arange(at, at + batch.num_rows))], names=names)
            at += batch.num_rows

    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType()), T.StructField("__row", T.LongType())])
    table = write_table(docs.mapInArrow(run, schema), "simhash-docs")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    unique = write_table(table.groupBy(F.col("__fp").alias("fp")).agg(F.min(order).alias("best")), "simhash-unique")
    roots = components(forest_edges(unique.select("fp"), radius))
    linked = unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    winners = linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return table.join(winners, "__row", "left_semi").select(*docs.columns)
