"""Top-k, ranks, lookups and running values over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.sources.shared import written


def top_rows(df: DataFrame, k: int, by: str, tie: str, largest: bool = True) -> DataFrame:
    """The k rows with the largest (smallest) values, ties by ``tie``; k rows leave each task."""
    return df.orderBy(F.desc(by) if largest else F.asc(by), tie).limit(k)


def top_per_group(df: DataFrame, k: int, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; groups are cut to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(rank) <= k)


def merge_top(top: DataFrame, batch: DataFrame, k: int, group: list[str], order: list[Column]) -> DataFrame:
    """The k best rows of each group after another batch."""
    columns = batch.columns
    return top_per_group(top.select(*columns).unionByName(batch), k, group, order).select(*columns)


def ranks_of(values: DataFrame, probes: DataFrame, value: str, probe: str, descending: bool = True) -> DataFrame:
    """For each probe, min_rank (values before it) and max_rank (min_rank plus values equal to it).

    Values are counted by distinct value first, and the counts are added up by ranges of the values, so nothing is
    compared with everything and no task holds all values.
    """
    v = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    p = probes.select(F.col(probe).cast("double").alias("__x")).distinct().withColumn("__n", F.lit(0).cast("bigint"))
    both = v.unionByName(p).groupBy("__x").agg(F.sum("__n").alias("__n"))
    before = _running(both, "__x", "__n", descending)
    return probes.join(before.select(F.col("__x").alias("__p"), "__before", "__n"), F.col(probe).cast("double") == F.col("__p"), "left").select(
        *probes.columns, F.coalesce("__before", F.lit(0)).alias("min_rank"), (F.coalesce("__before", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("max_rank")
    )


def _running(df: DataFrame, key: str, n: str, descending: bool = False) -> DataFrame:
    """Adds __before: the sum of ``n`` over rows with smaller (larger) distinct keys.

    Rows are dealt to ranges of the key; each task adds up its own rows in order, and the sums of the tasks before
    it come from a row for each task."""
    order = F.desc(key) if descending else F.asc(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = np.cumsum(np.asarray(batch.column(1))) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own - np.asarray(batch.column(1))), pa.array([part] * len(own), pa.int32())], names=[key, n, "__own", "__part"])
            total = int(own[-1]) if len(own) else total

    ranged = df.select(F.col(key).cast("double").alias(key), F.col(n).cast("bigint").alias(n)).repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, f"{key} double, {n} long, __own long, __part int")
    ranged = written(ranged, "ranges")
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(F.sum(n).alias("__t"))
    totals = totals.select("__part", F.coalesce(F.sum("__t").over(w), F.lit(0)).alias("__base"))  # a row for each task
    return ranged.join(totals, "__part").withColumn("__before", F.col("__base") + F.col("__own"))


def _parts(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` dealt to ranges of (group, order), with the range as __part: a group of any size is in as many as it takes."""
    return written(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "parts")


def _with_base(parts: DataFrame, group: list[str], last: Column, upto: Column, name: str) -> DataFrame:
    """Adds ``name``: ``upto`` (a window function) over what ``last`` makes of the group's earlier parts."""
    sums = parts.groupBy(*group, "__part").agg(last.alias(name))  # a row for each group and part
    sums = sums.withColumn(name, upto.over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__part").alias("__p"), name)
    same = F.col("__part") == F.col("__p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return parts.join(sums, same).drop("__p", *[f"__g_{g}" for g in group])


def running_sum(df: DataFrame, value: str, order: list[str], group: list[str], name: str = "running") -> DataFrame:
    parts = _with_base(_parts(df, group, order), group, F.sum(value), F.sum("__base"), "__base")
    own = F.sum(value).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = F.when(F.col("__own").isNull(), F.col("__base")).otherwise(F.col("__own") + F.coalesce("__base", F.lit(0)))
    return parts.withColumn("__own", own).withColumn(name, both).select(*df.columns, name)


def differences(df: DataFrame, value: str, order: list[str], group: list[str], name: str = "difference") -> DataFrame:
    """Difference to the row before; the first row keeps its value."""
    placed = F.struct(*order, F.struct(F.col(value).alias("x")).alias("row"))
    parts = _with_base(_parts(df, group, order), group, F.max(placed)["row"], F.last("__base"), "__base")
    w = Window.partitionBy(*group, "__part").orderBy(*order)
    before = F.when(F.row_number().over(w) == 1, F.col("__base.x")).otherwise(F.lag(value).over(w))
    return parts.withColumn("__before", before).select(*df.columns, (F.col(value) - F.coalesce("__before", F.lit(0))).alias(name))


def as_of(probes: DataFrame, table: DataFrame, at: str, since: str, group: list[str], columns: list[str]) -> DataFrame:
    """For each probe, ``columns`` of the last row of its group with since <= at; null without one.

    One sort of both sides together, not a join of each probe with all earlier rows; a group goes over many tasks.
    """
    t = table.select(*group, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.struct(*columns).alias("__row"), *[F.lit(None).cast(f.dataType).alias(f"__p_{f.name}") for f in probes.schema if f.name not in group])
    p = probes.select(*group, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(t.schema["__row"].dataType).alias("__row"), *[F.col(f.name).alias(f"__p_{f.name}") for f in probes.schema if f.name not in group])
    parts = _parts(t.unionByName(p), group, ["__t", "__side"])
    last = F.max_by("__row", F.when(F.col("__row").isNotNull(), F.struct("__t", "__row")))
    parts = _with_base(parts, group, last, F.last("__base", ignorenulls=True), "__base")
    w = Window.partitionBy(*group, "__part").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("__row", F.coalesce(F.last("__row", ignorenulls=True).over(w), F.col("__base"))).where("__side = 1")
    return out.select(*[F.col(f"__p_{c}").alias(c) if c not in group else F.col(c) for c in probes.columns], *[F.col(f"__row.{c}").alias(c) for c in columns])


def count_matches(values: DataFrame, wanted: DataFrame, value: str, want: str) -> DataFrame:
    """One row: how many values are in a list; an entry that is listed twice counts twice."""
    counted = values.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    return wanted.join(counted, wanted[want] == counted["__v"]).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))


def find_labels(wanted: DataFrame, labels: DataFrame, want: str, label: str, position: str) -> DataFrame:
    """The first position of each wanted label, -1 if there is none."""
    first = labels.groupBy(F.col(label).alias("__l")).agg(F.min(position).alias("__p"))
    return wanted.join(first, wanted[want] == first["__l"], "left").select(*wanted.columns, F.coalesce("__p", F.lit(-1)).cast("bigint").alias("position"))


def merge_ordered(lists: list[DataFrame], label: str) -> DataFrame:
    """All rows of some lists, in order of their labels."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.orderBy(label)


def within_ratio(df: DataFrame, value: str, group: list[str], ratio: float) -> DataFrame:
    """Rows whose value is below ratio times the group's least value."""
    least = df.groupBy(*group).agg(F.min(value).alias("__m"))
    return df.join(least, group).where(F.col(value) < F.col("__m") * ratio).drop("__m")


def invert_permutation(df: DataFrame, index: str, target: str) -> DataFrame:
    return df.select(F.col(target).alias(index), F.col(index).alias(target))


def average_precision(ranked: DataFrame, query: str, rank: str, relevant: str, total: str) -> DataFrame:
    """query, ap: area under precision over recall by trapezoids; ``rank`` from 1, ``total`` relevant items for each query."""
    hit = F.sum(F.col(relevant).cast("int")).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    hits = ranked.withColumn("__k", hit).where(F.col(relevant))
    before = F.when(F.col(rank) > 1, (F.col("__k") - 1) / F.greatest(F.col(rank) - 1, F.lit(1))).otherwise(1.0)
    return hits.groupBy(query).agg((F.sum((before + F.col("__k") / F.col(rank)) / 2) / F.max(total)).alias("ap"))
