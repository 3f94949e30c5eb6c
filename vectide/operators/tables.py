"""Histograms, scatter sums and matrix-shaped aggregates over rows of (id, vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V


def histogram(df: DataFrame, column: Column, bins: int, strict: bool = True) -> DataFrame:
    """bin, n for bins 0 to bins - 1, empty ones too; other values fail, or fall in the outer bins."""
    at = column.cast("bigint")
    at = F.when((at >= 0) & (at < bins), at).otherwise(F.raise_error(F.lit("value outside the bins")).cast("bigint")) if strict else F.greatest(F.lit(0), F.least(F.lit(bins - 1), at))
    counts = df.where(column.isNotNull()).groupBy(at.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_range(df: DataFrame, column: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, n for equal bins over [low, high); values outside fall in the outer bins, NaN in none."""
    x = column.cast("double")
    at = F.floor((F.greatest(F.lit(low - 1.0), F.least(F.lit(high + 1.0), x)) - low) * bins / (high - low))
    return histogram(df.where(~F.isnan(x)), at, bins, strict=False)


def joint_histogram(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def imbalance(df: DataFrame, key: str, bins: int | None = None) -> DataFrame:
    """One row: n * sum of squared counts over the square of their sum; ``bins`` counts empty bins too."""
    c = df.groupBy(key).agg(F.count("*").cast("double").alias("__n"))
    n = F.count("*") if bins is None else F.lit(float(bins))
    return c.agg((n * F.sum(F.col("__n") * F.col("__n")) / F.pow(F.sum("__n"), F.lit(2.0))).alias("factor"))


def splat_add(df: DataFrame, assign: str, value: str) -> DataFrame:
    """assign, total: sums of the values with each assignment."""
    return df.groupBy(assign).agg(F.sum(value).alias("total"))


def gather_add(accu: DataFrame, table: DataFrame, assign: str, index: str, value: str, to: str) -> DataFrame:
    """Adds table[assign] to each row of accu."""
    t = table.select(F.col(index).alias("__i"), F.col(value).alias("__v"))
    return accu.join(t, accu[assign] == t["__i"], "left").select(*[c for c in accu.columns if c != to], (F.col(to) + F.coalesce("__v", F.lit(0))).alias(to))


def elements(df: DataFrame, v: str, *keys: str) -> DataFrame:
    """Long form: keys, pos, x."""
    return df.select(*keys, F.posexplode(V.doubles(v)).alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))


def column_sums(df: DataFrame, v: str) -> DataFrame:
    """pos, total over all vectors."""
    return elements(df, v).groupBy("pos").agg(F.sum("x").alias("total"))


def sum_by_assignment(df: DataFrame, v: str, assign: str) -> DataFrame:
    """assign, pos, total: vectors added up by assignment; negative assignments are passed over."""
    return elements(df.where(F.col(assign) >= 0), v, assign).groupBy(assign, "pos").agg(F.sum("x").alias("total"))


def splat_separable(df: DataFrame, v: str, row_assign: str, column_assign: DataFrame) -> DataFrame:
    """row, col, total: element (i, j) added at (row_assign of i, column_assign of j); column_assign has pos, col."""
    return elements(df, v, row_assign).join(column_assign, "pos").groupBy(F.col(row_assign).alias("row"), "col").agg(F.sum("x").alias("total"))


def vectors_from(df: DataFrame, key: str, pos: str = "pos", x: str = "total") -> DataFrame:
    """key, v from long form with all positions."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, x))), lambda s: s[x]).alias("v"))


def transpose(df: DataFrame, key: str, v: str) -> DataFrame:
    """pos, v: each dimension as a vector, its elements in order of the key."""
    return elements(df, v, key).groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "x"))), lambda s: s["x"]).alias("v"))


def transpose_blocks(df: DataFrame, key: str, v: str, block: int = 1 << 16) -> DataFrame:
    """pos, block, v: the same in blocks of ``block`` keys, for more vectors than a row can hold."""
    long = elements(df, v, key).withColumn("block", F.floor(F.col(key) / block))
    return long.groupBy("pos", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "x"))), lambda s: s["x"]).alias("v"))


def medians(long: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, median: exact medians by group, without all values of a group in one place.

    Approximate quantiles on both sides of the middle come first; the values between them, a few thousandths of the
    group, are counted by value, and their places follow from the number of values below. Nulls and NaN don't count."""
    values = long.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(x).cast("double").alias("__x"))
    around = values.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000)).alias("__q"))
    met = values.join(around, keys).where(F.col("__x") <= F.get("__q", 1))
    below = F.col("__x") < F.get("__q", 0)
    counted = met.groupBy(*keys, F.when(~below, F.col("__x")).alias("__x")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__x").asc_nulls_first()))
    placed = counted.withColumn("__upto", upto).where("__x IS NOT NULL")
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__x")))
    return placed.groupBy(*keys).agg(((at(F.floor((F.col("__n") - 1) / 2)) + at(F.floor(F.col("__n") / 2))) / 2).alias("median"))


def pick(df: DataFrame, wanted: DataFrame, key: str, want: str) -> DataFrame:
    """Rows by a list of keys; a key listed twice comes twice. ``wanted`` may hold the position in the list."""
    return wanted.join(df, wanted[want] == df[key])


def stack(a: DataFrame, b: DataFrame, key: str, v: str) -> DataFrame:
    """Paired vectors, one after the other."""
    return a.join(b.select(key, F.col(v).alias("__w")), key).select(key, F.concat(V.doubles(v), V.doubles("__w")).alias(v))


def nonzero_vectors(df: DataFrame, v: str) -> DataFrame:
    return df.where(~V.all_zero(v))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same keys and seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def random_permutation(df: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """Adds the row's place, from 0, in an order that seed and key fix.

    Places are counted within 256 ranges of the hash and added up, so no task ranks all rows."""
    h = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("__b", F.shiftright("__h", 56).cast("int"))
    sizes = h.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 256 rows
    base = sizes.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return h.withColumn("__own", own).join(F.broadcast(base), "__b").withColumn(name, F.col("__base") + F.col("__own")).drop("__h", "__b", "__own", "__base")


def random_vectors(spark, n: int, d: int, seed: int = 0, normal: bool = False) -> DataFrame:
    """id, v with elements uniform in [0, 1) or standard normal; fixed by id and seed."""
    u = lambda k: (F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(2**52)) + 0.5) / 2**52
    if normal:
        x = lambda j: F.sqrt(-2 * F.ln(u(2 * j))) * F.cos(2 * 3.141592653589793 * u(2 * j + 1))
    else:
        x = u
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), x).alias("v"))
