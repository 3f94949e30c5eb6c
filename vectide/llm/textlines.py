"""Lines of a text as arrays of Columns: shared by the operators that count lines across documents.

A line is what stands between line feeds. Its normal form has its words, lower-cased, joined by single
blanks; lines without a word have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def normal(line: Column) -> Column:
    return F.lower(F.array_join(words_of(line), " "))


def row_key(*columns: str) -> Column:
    """A hash of what a decision depends on: rows that share it get the same decision."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def with_lines(df: DataFrame, text: str) -> DataFrame:
    """Adds entries: h, w (hash of the normal form and number of words) of every line, in order."""
    df = df.withColumn("__normal", F.transform(F.split(F.col(text), "\n"), normal))
    entry = lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int").alias("w"))
    return df.withColumn("entries", F.transform("__normal", entry)).drop("__normal")


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def exploded(table: DataFrame, *keys: str) -> DataFrame:
    """A row for each line with a word: keys, pos, h."""
    return table.select(*keys, F.posexplode("entries").alias("pos", "e")).where("e.w > 0").select(*keys, "pos", F.col("e.h").alias("h"))


def kept_positions(n: Column, removed: Column) -> Column:
    """0 to n - 1 without the removed ones; in time proportional to n."""
    return F.array_except(F.sequence(F.lit(0), n - 1), removed)


def words_at(entries: Column, positions: Column) -> Column:
    return F.aggregate(F.transform(positions, lambda i: F.get(entries, i)["w"]), F.lit(0), lambda a, x: a + x)


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines at these positions; unchanged where there are none."""
    lines = F.split(text, "\n")
    rest = F.array_join(F.transform(kept_positions(F.size(lines), removed), lambda i: F.get(lines, i)), "\n")
    return F.when(F.size(F.coalesce(removed, F.array().cast("array<int>"))) == 0, text).otherwise(rest)
