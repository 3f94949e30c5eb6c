"""Line dedup by distinct-site spread.

Lines that stand on many sites are boilerplate and are removed everywhere. HyperLogLog sketches of the sites, one per
line hash, merge by aggregation; where a sketch's estimate is within ``band`` of the threshold, the distinct sites are
counted exactly. Every distinct (line, site) counts, whatever else its documents hold. A document with nothing but
such lines isn't emptied: it is a text that was copied to many sites, which stays whole for near-duplicate removal to
judge.

All steps are DataFrame expressions. Tasks begin a sketch for each of their lines, so of a line that a third of all
rows have, a row a task is shuffled.

Defined results: null texts stay null (empty in the digest), a null source is the empty site; rows that repeat
get equal results; lines of equal text are one line wherever they stand; very long texts are lists of lines in one
row; an empty table gives no rows; other columns are ignored, or returned as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .textlines import exploded, kept_positions, row_key, with_lines, without_lines, words_at

SITES, LG_K, BAND = 10, 12, 0.1


def _table(docs: DataFrame) -> DataFrame:
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_lines(df.withColumn("key", row_key("doc_id", "text")), "text").select("key", "site", "entries")


def spread_lines(table: DataFrame, sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """h of the lines on ``sites`` or more distinct sites."""
    lines = exploded(table, "site")
    sketches = lines.select("h", F.xxhash64("site").alias("s")).groupBy("h").agg(F.hll_sketch_agg("s", F.lit(lg_k)).alias("sketch"))
    estimates = sketches.select("h", F.hll_sketch_estimate("sketch").alias("n"))
    met = write_table(estimates.where(F.col("n") >= (1 - band) * sites - 1), "line-estimates")
    sure = F.col("n") >= (1 + band) * sites + 1
    near = lines.join(met.where(~sure).select("h"), "h", "left_semi")
    exact = near.groupBy("h", "site").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return write_table(met.where(sure).select("h").union(exact.select("h")), "line-spread")


def removed_lines(docs: DataFrame, sites: int = SITES, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """key, removed (positions), for the documents that lose lines."""
    table = write_table(_table(docs), "line-table")
    spread = spread_lines(table, sites, lg_k, band)
    found = exploded(table, "key").join(spread, "h", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("removed"))
    joined = table.select("key", "entries").join(found, "key")
    left = words_at(F.col("entries"), kept_positions(F.size("entries"), F.col("removed")))
    return joined.where(left > 0).groupBy("key").agg(F.first("removed").alias("removed"))


def _joined(docs: DataFrame, **params) -> DataFrame:
    """docs with __removed; text isn't null."""
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("\x00")), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keyed.join(removed_lines(docs, **params).select(F.col("key").alias("__key"), F.col("removed").alias("__removed")), "__key", "left")


def remove_boilerplate(docs: DataFrame, **params) -> DataFrame:
    """The documents without boilerplate lines; all columns of ``docs``."""
    text = without_lines(F.col("text"), F.col("__removed"))
    return _joined(docs, **params).withColumns({"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})).select(*docs.columns)


def line_report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of what is left, for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _joined(docs, **params).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(without_lines(text, F.col("__removed")), 256).alias("text_sha256"),
    )


SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(source, '') site, coalesce(text, '') t FROM documents),
l AS (SELECT rid, site, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) pos FROM d),
nl AS (SELECT rid, site, pos, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM l),
n AS (SELECT rid, site, pos, line, lower(coalesce(array_to_string(ws, ' '), '')) x, len(ws) w FROM nl),
spread AS (SELECT x FROM n WHERE w > 0 GROUP BY x HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT n.*, spread.x IS NOT NULL AND w > 0 bad FROM n LEFT JOIN spread USING (x)),
g AS (SELECT rid, sum(CASE WHEN bad THEN w ELSE 0 END) < sum(w) AND bool_or(bad) cut FROM m GROUP BY rid)
SELECT d.doc_id, count(*)::BIGINT n_lines, count(*) FILTER (WHERE cut AND bad)::BIGINT n_removed,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (cut AND bad)), '')) text_sha256
FROM m JOIN g USING (rid) JOIN d USING (rid) GROUP BY d.rid, d.doc_id
"""
