"""Quality rules: counts on each text, and line frequency across the documents of a host.

All steps are DataFrame expressions. Counts on a text need no shuffle. For line frequency, normal lines are
hashed and the distinct documents that hold a line are counted per host; documents with the same lines are one.
A line above the limit - more than ``least`` documents and more than ``share`` of the host's documents - is removed
from that host's documents. A document that loses more than ``most_lost`` of its words that way is depleted and rejected.
Counting is combined before each shuffle, so a hot host or line is a row a task; lists hold line positions of
one document.

Defined results: a null text is empty, a null source the empty host; an empty text fails the base rules;
rows that repeat get equal results and count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .textlines import exploded, has_word, kept_positions, row_key, with_lines, without_lines, words_at, words_of

#: The floor beside the share is a few documents, so that small hosts are judged too.
LEAST, SHARE, MOST_LOST = 4, 0.05, 0.7
SYMBOLS = "#*$%&|<>"


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows found twice or more. Windows are (64-bit hash, position), sorted, so
    that equal ones are neighbours in order of position; the positions of those that aren't alone cover 3 words each."""
    n = F.size("__words")
    windows = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("__sorted", F.sort_array(windows))
    hash_at = lambda i: F.get("__sorted", i)["h"]
    twice = lambda x, i: F.when((x["h"] == hash_at(i - 1)) | (x["h"] == hash_at(i + 1)), x["i"]).otherwise(-1)
    df = df.withColumn("__at", F.sort_array(F.array_remove(F.transform("__sorted", twice), -1)))
    covered = F.transform("__at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__sorted", "__at")


def _counted(docs: DataFrame) -> DataFrame:
    """A row per document: key, doc_id, host, counts, base_failed, entries, whole (a hash of all lines). No shuffle."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("key", row_key("doc_id", "host", "text"))
    df = df.withColumn("__words", words_of(F.col("text"))).withColumn("__lines", F.filter(F.split("text", "\n"), has_word))
    df = df.withColumn("n_words", F.size("__words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    df = with_lines(_repeated(df), "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "entries", F.xxhash64(F.transform(F.filter("entries", lambda x: x["w"] > 0), lambda x: x["h"])).alias("whole"))


def frequent_lines(table: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, h of lines above the limits."""
    hosts = table.groupBy("host", "whole").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("documents"))
    lines = exploded(table, "host", "whole").groupBy("host", "h", "whole").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return lines.join(hosts, "host").where(F.col("n") > share * F.col("documents")).select("host", "h")


def _judged(docs: DataFrame, least: int, share: float, most_lost: float) -> DataFrame:
    table = write_table(_counted(docs), "quality")
    frequent = frequent_lines(table, least, share)
    removed = exploded(table, "key", "host").join(frequent, ["host", "h"], "left_semi").groupBy("key").agg(F.collect_set("pos").alias("removed"))
    found = table.join(removed, "key", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.when(F.size("removed") == 0, F.col("n_words")).otherwise(words_at(F.col("entries"), kept_positions(F.size("entries"), F.col("removed"))).cast("long"))
    found = found.withColumn("left_words", left)
    depleted: Column = F.col("n_words") - F.col("left_words") > most_lost * F.col("n_words")
    return found.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, least: int = LEAST, share: float = SHARE, most_lost: float = MOST_LOST) -> DataFrame:
    """A row per document: counts, base_failed, kept, left_words (words after frequent lines are gone)."""
    return _judged(docs, least, share, most_lost).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


def clean(docs: DataFrame, least: int = LEAST, share: float = SHARE, most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that are kept, without their host's frequent lines; all columns of ``docs``."""
    verdicts = _judged(docs, least, share, most_lost).where("kept").groupBy("key").agg(F.first("removed").alias("__removed"))
    keyed = docs.withColumn("__key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit(z)) for c, z in (("doc_id", "\x00"), ("source", ""), ("text", ""))]))
    joined = keyed.join(verdicts.withColumnRenamed("key", "__key"), "__key")
    text = without_lines(F.coalesce("text", F.lit("")), F.col("__removed"))
    return joined.withColumns({"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})).select(*docs.columns)


#: The same in SQL, for tables that one machine holds.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(source, '') host, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
l AS (SELECT rid, host, line, pos FROM (SELECT rid, host, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) pos FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) n FROM l GROUP BY rid),
nl AS (SELECT rid, host, pos, lower(array_to_string(ws, ' ')) x, len(ws) w FROM (SELECT rid, host, pos, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM l)),
whole AS (SELECT rid, string_agg(x, chr(10) ORDER BY pos) f FROM nl GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT coalesce(f, '')) n FROM d LEFT JOIN whole USING (rid) GROUP BY host),
freq AS (SELECT nl.host, x, count(DISTINCT f) n FROM nl JOIN whole USING (rid) GROUP BY nl.host, x),
bad AS (SELECT freq.host, x FROM freq JOIN hosts USING (host) WHERE freq.n > {LEAST} AND freq.n > {SHARE} * hosts.n),
lost AS (SELECT rid, sum(w) n FROM nl JOIN bad USING (host, x) GROUP BY rid),
o AS (SELECT w.doc_id, len(ws)::BIGINT n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
 coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(cov.n, 0)::BIGINT n_repeat_words, coalesce(lost.n, 0)::BIGINT lost
 FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost > {MOST_LOST} * n_words) kept, n_words - lost left_words FROM o
"""
