"""URL filters by rules and by link-graph propagation.

A rule is host and path prefix; it fits the host and its subdomains, and the longest one wins. What no rule
fits is judged by its host: trust flows from hosts whose pages rules allow along the links between hosts, and
distrust from hosts whose pages rules block against the links (personalised PageRank, forward and reversed, damping
``damping``). Seeds are the shares of a host's pages that rules allow or block, over the sum of all such shares, so
that both together are one distribution. Each round passes on what the round before brought, until what may still
arrive anywhere is at most ``tolerance`` of all. A host is blocked if distrust is more than ``threshold`` of its trust
and distrust: a share, which doesn't fall with the number of hosts or of links to a blocked one.

All steps are DataFrame expressions. Links are counted per pair of hosts before the shuffle, ranks are a row per
host, and rounds are written out, so a host with a third of all pages is one row after the first aggregation.

Defined results: a null url, or one without ``://``, has an empty host and path, and no rule; null html has no
links; links from and to the same host and from the empty host don't count; a host that nothing reaches is
allowed, and so is one with as much trust as distrust; of rules of equal length the greatest wins; very long urls
and pages are read whole, by expressions that don't go back; rows that repeat give rows that repeat (each counts as a
page); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, literal_table, write_table

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
#: Rounds between two written tables.
WRITTEN = 6
#: Parts of a host's pages in joins.
SALTS = 16
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "example.net/de/8"), ("allow", "net/de/"), ("block", "org/es/"))
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
_REST = r"(?s)^([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """From the first :// on; A-Z of the host in lower case."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, _REST, 1)), F.regexp_extract(rest, _REST, 2)


def _rule_table(pages: DataFrame, rules) -> DataFrame:
    rows = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        rows.append((host.lower(), slash + path, rule, verdict))
    return literal_table(pages.sparkSession, rows, "suffix prefix rule verdict")


def _fitting(hosts: DataFrame, rules: DataFrame, labels: int) -> DataFrame:
    """host, fits: the rules of the host and of what it is a subdomain of."""
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    met = hosts.select("host", F.explode(ends).alias("suffix")).join(rules, "suffix")
    return met.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "prefix", "verdict")).alias("fits"))


def _by_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Left join on host; rows of hosts are repeated for each of SALTS parts that a host's pages are dealt to."""
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    copies = hosts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("__salt", salt).join(copies, ["host", "__salt"], "left").drop("__salt")


def _links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts."""
    host, _ = host_and_path(F.col("url"))
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust) over links (src, dst, n)."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    moves = write_table(both.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("n") / F.col("total")).alias("share")), "url-moves")
    whole = seeds.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 1.0
    start = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / whole).alias("r")) for k in ("trust", "distrust")])).alias("x")).select("x.kind", "host", "x.r").where("r > 0")
    # new: what the last round brought; r: all so far
    ranks = write_table(start.select("kind", "host", F.col("r").alias("new"), "r"), "url-ranks")
    while True:
        for _ in range(WRITTEN):
            sent = ranks.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("new") * F.col("share")).alias("new"), F.lit(0.0).alias("r"))
            ranks = ranks.select("kind", "host", F.lit(0.0).alias("new"), "r").union(sent).groupBy("kind", "host").agg(F.sum("new").alias("new"), F.sum(F.col("r") + F.col("new")).alias("r"))
        ranks = write_table(ranks, "url-ranks")
        # a round passes on at most damping of what it gets
        if (ranks.agg(F.sum("new")).first()[0] or 0.0) * damping / (1 - damping) <= tolerance:
            break
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(k)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    named = write_table(pages.select("page_id", host.alias("host"), path.alias("path")), "url-pages")
    hosts = named.groupBy("host").agg(F.count("*").alias("pages"))
    fits = _fitting(hosts, _rule_table(pages, rules), max((r.partition("/")[0].count(".") + 1 for _, r in rules), default=1))
    longest = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["prefix"])))
    ruled = write_table(_by_host(named, fits).withColumn("best", longest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("said")), "url-ruled")
    share = lambda v: (F.count_if(F.coalesce(F.col("said") == v, F.lit(False))) / F.count("*"))
    seeds = ruled.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, _links(pages), damping, tolerance)
    blocked = scores.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit(True).alias("blocked"))
    verdict = F.coalesce("said", F.when(F.col("blocked"), "block").otherwise("allow"))
    return _by_host(ruled, blocked).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: Rounds after which at most TOLERANCE of all may still arrive.
SQL_ROUNDS = math.ceil(math.log(TOLERANCE * (1 - DAMPING) / DAMPING) / math.log(DAMPING))


def sql(rules=RULES) -> str:
    """The same in SQL, rounds as a recursion."""
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{r[len(r.partition('/')[0]) :]}')" for v, r in rules)
    links = LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE p AS (SELECT row_number() OVER () rid, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
n AS (SELECT rid, page_id, html, {lower.format("regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1)")} host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) path FROM p),
rules(v, rule, rhost, prefix) AS (VALUES {values}),
best AS (SELECT rid, arg_max(rule, length(rule)) rule, arg_max(v, length(rule)) v FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, prefix) GROUP BY rid),
ruled AS (SELECT n.*, rule, v FROM n LEFT JOIN best USING (rid)),
seeds AS (SELECT host, count(*) FILTER (WHERE v = 'allow') / count(*) trust, count(*) FILTER (WHERE v = 'block') / count(*) distrust FROM ruled GROUP BY host),
hrefs AS (SELECT host src, {lower.format(f"unnest(regexp_extract_all(html, '{links}', 1))")} dst FROM n WHERE html IS NOT NULL),
links AS (SELECT src, dst, count(*) n FROM hrefs WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
two AS (SELECT 'trust' kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
moves AS (SELECT kind, src, dst, {DAMPING} * n / sum(n) OVER (PARTITION BY kind, src) share FROM two),
whole AS (SELECT sum(trust + distrust)::DOUBLE t FROM seeds),
x(kind, host, r, k) AS (SELECT 'trust', host, trust / t, 0 FROM seeds, whole WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust / t, 0 FROM seeds, whole WHERE distrust > 0
 UNION ALL SELECT m.kind, m.dst, sum(x.r * m.share), any_value(x.k) + 1 FROM x JOIN moves m ON m.kind = x.kind AND m.src = x.host WHERE x.k < {SQL_ROUNDS} GROUP BY m.kind, m.dst),
s AS (SELECT host, coalesce(sum(r) FILTER (WHERE kind = 'trust'), 0) t, coalesce(sum(r) FILTER (WHERE kind = 'distrust'), 0) d FROM x GROUP BY host)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN d > {THRESHOLD} * (d + t) THEN 'block' ELSE 'allow' END) verdict FROM ruled LEFT JOIN s USING (host)
"""
