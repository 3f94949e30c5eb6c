"""Every operator and stage on odd rows, on an empty table, and on columns with clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from llm_cases import PROSE, ROWS
from vectide.llm import boilerplate, chat, decontam, licenses, packing, quality, secret_scan, simhash, suffixes, url_filter
from vectide.llm.queries import ORACLES, tokenizer_path


def bench(spark):
    return spark.createDataFrame([(1, "If 3 workers build 4 walls in 5 days how many walls do 9 workers build"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "packing": (lambda s, d: packing.pack(d, tokenizer_path()), None),
    "decontamination": (lambda s, d: decontam.leaks(d, bench(s)), 0),
    "licenses": (lambda s, d: licenses.scan(d), 0),
    "quality": (lambda s, d: quality.quality_rules(d), len(ROWS)),
    "simhash": (lambda s, d: simhash.near_duplicates(d), len(ROWS)),
    "secrets": (lambda s, d: secret_scan.scan(d), len(ROWS)),
    "lines": (lambda s, d: boilerplate.line_report(d), len(ROWS)),
    "suffixes": (lambda s, d: suffixes.remove_repeats(d), len(ROWS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_edges(spark, edge, none, name):
    f, n = OPERATORS[name]
    rows = f(spark, edge).collect()
    assert n is None or len(rows) == n
    empty = f(spark, none)
    assert empty.count() == 0 and empty.schema.names == f(spark, edge).schema.names


def test_stages_on_edges(spark, edge, none, sf_dir):
    docs, empty = edge, none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, sf_dir), stage(spark, empty, sf_dir)
        assert docs.schema.names == edge.schema.names and empty.schema.names == edge.schema.names
        assert docs.count() > 0 and empty.count() == 0
    _, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, sf_dir).count() > 0 and last(spark, empty, sf_dir).count() == 0


def test_packing_results(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text, _ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = np.array(ids[at : at + 4096], "<u4")
            want[doc_id, k, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    rows = packing.pack(edge, tokenizer_path()).collect()
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in rows) // 4096)


def fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_simhash_results(spark, edge):
    fps = [fingerprint(x) for _, x, _ in ROWS]
    group = list(range(len(ROWS)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = {}
    for i, (doc_id, _, _) in enumerate(ROWS):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    want = Counter((ROWS[i][0], f"{fps[i]:016x}", least.get(find(i))) for i in range(len(ROWS)))
    assert Counter(map(tuple, simhash.near_duplicates(edge).collect())) == want


def test_one_of_each_group_stays(spark, edge):
    kept = simhash.keep_one(edge).collect()
    roots = {r["component_id"] for r in simhash.near_duplicates(edge).collect()}
    assert len(kept) == len(roots) and Counter(r["doc_id"] for r in kept) == Counter(roots)


def test_suffix_results(spark, edge):
    keys = sorted({(-(2**63) if d is None else d, x or "") for d, x, _ in ROWS})
    got = suffixes.remove_repeats(edge, with_text=True).collect()
    # of texts with one doc_id either may come first; the rest is fixed
    for r in got:
        assert r["n_bytes"] - r["n_removed"] == len(r["kept"]) and hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    seen, want = {}, {}
    for d, x in keys:
        b = x.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if seen.setdefault(b[i : i + 100], (d, x, i)) != (d, x, i):
                gone[i : i + 100] = b"\1" * 100
        want[d, x] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
    expected = Counter((d, *want[-(2**63) if d is None else d, x or ""]) for d, x, _ in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got) == expected


@pytest.mark.parametrize("name,operator", [("op5_licenses", licenses.scan), ("op6_quality", quality.quality_rules), ("op9_line_dedup", boilerplate.line_report)])
def test_edges_equal_sql(spark, edge, name, operator):
    notice = "\n".join(["Licensed under the MIT License.", "one more line of this site"])
    rows = [(i, x, s) for i, x, s in ROWS] + [(100 + i, f"{notice}\n{' '.join(f'own{i}w{j}' for j in range(60))}", f"s{i % 12}") for i in range(24)]
    rows += [(None, notice, "s1"), (None, notice, None), (200, "GPL v2", "s2"), (200, "GPL v2", "s2")]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    extra = spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string, source string")
    got = operator(edge.unionByName(extra, allowMissingColumns=True))
    result = c.execute(ORACLES[name])
    columns = [x[0] for x in result.description]
    want = Counter(result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want and sum(want.values()) > 3


def test_leaks_on_edges(spark, edge):
    items = [(1, PROSE.split("\n")[0]), (None, PROSE.split("\n")[1]), (None, PROSE.split("\n")[1]), (3, "one"), (4, "  "), (5, None), (6, "é ü 漢字 👍")]
    got = Counter(map(tuple, decontam.leaks(edge, spark.createDataFrame(items, "item_id long, text string")).collect()))
    prose = [d for d, x, _ in ROWS if x and x.startswith("term")]
    by = Counter((d, i) for d, i, *_ in got.elements())
    for d in set(prose) - {3}:
        assert by[d, 1] == by[d, None] == prose.count(d)
    assert by[7, 3] == 1 and by[9, 6] == 0 and not any(i in (4, 5) for _, i in by)


def test_secrets_on_edges(spark, edge):
    from test_methods import brute_base

    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secret_scan.scan(edge).collect())
    want = Counter()
    for d, x, _ in ROWS:
        base = brute_base(x or "")
        want[d, *(sum(k == n for _, k, _ in base) for n in range(3)), ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)] += 1
    assert got == want


def test_urls_on_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme/en/", "<a href='http://x.org/'>"), (4, "http://WWW.Example.COM/en/71?x#y", None), (5, "https://a.example.com/en/8", None), (5, "https://a.example.com/en/8", None), (6, "http://b.net?q=/de/", ""), (None, "x://c.example.net/de/81", None), (7, "http://org/es/", "")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(map(tuple, url_filter.judge(pages).collect()), key=str)
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.com", "/en/71", "example.com/en/7", "allow"), (5, "a.example.com", "/en/8", "com/en/", "block"), (5, "a.example.com", "/en/8", "com/en/", "block"), (6, "b.net", "", None, "allow"), (None, "c.example.net", "/de/81", "example.net/de/8", "block"), (7, "org", "/es/", "org/es/", "block")]
    assert got == sorted(want, key=str)
    assert url_filter.judge(pages.where("false")).count() == 0


def test_chats_on_edges(spark):
    rows = [(1, 0, "system", "be short"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, None, "odd"), (None, 0, "user", "\\ <s> \\<s> [INST][/INST]</s>"), (None, 1, "assistant", "<<SYS>><"), (None, None, "assistant", "first"), (2, 0, "assistant", "x " * 9000), (2, 0, "assistant", "x " * 9000)]
    chats = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(chats, tokenizer_path())).collect()}
    assert len(got) == 3
    for conv, r in got.items():
        turns = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(chats.where("false"), tokenizer_path()).count() == 0


def test_the_pipeline_drops_what_it_wrote(spark, sf_dir, tmp_path):
    from pathlib import Path

    from vectide.llm import common

    folder = Path(common.checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    packed = corpus_pipeline.run(spark, sf_dir)
    left = {x.name.rsplit("-", 1)[0] for x in set(folder.iterdir()) - before}
    assert left == {"benchmark-decontamination", "pieces"}  # the last stage's input, and what its rows are read from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.write_table(stage(spark, docs, sf_dir), "stage")
    kept = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in packed.collect()} == kept and 0 < len(kept) < 200


def test_tables_are_dropped_by_their_own_handle(spark):
    from vectide.llm import common

    with common.Tables(spark) as outer:
        a = common.write_table(spark.range(3), "outer")
        with common.Tables(spark) as inner:
            common.write_table(spark.range(4), "inner")
        inner.drop()
        assert not inner.paths and len(outer.paths) == 1 and a.count() == 3
    outer.drop()
    assert not outer.paths
