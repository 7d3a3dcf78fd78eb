"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerline.llm import importance as I
from ledgerline.llm import merkle as M
from ledgerline.llm import warc as W
from ledgerline.llm.common import numbered, shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha("".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climbed(nodes):
    """(root, [siblings and place of each node, level by level])"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = nodes[at[k] // 16 * 16 : at[k] // 16 * 16 + 16]
            path.append((run[: at[k] % 16], run[at[k] % 16 + 1 :]))
            at[k] //= 16
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def merkle_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((leaf_of(r, r.text), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[1].doc_id is not None, x[1].doc_id or 0, x[0]))
    trees = [climbed([x[0] for x in by[s]]) for s in order]
    root, over = climbed([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, over, strict=True):
        for (leaf, r), path in zip(by[s], paths, strict=True):
            steps = [*path, *top]
            changed = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            node = leaf_of(r, re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) if changed else leaf
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((r.doc_id, leaf, subroot, root, sha("".join("".join(a + b) for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def test_merkle_by_hand(spark, odd):
    for docs in (odd, odd.where("doc_id = 1")):
        assert sorted((tuple(r) for r in M.op11_merkle(docs).collect()), key=str) == merkle_by_hand(docs.collect())
    # sources of 1, 16, 17, 256, 257 and 700 rows, and a null one: runs of one node at every level, two rounds
    sizes = {"a": 1, "b": 16, "c": 17, "d": 256, "é": 257, "Z": 700, None: 3}
    rows = [(k, f"Text {k}" if k % 7 else None, None, s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in M.op11_merkle(docs).collect()), key=str) == merkle_by_hand(docs.collect())


def test_merkle_of_many_sources(spark):
    docs = spark.createDataFrame([(k, "A", None, f"s{k % 290}", 1) for k in range(300)], SCHEMA)
    assert sorted((tuple(r) for r in M.op11_merkle(docs).collect()), key=str) == merkle_by_hand(docs.collect())


def test_empty_tables(spark, empty):
    assert M.op11_merkle(empty).count() == 0
    assert I.op12_importance(empty, empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.op13_warc(pages).count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(g, k % 50, k) for g, n in (("a", 3000), ("b", 1), ("c", 700)) for k in range(n)], "g string, v long, k long")
    got = numbered(rows.repartition(9), ["g"], [rows["v"].desc()]).collect()
    for g, n in (("a", 3000), ("b", 1), ("c", 700)):
        mine = sorted((r.idx, r.v) for r in got if r.g == g)
        assert [i for i, _ in mine] == list(range(n)) and all(r.n == n for r in got if r.g == g)
        assert all(x >= y for (_, x), (_, y) in pairwise(mine))


@given(st.lists(st.lists(st.text(alphabet="abé9ß漢", min_size=1, max_size=40).map(str.encode), max_size=8), max_size=6), st.integers(1, 4))
def test_checksums_of_every_run(docs, longest):
    words = [w for d in docs for w in d]
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    for n, (owner, crc) in enumerate(I.checksums(words, of, longest), 1):
        want = [(k, zlib.crc32(b" ".join(d[i : i + n]))) for k, d in enumerate(docs) for i in range(len(d) - n + 1)]
        assert list(zip(owner.tolist(), crc.tolist(), strict=True)) == want


def test_shift_over_long_texts():
    a, b = b"word " * 3, b"x" * 3_000_001
    assert zlib.crc32(a + b) ^ int(I.shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) == zlib.crc32(b)


def importance_by_hand(docs, target, longest, buckets, percent, least):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    found = [(r.doc_id, *features(r.text)) for r in docs]
    s, t = (np.bincount([b for f in fs for b in f], minlength=buckets) for fs in ([f for _, _, f in found], [features(r.text)[1] for r in target]))
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, n, f in found:
        h = int(sha(f"2024:{'null' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((n >= least, doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    rows.sort(key=lambda r: (not r[0], -r[4], r[1] is not None, r[1] or 0, r[2]))
    drawn = percent * sum(r[0] for r in rows) // 100
    return sorted(((*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_by_hand(spark, odd, documents, sf_dir, longest):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for docs, target, least, percent in ((odd, odd, 5, 50), (documents, benchmark, 20, 10), (odd, benchmark.limit(0), 1, 100)):
        got = I.resample(docs, target, longest=longest, buckets=701, least=least, percent=percent)
        assert sorted((tuple(r) for r in got.collect()), key=str) == importance_by_hand(docs.collect(), target.collect(), longest, 701, percent, least)


PAGES = "page_id long, url string, html string, value string, digest string, n long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


def test_warc_of_odd_pages(spark):
    long, copy = "é漢😀\r\n\r\nWARC/1.1\r\n" * 9000, "<p>copy</p>" * 100
    rows = [(1, "http://a/ b\r\n", long), (2, None, None), (3, "http://a", ""), (4, "http://a", "short"), (5, "http://a", "short"), (6, "u", copy), (9, "u", copy), (9, "u", copy), (9, None, copy), (7, "v", copy)]
    rows += [(None, "u", copy), (None, "u", "x" * 999), (8, "u", "é" * 500), (10, "u", "é" * 500), (11, "u", long), (12, "u", "\x00\x1f" * 600), (None, "n", "y" * 1000), (None, "n", "y" * 1000)]
    got = W.op13_warc(pages_of(spark, rows)).collect()
    assert all(r.digest_holds for r in got)
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    want = c.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({W.oracle()})").fetchall()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_warc_payloads_and_small_segments(spark):
    rows = [(k, f"http://h/{k}", "ü" * k) for k in (0, 1, 63, 64, 65, 127, 128, 500, 5000)]
    folder = shared_folder(spark, "test")
    W.write_archives(pages_of(spark, rows), folder, segment=64, records=10)
    got = W.read_archives(spark, folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {k: html for k, _, html in rows}
    files = spark.read.format("binaryFile").load(folder)
    assert files.count() > 3


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_warc_deals_only_what_lies_in_two_archives(spark):
    rng = random.Random(7)
    rows = [(k, f"http://h/{k}", rng.randbytes(n // 2).hex()) for k, n in enumerate([200_000, 3_000, 90_000, 50, 400_000] * 4)]
    want = {(k, hashlib.sha1(html.encode()).hexdigest()) for k, _, html in rows}
    for records, share in ((4096, 0.05), (60, 0.6)):
        folder = shared_folder(spark, "test")
        W.write_archives(pages_of(spark, rows).coalesce(1), folder, records=records)
        before = shuffled(spark)
        got = W.read_pages(spark, folder).collect()
        assert {(r.page_id, r.payload_digest) for r in got} == want and len(got) == len(rows) and all(r.digest_holds for r in got)
        assert shuffled(spark) - before < share * sum(len(html) for _, _, html in rows)


def test_gathering_keeps_what_is_wrong_for_the_assembler():
    first, row = ("a", "response", 1, None, "d", "a", 1, None, W.HTTP_HEAD), ("b", "continuation", None, None, None, "a", 2, None, b"1\r\nx\r\n")
    last, alone = ("c", "continuation", None, None, None, "a", 3, len(W.HTTP_HEAD) + 11, b"0\r\n\r\n"), ("z", "revisit", 2, "a", "d", "z", None, None, b"")
    whole, told = W.gathered(iter([first, row, last]))
    assert list(W.assembled(iter([whole]))) == [(*first[:5], b"x")] and list(W.assembled(iter([told]))) == []
    for rows in ([first, last], [row, last], [first, row], [first, row, row, last], [last, row, first], [first, row, alone, last], [first, row, (*last[:7], 9, last[8])]):
        assert list(W.gathered(iter([*rows, alone]))) == [*rows, alone]
    # a segment, or the whole record, once more in the same archive or another
    for more in ([first], [row], [last], [told]):
        with pytest.raises(ValueError):
            list(W.assembled(iter(sorted([told, *more], key=lambda r: r[6]))))
    with pytest.raises(ValueError):
        list(W.assembled(W.gathered(iter([first, row, last, last]))))


def test_assembling_refuses_what_is_not_whole():
    first = ("a", "response", 1, None, "d", "a", 1, None, W.HTTP_HEAD)
    last = ("b", "continuation", None, None, None, "a", 2, len(W.HTTP_HEAD) + 5, b"0\r\n\r\n")
    assert [r[-1] for r in W.assembled(iter([first, last]))] == [b""]
    for rows in ([last], [first, (*last[:6], 3, *last[7:])], [first, (*last[:7], 7, last[8])], [first, last, last], [first, (*last[:5], "z", *last[6:])], [(*first[:6], 2, *first[7:])]):
        with pytest.raises(ValueError):
            list(W.assembled(iter(rows)))
    with pytest.raises(ValueError):
        list(W.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_round_trip(payload, size):
    assert W.unchunked(W.chunked(payload, size)) == payload
    with pytest.raises(ValueError):
        W.unchunked(W.chunked(payload, size)[:-5])


def test_chunk_extensions():
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
