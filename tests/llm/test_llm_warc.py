"""Archives: an exact round trip, and the index."""

import collections
import glob
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from readlake.llm import warc

BIG = "é" * 600


def pages():
    rng = random.Random(11)
    rows = [
        (1, "http://A.Example.com/x y", BIG),
        (2, "http://a.example.com/x", BIG),
        (3, None, BIG),
        (None, "http://b.c/", BIG),
        (4, "mailto:x", "small"),
        (5, "http://a.example.com/x", None),
        (5, "http://a.example.com/x", None),
        (6, "http://u@h.com:80/?q#f", "small"),
        (7, "http://a.example.com/", ""),
        (7, "http://a.example.com/", "x" * 1000),
        (-3, "http://z/", "y\r\n\r\nz" * 300),
        (8, "", "\r\n\r\n" * 300),
        (9, "line\nbreak\t", "x" * 999),
        (10, "http://a.example.com/x", "x" * 999),
        (None, "http://only.null/", "q" * 1200),
        (None, None, "q" * 1200),
    ]
    bodies = ["".join(rng.choice("<p>ab é") for _ in range(rng.choice([10, 1500]))) for _ in range(12)]
    return rows + [(100 + k, f"http://h{k % 5}.example.org/{k % 7}", rng.choice(bodies)) for k in range(80)]


def brute(rows):
    largest = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and page is not None:
            largest[raw] = max(page, largest.get(raw, page))
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        first = largest.get(raw)
        revisit = first is not None and first != page
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(4)
    return df.selectExpr("*", "'clash' AS key", "'clash' AS digest", "1 AS `size`", "2 AS payload", "3 AS refers_to", "4 AS file")


def test_round_trip(table, tmp_path):
    found = warc.archive_and_read(table, str(tmp_path), with_payload=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(brute(pages()), key=str)
    texts = collections.defaultdict(set)
    for page, _, html in pages():
        texts[page].add((html or "").encode())
    for r in found:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) in texts[r.page_id]


def test_files_are_members_of_their_own(table, tmp_path):
    records = warc.write_archive(table, str(tmp_path), file_bytes=2000).collect()
    assert len(records) == len(pages()) and len({r.file for r in records}) > 4
    for name in {r.file for r in records}:
        mine = sorted((r for r in records if r.file == name), key=lambda r: r.offset)
        raw = open(name, "rb").read()
        assert [r.offset for r in mine] == [0, *(r.offset + r.length for r in mine)][:-1]
        assert mine[-1].offset + mine[-1].length == len(raw)
        whole = gzip.decompress(raw)
        assert whole == b"".join(zlib.decompress(raw[r.offset : r.offset + r.length], 31) for r in mine)
        assert whole.count(b"WARC/1.1\r\n") == len(mine)


def test_index(spark, table, tmp_path):
    records = warc.write_archive(table, str(tmp_path))
    parts = warc.write_index(records, str(tmp_path), block_lines=4).collect()
    index = warc.Index([tuple(p) for p in parts])
    rows = records.collect()
    for key in {r.key for r in rows}:
        want = sorted((r.file, r.offset, r.length) for r in rows if r.key == key)
        assert sorted((f["file"], f["offset"], f["length"]) for f in index.find(key, any_page=True)) == want
    for r in rows:
        want = sorted((x.file, x.offset, x.length) for x in rows if (x.key, x.page_id) == (r.key, r.page_id))
        assert sorted((f["file"], f["offset"], f["length"]) for f in index.find(r.key, r.page_id)) == want
    assert list(index.find("com,example,a)/none", any_page=True)) == list(index.find("~", 1)) == list(index.find("", 99)) == []
    for name in glob.glob(f"{tmp_path}/index/*.cdx.gz"):
        lines = gzip.open(name, "rt").read().splitlines()
        assert lines == sorted(lines)
    before = index.reads
    list(index.find("org,example,h1)/1", any_page=True))
    assert index.reads - before <= 1 + len(rows) // 4 // 4


def test_sort_key(spark):
    cases = {
        "http://Www.Example.COM/a?b#c": "com,example,www)/a?b#c",
        "https://u:p@x.y:8080/a b": "y,x):8080/a%20b",
        "http://host": "host)",
        "mailto:a@b": "mailto:a@b",
        None: "-",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert [r[0] for r in df.select(warc.sort_key(F.col("url"))).collect()] == list(cases.values())


def test_empty(table, tmp_path):
    assert warc.archive_and_read(table.limit(0), str(tmp_path)).count() == 0
