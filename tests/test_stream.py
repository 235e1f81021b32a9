"""Captures through the stream: outcomes, first-wins, replays and the index."""

import pytest
from pyspark.sql import functions as F

from readlake.operators.search import matches, term
from readlake.operators.store import Store
from readlake.plans import catalog
from readlake.session import list_names, scratch_path
from readlake.streaming import capture
from readlake.streaming.capture import Web, capture_stream, read_captures, save_captures



def NOW():
    return F.lit("2025-05-05T05:05:05Z")

PAGE = "<html><body><article><h1>{0}</h1><p>{1} paragraph</p></article></body></html>"


def put(spark, folder, *rows):
    data = [(n, url, html, f"2025-01-01 00:00:{n % 60:02d}") for n, url, html in rows]
    df = spark.createDataFrame(data, "event_id bigint, url string, html string, captured_at string")
    df.coalesce(1).write.mode("append").json(folder)


def outcomes(store):
    return {r.event_id: (r.ok, r.reason, r.id) for r in capture.read_outcomes(store).collect()}


@pytest.fixture
def place(spark):
    root = scratch_path(spark, "stream")
    return root, Store(spark, f"{root}/store")


def test_stream_outcomes_and_first_wins(spark, place):
    root, store = place
    put(spark, f"{root}/in",
        (1, "https://e.org/a?utm_source=x", PAGE.format("A", "first")),
        (2, "https://e.org/a/", PAGE.format("A2", "second")),
        (3, "file:///etc/passwd", PAGE.format("no", "no")),
        (4, None, PAGE.format("no", "no")),
        (5, "https://e.org/empty", "<html></html>"),
        (6, "https://e.org/b", PAGE.format("B", "other")))
    put(spark, f"{root}/in", (7, "https://e.org/b#x", PAGE.format("B", "other")),
        (8, "https://e.org/empty", PAGE.format("C", "now")))

    def run():
        stream = read_captures(spark, f"{root}/in", files_per_batch=1)
        capture_stream(stream, store, f"{root}/checkpoint", NOW()).awaitTermination()

    run()
    assert outcomes(store) == {
        1: (True, None, 1), 2: (False, "already saved", None), 3: (False, "unsupported URL scheme", None),
        4: (False, "no url given", None), 5: (False, "no article text", None), 6: (True, None, 2),
        7: (False, "already saved", None), 8: (True, None, 3)}
    assert {r.id for r in matches(store.index(), term("paragraph")).collect()} == {1, 2, 3}
    assert {r.id for r in matches(store.index(), term("second")).collect()} == set()
    put(spark, f"{root}/in", (9, "https://e.org/late", PAGE.format("D", "late")))
    run()  # goes on where it stopped
    assert outcomes(store)[9] == (True, None, 4) and store.articles().count() == 4


def test_replayed_batch_changes_nothing(spark, place):
    _, store = place
    rows = [(n, f"https://e.org/{n % 3}", PAGE.format(n, "some"), None) for n in range(9)]
    df = spark.createDataFrame(rows, capture.CAPTURE_SCHEMA)
    first = sorted(save_captures(store, df.where("event_id < 4"), 0, NOW()).collect())
    save_captures(store, df.where("event_id >= 4"), 1, NOW())
    before = sorted(store.articles().collect())
    assert sorted(save_captures(store, df.where("event_id < 4"), 0, NOW()).collect()) == first
    assert sorted(store.articles().collect()) == before and len(before) == 3
    assert store.index().corpus().first().n_docs == 3


def test_a_batch_that_runs_again_with_other_pages_replaces_the_first(spark, place):
    _, store = place

    def batch(*rows):
        full = [(n, f"https://e.org/{n}", PAGE.format(n, word), None) for n, word in rows]
        return spark.createDataFrame(full, capture.CAPTURE_SCHEMA)

    save_captures(store, batch((1, "alpha"), (2, "beta")), 0, NOW())
    save_captures(store, batch((3, "gamma")), 1, NOW())
    save_captures(store, batch((1, "zulu")), 0, NOW())
    assert {r.id: r.url for r in store.articles().collect()} == {1: "https://e.org/1", 3: "https://e.org/3"}
    assert {w: matches(store.index(), term(w)).count() for w in ("alpha", "beta", "gamma", "zulu")} == {
        "alpha": 0, "beta": 0, "gamma": 1, "zulu": 1}
    assert store.index().corpus().first().n_docs == 2
    save_captures(store, batch(), 0, NOW())
    assert [r.id for r in store.articles().collect()] == [3] and outcomes(store).keys() == {3}
    folders = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/articles/batch_id=*/generation=*")
    files = folders.getFileSystem(spark._jsc.hadoopConfiguration())
    assert len(files.globStatus(folders)) == 4
    store.vacuum()
    assert len(files.globStatus(folders)) == 2 and store.articles().count() == 1


def test_merged_batches_read_the_same_and_are_closed(spark, place):
    _, store = place
    for n in range(4):
        df = spark.createDataFrame([(n, f"https://e.org/{n}", PAGE.format(n, f"word{n} some"), None)], capture.CAPTURE_SCHEMA)
        save_captures(store, df, n, NOW())

    def state():
        return (sorted(store.articles().drop("batch_id").collect()), outcomes(store), store.index().corpus().first(),
                sorted(store.index().document_frequencies().collect()),
                sorted((r.term, r.id, r.dl, r.at) for r in store.index().postings.collect()))

    before = state()
    store.merge([0, 1, 2])
    assert state() == before and store.last_id() == 4
    store.vacuum()
    assert state() == before
    with pytest.raises(ValueError, match="merged"):
        save_captures(store, spark.createDataFrame([], capture.CAPTURE_SCHEMA), 1, NOW())
    with pytest.raises(ValueError):
        store.merge([3, 77])
    df = spark.createDataFrame([(9, "https://e.org/9", PAGE.format(9, "more"), None)], capture.CAPTURE_SCHEMA)
    assert [r.id for r in save_captures(store, df, 4, NOW()).collect()] == [5]


def test_a_stream_of_many_small_batches_is_compacted(spark, place):
    root, store = place
    for n in range(6):
        put(spark, f"{root}/in", (n, f"https://e.org/{n % 5}", PAGE.format(n, f"word{n}")))
    stream = read_captures(spark, f"{root}/in", files_per_batch=1)
    capture_stream(stream, store, f"{root}/checkpoint", NOW(), compact_every=5).awaitTermination()
    state = store.batches.state()
    assert len(state.valid) <= 3 and 5 in state.valid and state.closed == ((0, 3),)
    assert {n: r[0] for n, r in outcomes(store).items()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}
    assert sorted(r.id for r in store.articles().collect()) == [1, 2, 3, 4, 5]
    assert {matches(store.index(), term(f"word{n}")).count() for n in range(5)} == {1}


def test_a_replay_after_later_batches_keeps_ids_and_urls_unique(spark, place):
    _, store = place

    def batch(*names):
        rows = [(n, f"https://e.org/{name}", PAGE.format(name, "some"), None) for n, name in enumerate(names)]
        return spark.createDataFrame(rows, capture.CAPTURE_SCHEMA)

    save_captures(store, batch("a", "b"), 0, NOW())
    save_captures(store, batch("c", "d"), 1, NOW())
    done = save_captures(store, batch("b", "e", "c"), 0, NOW())
    assert {r.url[-1]: (r.ok, r.reason, r.id) for r in done.collect()} == {
        "b": (True, None, 2), "e": (True, None, 5), "c": (False, "already saved", None)}
    assert {r.url[-1]: r.id for r in store.articles().collect()} == {"b": 2, "c": 3, "d": 4, "e": 5}


def test_links_are_added_as_a_batch(spark, place):
    _, store = place
    web = Web(
        spark.createDataFrame([("https://in.org/a", 200, None, PAGE.format("A", "inner")),
                               ("https://in.org/a", 500, "again", None)],
                              "url string, status int, error string, html string"),
        spark.createDataFrame([], "url string, html string"),
        spark.createDataFrame([], "url string, hop int, target string"),
        spark.createDataFrame([("in.org", "10.1.1.1")], "host string, ip string"))
    links = spark.createDataFrame([(1, "https://in.org/a/?ref=x"), (2, "https://in.org/a"), (3, "https://in.org/none"),
                                   (4, "gopher://x"), (5, None)], "event_id bigint, url string")
    got = {r.event_id: (r.ok, r.reason, r.id) for r in capture.add_links(store, links, web, 0, NOW()).collect()}
    assert got == {1: (True, None, 1), 2: (False, "already saved", None), 3: (False, "no response", None),
                   4: (False, "unsupported URL scheme", None), 5: (False, "no url given", None)}
    guarded = capture.add_links(store, links, web, 1, NOW(), guard=True).where("event_id <= 3").collect()
    assert {r.reason for r in guarded} == {"internal-host in.org"}


def test_size_limit(spark):
    df = spark.createDataFrame([(1, "https://e.org", "é" * 10, None), (2, "https://e.org", "é" * 11, None)],
                               capture.CAPTURE_SCHEMA)
    assert [r.refused for r in capture.check_captures(df, 20).orderBy("event_id").collect()] == [
        None, "missing or oversized body"]


def test_named_pages_are_guarded_and_looked_up(spark, place):
    _, store = place
    page = PAGE.format("T", "fetched")
    web = Web(
        spark.createDataFrame([
            ("https://pub.org/a", 200, None, page), ("https://pub.org/short", 200, None, page),
            ("https://pub.org/refused", 403, None, None), ("https://pub.org/down", None, "timed out", None),
            ("https://local.org/", 200, None, page), ("https://pub.org/sneaky", 200, None, page),
        ], "url string, status int, error string, html string"),
        spark.createDataFrame([("https://pub.org/refused", PAGE.format("Old", "archived")),
                               ("https://pub.org/down", page)], "url string, html string"),
        spark.createDataFrame([("https://pub.org/short", 1, "https://pub.org/final?ref=s"),
                               ("https://pub.org/sneaky", 1, "http://local.org/")],
                              "url string, hop int, target string"),
        spark.createDataFrame([("pub.org", "93.184.216.34"), ("local.org", "192.168.1.1")], "host string, ip string"))
    names = ["a", "short", "refused", "down", "sneaky"]
    rows = [(n, f"https://pub.org/{name}", None, None) for n, name in enumerate(names)]
    rows += [(5, "https://local.org/", None, None), (6, "https://pub.org/a", None, None)]
    done = save_captures(store, spark.createDataFrame(rows, capture.CAPTURE_SCHEMA), 0, NOW(), web)
    got = {r.event_id: (r.ok, r.url, r.reason) for r in done.collect()}
    blocked = "internal-host local.org"
    assert got == {
        0: (True, "https://pub.org/a", None), 1: (True, "https://pub.org/final", None),
        2: (True, "https://pub.org/refused", None), 3: (False, "https://pub.org/down", "timed out"),
        4: (False, "http://local.org/", blocked), 5: (False, "https://local.org/", blocked),
        6: (False, "https://pub.org/a", "already saved")}
    assert {r.title for r in store.articles().collect()} == {"T", "Old"}


def test_repeats_within_the_watermark(spark, place):
    root, _ = place
    put(spark, f"{root}/in", (1, "https://e.org/a", "x"), (2, "https://e.org/a/", "x"), (3, "https://e.org/b", "x"))
    stream = capture.first_captures(read_captures(spark, f"{root}/in"))
    query = (stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True)
             .option("checkpointLocation", f"{root}/checkpoint").start())
    query.awaitTermination()
    assert sorted(r.url for r in spark.table("firsts").collect()) == ["https://e.org/a", "https://e.org/b"]


def test_captures_come_in_as_many_files_as_there_are_pages_to_write(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "_written", {})
    monkeypatch.setattr(catalog, "INBOX_SHARE", 1 << 16, raising=False)
    tables = catalog.Tables(spark, sf)
    folder, n = catalog._inbox(tables)
    files = [name for name in list_names(spark, folder) if name.startswith("part-")]
    assert n > 2 and n < len(files) <= 2 * n  # two deliveries
    rows = spark.read.json(folder).groupBy(F.input_file_name()).count()
    assert rows.agg(F.max("count")).first()[0] < tables["events"].count() / 4


def test_captures_are_written_where_their_pages_are(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "_written", {})
    monkeypatch.setattr(catalog, "INBOX_SHARE", 1 << 16)
    tables = catalog.Tables(spark, sf)
    folder, n = catalog._inbox(tables)
    files = [name for name in list_names(spark, folder) if name.startswith("part-")]
    assert all(name.endswith(".json.gz") for name in files)
    wanted = tables.sql(catalog._CAPTURES).select("event_id", "url", "html")
    got = spark.read.schema(capture.CAPTURE_SCHEMA).json(folder)
    assert got.where("captured_at IS NULL").isEmpty()
    assert sorted(map(tuple, got.select("event_id", "url", "html").collect())) == sorted(map(tuple, wanted.collect()))
    sent = got.withColumn("file", F.input_file_name()).where(F.length("html") > 3)
    assert sent.groupBy("html").agg(F.count_distinct("file").alias("n")).agg(F.max("n")).first()[0] <= 2  # deliveries


def test_a_batch_keeps_a_page_that_comes_again_once(spark, place, monkeypatch):
    root, store = place
    page, other = PAGE.format("A", "same"), PAGE.format("B", "other")
    rows = [(k, f"https://e.org/{k}", page if k % 2 else other, None) for k in range(40)]
    rows += [(40, "file:///x", page, None), (41, "https://e.org/named", "", None), (42, None, None, None), (1, "https://e.org/1", page, None)]
    kept = []
    write = capture.Scratch.write

    def watched(self, df, name):
        out = write(self, df, name)
        if name == "batch":
            kept.append(out.where(F.coalesce(F.col("html"), F.lit("")) != "").count())
        return out

    monkeypatch.setattr(capture.Scratch, "write", watched)
    captures = spark.createDataFrame(rows, capture.CAPTURE_SCHEMA).coalesce(1)
    done = {(r.event_id, r.ok, r.reason) for r in save_captures(store, captures, 0, NOW()).collect()}
    assert kept == [2]
    assert done == {(k, True, None) for k in range(40)} | {
        (40, False, "unsupported URL scheme"), (41, False, "no response"), (42, False, "no url given")}
    assert {r.id: r.title for r in store.articles().collect()} == {k + 1: "BA"[k % 2] for k in range(40)}


def test_a_task_forgets_pages_without_losing_any(monkeypatch):
    monkeypatch.setattr(capture, "REMEMBERED", 1)
    part = capture.pa.RecordBatch.from_pydict({"content_key": list("012012"), "html": list("abcabc")})
    got = [b.column("html").to_pylist() for b in capture._pages_once(iter([part, part, part.slice(0, 0)]))]
    assert got == [[*"abc", None, None, None], [*"abc", None, None, None], []]
