"""Importing, listing, resolving and exporting on small literal tables."""

import html
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from readlake.operators import export
from readlake.operators.ingest import (
    ITEM_SCHEMA,
    deduplicate,
    failures,
    links_to_fetch,
    run_import,
    write_failures,
)
from readlake.operators.numbering import number_rows, number_within
from readlake.operators.resolve import (
    check_addresses,
    fetch_for_import,
    host_addresses,
    pick_snapshots,
    resolve_add,
    resolve_import,
    resolve_redirects,
    same_final_page,
)
from readlake.operators.index import Index
from readlake.operators.search import either, matches, term
from readlake.operators.store import Store, list_articles, read_article, tags_for
from readlake.session import scratch_path

NOW = "2025-05-05T05:05:05Z"
FETCHED = "url string, title string, author string, text string, source string, reason string"


def items(spark, *rows):
    """(url, title, added_at, text, tags) in list order."""
    full = [(u, t, None, a, x, g, "list", n) for n, (u, t, a, x, g) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM_SCHEMA)


@pytest.fixture
def store(spark):
    return Store(spark, scratch_path(spark, "store"))


def the_list(spark):
    return items(
        spark,
        ("https://bake.org/rye?utm_medium=mail", "as listed", "2019-03-02T08:00:00Z", None, ["Bread", " slow food", "bread"]),
        ("https://bake.org/gone", None, None, None, ["lost"]),
        ("https://bake.org/kept/", "From the export", None, "text of the export", None),
        ("https://bake.org/old", None, None, None, None),
        ("mailto:baker@bake.org", None, None, None, None),
        ("https://bake.org/rye#crust", "listed twice", None, "later text", ["Rye"]),
    )


def the_web(spark):
    rows = [
        ("https://bake.org/rye", "Rye", "Bo", "flour and water", "live", None),
        ("https://bake.org/old", None, None, "a copy", "wayback", None),
        ("https://bake.org/gone", None, None, None, None, "HTTP Error 410"),
    ]
    # A crawl may have brought a page more than once.
    return spark.createDataFrame([*rows, *rows, ("https://bake.org/rye", "Rye", "Bo", None, None, "timed out")], FETCHED)


def test_import_saves_each_url_once(spark, store):
    result = run_import(store, the_list(spark), the_web(spark), 1, F.lit(NOW))
    assert result.summary().first().asDict() == {
        "saved": 3, "from_export": 1, "from_wayback": 1, "skipped": 1, "failed": 2}
    rows = {r.url: r for r in store.articles().collect()}
    assert store.articles().count() == len(rows) == 3 and sorted(r.id for r in rows.values()) == [1, 2, 3]
    rye = rows["https://bake.org/rye"]
    assert (rye.id, rye.title, rye.author, rye.text, rye.added_at) == (
        1, "Rye", "Bo", "flour and water", "2019-03-02T08:00:00Z")
    assert rows["https://bake.org/old"].added_at == NOW and rows["https://bake.org/kept"].title == "From the export"
    assert [r.tag for r in tags_for(store.tags(), 1).collect()] == ["bread", "rye", "slow food"]
    assert [tuple(r) for r in result.failures().collect()] == [
        ("https://bake.org/gone", "HTTP Error 410"), ("mailto:baker@bake.org", "not an http(s) URL")]
    assert {r.id for r in matches(store.index(), term("copy")).collect()} == {3}


def test_second_import_saves_nothing_but_brings_tags(spark, store):
    run_import(store, the_list(spark), the_web(spark), 1, F.lit(NOW))
    again = items(spark, ("https://bake.org/rye/", None, None, None, ["New"]),
                  ("https://bake.org/kept", None, None, "other", None),
                  ("https://bake.org/kept?ref=z", None, None, "other", None),
                  ("https://bake.org/four", None, None, "four", None))
    result = run_import(store, again, the_web(spark), 2, F.lit(NOW))
    assert result.summary().first().asDict() == {
        "saved": 1, "from_export": 1, "from_wayback": 0, "skipped": 3, "failed": 0}
    assert store.articles().where("url = 'https://bake.org/four'").first().id == 4
    assert "new" in {r.tag for r in tags_for(store.tags(), 1).collect()}

    def state():
        return (sorted(store.articles().collect()), sorted(store.tags().collect()),
                sorted(store.index().document_frequencies().collect()))

    before = state()
    run_import(store, again, the_web(spark), 2, F.lit(NOW))  # the same batch once more
    assert state() == before
    # With another list it replaces all that it wrote: article, index and tags.
    other = items(spark, ("https://bake.org/five", None, None, "fifth", ["five"]))
    run_import(store, other, the_web(spark), 2, F.lit(NOW))
    assert {r.url for r in store.articles().where("batch_id = 2").collect()} == {"https://bake.org/five"}
    assert {r.tag for r in store.tags().where("batch_id = 2").collect()} == {"five"}
    assert [matches(store.index(), term(w)).count() for w in ("four", "fifth")] == [0, 1]
    run_import(store, other.limit(0), the_web(spark), 2, F.lit(NOW))
    assert store.articles().count() == 3 and store.tags().where("batch_id = 2").count() == 0


def test_one_url_as_a_third_of_the_list(spark):
    rows = [("https://e.org/hot", f"t{n}", None, None, [f"tag{n}"]) if n % 3 else
            (f"https://e.org/{n}", None, None, None, None) for n in range(300)]
    got = {r.url: r for r in deduplicate(items(spark, *rows)).collect()}
    assert got["https://e.org/hot"].n_items == 200 and got["https://e.org/hot"].title == "t1"
    assert len(got) == 101


def test_failure_report(spark, store, tmp_path):
    done = run_import(store, the_list(spark), the_web(spark), 1, F.lit(NOW)).outcomes
    assert failures(done, 1).count() == 1
    write_failures(done, str(tmp_path / "failures"))
    lines = [line for f in sorted((tmp_path / "failures").glob("*.csv")) for line in f.read_text().splitlines()]
    assert lines == ["https://bake.org/gone\tHTTP Error 410", "mailto:baker@bake.org\tnot an http(s) URL"]


def test_list_filter_and_read(spark, store):
    run_import(store, the_list(spark), the_web(spark), 1, F.lit(NOW))
    rows = list_articles(store.articles(), store.tags()).collect()
    assert [r.id for r in rows] == [2, 3, 1]
    assert rows[2].tags == "bread, rye, slow food" and rows[0].tags is None
    assert rows[1].name == "https://bake.org/old"
    assert [r.id for r in list_articles(store.articles(), store.tags(), " BREAD ").collect()] == [1]
    assert list_articles(store.articles(), store.tags(), "none").count() == 0
    assert list_articles(store.articles(), store.tags(), "  ").count() == 3
    assert read_article(store.articles(), 1).first().text == "flour and water"
    assert read_article(store.articles(), 99).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v"))
    rows = number_rows(df, ["k"], F.lit(5)).orderBy("k").collect()
    assert [r.id for r in rows] == list(range(5, 1005))
    grouped = df.withColumn("g", F.when(F.col("k") < 700, "hot").otherwise((F.col("k") / 10).cast("int").cast("string")))
    got = number_within(grouped, "g", [F.desc("k")], "k", "n").where("g = 'hot'").orderBy("n").collect()
    assert [(r.n, r.k) for r in got] == [(n + 1, 699 - n) for n in range(700)]


# -- content -------------------------------------------------------------------


def live_pages(spark):
    return spark.createDataFrame([
        ("ok", 200, None, "T", None, "text"), ("empty", 200, None, None, None, None),
        ("refused", 403, None, None, None, None), ("gone", 410, "HTTPError: gone", None, None, None),
        ("teapot", 418, None, None, None, None), ("broken", 502, None, None, None, None),
        ("offline", None, "no route", None, None, None),
    ], "url string, status int, error string, title string, author string, text string")


def copies(spark):
    urls = ["empty", "refused", "teapot", "broken", "offline"]
    return spark.createDataFrame([(u, "A", None, "old") for u in urls],
                                 "url string, title string, author string, text string")


def outcome(df):
    return {r.url: r.source or r.reason for r in df.collect()}


def test_import_rule(spark):
    urls = live_pages(spark).select("url")
    got = outcome(resolve_import(urls, live_pages(spark), copies(spark)))
    assert got == {"ok": "live", "empty": "wayback", "refused": "wayback", "gone": "HTTPError: gone",
                   "teapot": "wayback", "broken": "wayback", "offline": "wayback"}
    alone = outcome(resolve_import(urls, live_pages(spark), copies(spark), use_archive=False))
    assert alone == {"ok": "live", "empty": "no article text", "refused": "HTTP Error 403",
                     "gone": "HTTPError: gone", "teapot": "HTTP Error 418", "broken": "HTTP Error 502",
                     "offline": "no route"}


def test_fetch_for_import_extracts_what_is_needed(spark):
    page = "<article><h1>{0}</h1><p>{0} text</p></article>"
    responses = spark.createDataFrame(
        [("a", 200, None, page.format("live")), ("b", 200, None, "<p>"), ("c", 404, None, None),
         ("not asked", 200, None, page.format("no"))],
        "url string, status int, error string, html string")
    kept = spark.createDataFrame([(u, page.format("old")) for u in "abx"], "url string, html string")
    urls = spark.createDataFrame([(u,) for u in "abc"], "url string")
    got = {r.url: (r.title, r.text, r.source, r.reason) for r in fetch_for_import(urls, responses, kept).collect()}
    assert got == {"a": ("live", "live text", "live", None), "b": ("old", "old text", "wayback", None),
                   "c": (None, None, None, "HTTP Error 404")}


def test_only_new_links_are_fetched(spark, store):
    run_import(store, the_list(spark), the_web(spark), 1, F.lit(NOW))
    more = items(spark, ("https://bake.org/rye", None, None, None, None), ("https://bake.org/n/", None, None, None, None),
                 ("https://bake.org/t", None, None, "text", None), ("ftp://bake.org", None, None, None, None))
    assert [r.url for r in links_to_fetch(more, store.articles()).collect()] == ["https://bake.org/n"]


def test_repeated_responses_do_not_multiply_rows(spark):
    live = live_pages(spark)
    more = spark.createDataFrame([("ok", 500, None, "no", None, None), ("ok", 200, None, None, None, None),
                                  ("refused", None, "reset", None, None, None)], live.schema)
    urls = live.select("url")
    got = resolve_import(urls.union(urls), live.union(live).union(more), copies(spark).union(copies(spark))).collect()
    assert len(got) == live.count() and {r.url: r.title for r in got}["ok"] == "T"


def test_add_rule(spark):
    got = outcome(resolve_add(live_pages(spark).select("url"), live_pages(spark), copies(spark)))
    assert got == {"ok": "live", "empty": "no article text", "refused": "wayback", "gone": "HTTPError: gone",
                   "teapot": "HTTP Error 418", "broken": "wayback", "offline": "no route"}


def test_snapshots(spark):
    df = spark.createDataFrame([
        ("a", True, "http://web.archive.org/web/1/http://a", "200", "1"),
        ("a", True, "http://web.archive.org/web/2/http://a", "404", "2"),
        ("b", True, "http://web.archive.org/web/3/http://b", "200", "3"),
        ("c", False, "http://web.archive.org/web/3/http://c", "200", "3"),
        ("d", True, None, "200", "3"),
    ], "url string, available boolean, snapshot_url string, status string, timestamp string")
    assert [tuple(r) for r in pick_snapshots(df).collect()] == [("b", "https://web.archive.org/web/3id_/http://b")]


def test_redirects(spark):
    urls = spark.createDataFrame([("http://s.org/1",), ("http://e.org/a/",), ("http://s.org/2?utm_term=x",)], "url string")
    hops = spark.createDataFrame([("http://s.org/1/", 1, "http://x.org"), ("http://s.org/1", 2, "https://e.org/a/?ref=q"),
                                  ("http://s.org/2", 1, "https://e.org/a#z")], "url string, hop int, target string")
    resolved = resolve_redirects(urls, hops)
    got = {r.url: (r.given_url, r.final_url) for r in resolved.collect()}
    assert got == {"http://s.org/1": ("http://s.org/1", "https://e.org/a"),
                   "http://e.org/a/": ("http://e.org/a", "http://e.org/a"),
                   "http://s.org/2?utm_term=x": ("http://s.org/2", "https://e.org/a")}
    assert [tuple(r) for r in same_final_page(resolved).collect()] == [("https://e.org/a", 2)]


def test_redirect_chains(spark):
    """Across pages, whatever the spelling; circles end at their smallest page."""
    chain = [(f"http://c.org/{n}?utm_source=z", 1, f"http://c.org/{n + 1}/") for n in range(70)]
    circles = [("http://o.org/b", 1, "http://o.org/c"), ("http://o.org/c", 1, "http://o.org/a"),
               ("http://o.org/a", 1, "http://o.org/b"), ("http://o.org/tail", 1, "http://o.org/c"),
               ("http://t.org/2", 1, "http://t.org/1"), ("http://t.org/1", 1, "http://t.org/2"),
               ("http://s.org/self", 1, "http://s.org/self/?ref=x")]
    hops = spark.createDataFrame([*chain, *circles], "url string, hop int, target string")
    urls = [f"http://c.org/{n}" for n in (0, 1, 33, 69, 70)] + [u for u, _, _ in circles] + ["http://none.org/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.final_url for r in resolve_redirects(df, hops).collect()}
    assert {u: got[u] for u in urls[:5]} == dict.fromkeys(urls[:5], "http://c.org/70")
    assert {got[u] for u, _, _ in circles[:4]} == {"http://o.org/a"}
    assert {got[u] for u, _, _ in circles[4:6]} == {"http://t.org/1"}
    assert got["http://s.org/self"] == "http://s.org/self" and got["http://none.org/"] == "http://none.org/"
    # The guard follows them too.
    ips = [("c.org", "93.184.216.34"), ("o.org", "8.8.8.8"), ("t.org", "8.8.8.8"), ("s.org", "8.8.8.8"),
           ("none.org", "8.8.4.4"), ("in.org", "10.0.0.1")]
    inside = spark.createDataFrame([("http://c.org/70", 1, "http://in.org/"), ("http://c.org/70", 2, "http://s.org/x")], hops.schema)
    hosts = spark.createDataFrame(ips, "host string, ip string")
    reasons = {r.url: r.reason for r in check_addresses(df, hops.union(inside), hosts).collect()}
    assert {reasons[u] for u in urls[:5]} == {"internal-host in.org"} and {reasons[u] for u in urls[5:]} == {None}


def test_addresses(spark):
    cases = {"http://fine.org/": None, "http://loop/x": "internal-host loop", "http://cloud.org/": "internal-host cloud.org",
             "http://mixed.org/": "internal-host mixed.org", "http://six.org/": "internal-host six.org",
             "http://six-ok.org/": None, "http://odd.org/": "internal-host odd.org",
             "http://none.org/": "internal-host none.org", "http://unknown.org/": "unknown-host unknown.org",
             "http:///path": "hostless", "ftp://fine.org/x": "not-web"}
    # However a url that redirects inside is spelled, it is refused.
    spellings = ["http://hop.org/x", "http://hop.org/x/", "http://hop.org/x?utm_source=q", "http://hop.org/x#part"]
    cases |= {url: "internal-host loop" for url in spellings}
    ips = [("fine.org", "93.184.216.34"), ("loop", "127.0.0.1"), ("cloud.org", "169.254.169.254"),
           ("mixed.org", "93.184.216.34"), ("mixed.org", "10.0.0.5"), ("six.org", "fd00::1"),
           ("six-ok.org", "2606:4700::1111"), ("hop.org", "93.184.216.34"), ("odd.org", "93.184.216.34"),
           ("odd.org", "999.1.1.1"), ("none.org", None)]
    got = check_addresses(
        spark.createDataFrame([(u,) for u in cases], "url string"),
        spark.createDataFrame([("http://hop.org/x/", 1, "http://loop:8080/")], "url string, hop int, target string"),
        spark.createDataFrame(ips, "host string, ip string"))
    rows = {r.url: r for r in got.collect()}
    assert {u: r.reason for u, r in rows.items()} == cases
    assert all(r.safe == (r.reason is None) for r in rows.values())


def test_addresses_beside_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    texts = ["0.0.0.0", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "", "x", "::", "::1", "1::2::3", ":::", "12345::", "g::",
             "2001:db8::1", "2001:4860:4860::8888", "2001:1::1", "2001:1::3", "2001:20::1", "2001:2f:ffff::", "2001:30::",
             "2001:4:112::1", "2001:200::", "2002::1", "3fff:fff::1", "3fff:1000::", "fe80::1", "ff02::1", "fec0::1",
             "2600::1.2.3.4", "2600::1.2.3.400", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "2600:1:2:3:4:5:6::", "64:ff9b::1"]
    texts += [".".join(str(rng.choice([0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(150)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)]
    texts += [str(ipaddress.IPv6Address((rng.choice([0x2001, 0x2002, 0x2600, 0x3FFF, 0xFE80]) << 112) | rng.getrandbits(112))) for _ in range(60)]

    def blocked(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return True
        return (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast
                or ip.is_unspecified or ip.version == 6 and (
                    ip not in ipaddress.ip_network("2000::/3") or ip in ipaddress.ip_network("3fff::/20")))

    df = spark.createDataFrame([(f"h{k}", text) for k, text in enumerate(texts)], "host string, ip string")
    got = {r.host: r.blocked for r in host_addresses(df).collect()}
    wrong = [(text, got[f"h{k}"]) for k, text in enumerate(texts) if got[f"h{k}"] != blocked(text)]
    assert wrong == []


# -- exports -------------------------------------------------------------------


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([
        (1, "https://e.org/1", 'Soup & "bread"', "Ann & Bob", "One.\n\n  Two <b>.\n", "2024-01-01T00:00:00Z"),
        (2, "https://e.org/2", 'Soup & "bread"', None, "Other two", "2024-01-03T00:00:00Z"),
        (3, "https://e.org/3", "", None, "Third", "2024-01-02T00:00:00Z"),
    ], "id bigint, url string, title string, author string, text string, added_at string")


def test_markdown_files(spark, three, tmp_path):
    export.write_files(export.markdown(three), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [
        "0001-soup-bread.md", "0002-soup-bread.md", "0003-httpseorg3.md"]
    assert (tmp_path / "0001-soup-bread.md").read_text(encoding="utf-8") == (
        '---\ntitle: "Soup & \\"bread\\""\nurl: "https://e.org/1"\nauthor: "Ann & Bob"\n'
        'saved: "2024-01-01T00:00:00Z"\n---\n\n# Soup & "bread"\n\nOne.\n\nTwo <b>.\n')


def test_an_export_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([("a", "x"), ("b", "é")], "path string, content string").repartition(2)
    bad = good.withColumn("path", F.when(F.col("path") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="stop"):
        export.write_files(bad, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    export.write_files(good, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="has files"):
        export.write_files(good, str(tmp_path / "out"))
    export.write_files(good.limit(1).withColumn("path", F.lit("c")), str(tmp_path / "out"), add=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b", "c"] and len(list(tmp_path.iterdir())) == 1
    export.write_files(good.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_chapters_are_newest_first_and_well_formed(three):
    rows = export.chapters(export.by_month(three)).orderBy("n").collect()
    assert [(r.id, r.file) for r in rows] == [(2, "a1.xhtml"), (3, "a2.xhtml"), (1, "a3.xhtml")]
    for row in rows:
        xml.dom.minidom.parseString(row.content.encode())
    assert "Ann &amp; Bob · 2024-01-01<br/>" in rows[2].content
    assert "<p>One.</p><p>Two &lt;b&gt;.</p>" in rows[2].content
    assert rows[1].name == "https://e.org/3" and f"<h1>{html.escape(rows[0].name)}</h1>" in rows[0].content
    toc = export.table_of_contents(export.by_month(three)).orderBy("n").collect()
    assert toc[1].nav == '<li><a href="a2.xhtml">https://e.org/3</a></li>'
    assert toc[2].spine == '<itemref idref="c3"/>'


def test_export_order_and_search(spark, three):
    assert [r.id for r in export.select_articles(three).collect()] == [2, 3, 1]
    with pytest.raises(ValueError):
        export.select_articles(three, None, term("one"))


def test_a_book_of_a_search_is_in_rank_order(spark, three, tmp_path):
    index = Index.of(three)
    found = export.select_articles(three, index, either(term("two"), term("one")))
    ranked = {r.id: r.rank for r in found.collect()}
    scores = {r.id: r.score for r in matches(index, either(term("two"), term("one"))).collect()}
    assert sorted(ranked, key=ranked.get) == sorted(scores, key=lambda i: (scores[i], i)) and len(ranked) == 2
    rows = export.chapters(export.whole_book(found, "soups")).orderBy("n").collect()
    assert [r.id for r in rows] == sorted(ranked, key=ranked.get)
    toc = export.table_of_contents(export.whole_book(found, "soups")).orderBy("n").collect()
    assert [r.n for r in toc] == [1, 2]
    assert {r.id: r["rank"] for r in export.markdown(found).collect()} == ranked
