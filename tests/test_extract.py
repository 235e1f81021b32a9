"""Extraction: literal pages, and invariants over the whole test pages."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from readlake.operators import extract
from readlake.operators.extract import (
    boilerplate_blocks,
    explode_blocks,
    extract_articles,
    extract_corpus,
    page_links,
    page_titles,
    parse_pages,
)

ARTICLE = """<!doctype html><html><head><title>Some Site: not the title</title>
<script>var x = "</p><article><p>no</p>";</script></head><body>
<nav><a href="/">Home</a> <a href="/about">About</a></nav>
<header><div class="logo">LOGO</div></header>
<article><h1>Keeping a Copy &amp; Reading It</h1><p class="byline">By Alex Example</p>
<time datetime="2026-01-02">January 2026</time>
<p>The first paragraph goes on
over a line end, with a <a href="/x">link</a> in it.</p><p>The second one.
<h2>A part</h2><p>The third &copy; one.</article>
<aside class="related"><h3>More</h3><a href="/o">Other post</a></aside>
<footer>All rights reserved.</footer></body></html>"""
VERSES = [f"Verse {n} begins\n  and is wrapped\nby its editor, ¶¶¶ and all" for n in range(4)]
BR_PAGE = "<body><table><tr><td>" + "<br><BR />\n".join(VERSES) + "<br>a last line</td></tr></table>"
FALLBACK = "<html><head><title>T</title></head><body><div>{0}</div><div>{1}</div><div><a href='/a'>{2}</a></div></body></html>"
LONG = "This is a long enough paragraph number {} that nobody repeats anywhere."


def pages(spark, *bodies, host="https://h{}.org/x"):
    rows = [(i, host.format(i) if "{}" in host else f"{host}{i}", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_article_page(spark):
    row = extract_articles(pages(spark, ARTICLE)).first()
    assert row.title == "Keeping a Copy & Reading It" and row.author == "Alex Example"
    assert row.text.split("\n") == [
        "The first paragraph goes on over a line end, with a link in it.", "The second one.",
        "A part", "The third © one."]


def test_breaks_end_paragraphs(spark):
    row = extract_articles(pages(spark, BR_PAGE)).first()
    assert row.text.split("\n") == [
        *(f"Verse {n} begins and is wrapped by its editor, ¶¶¶ and all" for n in range(4)), "a last line"]


def test_short_lines_without_an_article_element(spark):
    short = "<p>All short.</p><p>Every line.</p><h2>Why</h2><p>So.</p><ul><li><a href='/x'>a link</a></li></ul>"
    assert extract_articles(pages(spark, short)).first().text == "All short.\nEvery line.\nWhy\nSo."


def test_an_author_of_many_pages_is_kept(spark):
    body = "<h1>Title {0}</h1><p class='author'>by Ann Onymous</p><p>Only here {0}.</p><p>Buy now</p>"
    df = pages(spark, *(body.format(n) for n in range(4)), host="https://one.org/p")
    got = {(r.title, r.author, r.text) for r in extract_corpus(df).collect()}
    assert got == {(f"Title {n}", "Ann Onymous", f"Only here {n}.") for n in range(4)}
    assert {r.text for r in extract_articles(df).collect()} == {f"Only here {n}.\nBuy now" for n in range(4)}


@pytest.mark.parametrize("body", ["", "<html><body></body></html>", None,
                                  "<html><body><nav>only a menu here, nothing else at all</nav></body></html>"])
def test_no_article(spark, body):
    assert extract_articles(pages(spark, body)).count() == 0


def test_metadata_fallbacks(spark):
    page = ('<meta property="og:title" content="From og"><meta name="author" content="by Sam Sample">'
            "<title>From title</title><p>" + LONG.format(1))
    row = extract_articles(pages(spark, page)).first()
    assert (row.title, row.author, row.text) == ("From og", "Sam Sample", LONG.format(1))
    assert extract_articles(pages(spark, FALLBACK.format(LONG.format(2), "", ""))).first().title == "T"


def test_cut_off_and_odd_markup(spark):
    page = '<body><nav><a href="/">x</a><article><p>Kept text <b>bold <i class="a>b">odd</i><pre>l1\n  l2</pre><p>tail'
    assert extract_articles(pages(spark, page)).first().text.split("\n") == [
        "Kept text bold odd", "l1", "l2", "tail"]


def test_repeats_over_a_host_are_left_out(spark):
    shared = "Subscribe to our newsletter for weekly updates about everything."
    bodies = [FALLBACK.format(shared, LONG.format(i), "a menu entry that is one long link text here") for i in range(4)]
    df = pages(spark, *bodies, host="https://one.org/p")
    assert {r.page_id: r.text for r in extract_corpus(df).collect()} == {i: LONG.format(i) for i in range(4)}
    assert extract_articles(df).first().text.startswith(shared)
    blocks = explode_blocks(parse_pages(df))
    assert {r.n_pages for r in boilerplate_blocks(blocks).collect()} == {4}


def test_whole_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_articles(df).join(df.select("page_id", "html"), "page_id").collect()
    assert len(rows) == df.count()
    for row in rows:
        assert row.title and row.text
        for part in row.text.split("\n"):
            assert not re.search(r"</?(p|b|br|article)>", part)
    assert page_titles(df).where(F.col("title").isNull()).count() == 0
    assert page_links(df).where(~F.col("href").startswith("/")).count() == 0


def test_few_pages_are_held_as_blocks_at_a_time():
    pages = pd.Series([None, *(f"<p>{n}</p>" for n in range(2 * extract.PARSED_AT_ONCE))])
    parts = list(extract._parse_batches(iter([pages, pages[:0]])))
    assert [len(part) for part in parts] == [extract.PARSED_AT_ONCE, extract.PARSED_AT_ONCE, 1]
    texts = [[b["text"] for b in blocks] for part in parts for blocks in part["blocks"]]
    assert texts == [[], *([str(n)] for n in range(2 * extract.PARSED_AT_ONCE))]
