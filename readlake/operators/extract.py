"""Article extraction over a corpus of pages.

A page is cut into blocks by a small tokenizer in an Arrow batch; everything that
is decided about blocks is a Spark expression: which ones belong to the article,
how dense they are, and which ones repeat over the pages of a host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import display_title, strip
from ..functions.urls import url_host
from ..session import materialize
from .joins import spread_join

# How elements are treated.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td "
    "tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("aside footer nav head button select form".split())
ARTICLE_TAGS = frozenset(("article", "main"))
NOT_TEXT = ("h1", "byline", "time")
BYLINE = re.compile(r"\b(?:byline|author)\b", re.IGNORECASE)
BY = r"(?i)\Aby\s+"

# Without an article element a block counts unless it is mostly links; how long it is does
# not matter. What only decorates a site is told by its repeats, with the corpus at hand.
MAX_LINK_SHARE = 0.3
MIN_REPEATS = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)>"
    r"|<[/!?a-z][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

BLOCK = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("place", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("link_chars", T.IntegerType()),
])
PARSED = T.StructType([
    T.StructField("page_title", T.StringType()),
    T.StructField("og_title", T.StringType()),
    T.StructField("meta_author", T.StringType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
])


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class _Page:
    """Collects the blocks of one page from its tags and texts."""

    def __init__(self) -> None:
        self.meta: dict[str, str] = {}
        self.blocks: list[dict] = []
        self.pieces: list[str] = []
        self.link_chars = 0
        self.tag = "body"
        self.depth = dict.fromkeys((*SKIPPED_TAGS, *ARTICLE_TAGS, "a", "pre", "title", "header"), 0)

    def place(self) -> str:
        if self.depth["title"]:
            return "title"
        if any(self.depth[tag] for tag in SKIPPED_TAGS):
            return "skipped"
        if any(self.depth[tag] for tag in ARTICLE_TAGS):
            return "article"
        return "skipped" if self.depth["header"] else "body"

    def end_block(self) -> None:
        raw = html.unescape("".join(self.pieces))
        lines = raw.splitlines() if self.depth["pre"] else [raw]
        place = self.place()
        for line in lines:
            text = " ".join(line.split())
            if text and place == "title":
                self.meta.setdefault("page_title", text)
            elif text and place != "skipped":
                self.blocks.append({"tag": self.tag, "place": place, "text": text,
                                    "link_chars": min(self.link_chars, len(text))})
        self.pieces, self.link_chars = [], 0

    def text(self, data: str) -> None:
        self.pieces.append(data)
        if self.depth["a"]:
            self.link_chars += len(data.strip())

    def open(self, tag: str, attributes: str) -> None:
        if tag == "meta":
            named = _attributes(attributes)
            name = (named.get("property") or named.get("name") or "").lower()
            if name in ("og:title", "author") and named.get("content", "").strip():
                self.meta.setdefault(name, named["content"].strip())
            return
        byline = "=" in attributes and self._is_byline(attributes)
        if tag in BLOCK_TAGS or tag == "time" or byline:
            self.end_block()
            self.tag = "byline" if byline else "p" if tag == "br" else tag
        if tag in ARTICLE_TAGS or tag == "body":
            # A box that was never closed does not hold the article.
            self.depth.update(dict.fromkeys((*SKIPPED_TAGS, "title", "header"), 0))
        if tag in self.depth:
            self.depth[tag] = 1 if tag in ("a", "title") else self.depth[tag] + 1

    def _is_byline(self, attributes: str) -> bool:
        named = _attributes(attributes)
        return any(BYLINE.search(named.get(key, "")) for key in ("class", "rel", "itemprop"))

    def close(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag == "time" or self.tag == "byline":
            self.end_block()
            self.tag = "body"
        if self.depth.get(tag):
            self.depth[tag] -= 1


def _parse_page(source: str | None) -> dict:
    page = _Page()
    at = 0
    source = source or ""
    for token in _TOKEN.finditer(source):
        if token.start() > at:
            page.text(source[at:token.start()])
        at = token.end()
        name = token.group(3)
        if name is None:
            continue
        if token.group(2):
            page.close(name.lower())
        else:
            page.open(name.lower(), token.group(4))
    page.text(source[at:])
    page.end_block()
    return {"page_title": page.meta.get("page_title"), "og_title": page.meta.get("og:title"),
            "meta_author": page.meta.get("author"), "blocks": page.blocks}


# Pages whose blocks a task holds as Python objects at a time.
PARSED_AT_ONCE = 200


def _parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The parsed pages in parts smaller than the batches: blocks are many times as large as the text."""
    for pages in batches:
        for k in range(0, len(pages), PARSED_AT_ONCE):
            parsed = [_parse_page(page) for page in pages.iloc[k : k + PARSED_AT_ONCE]]
            yield pd.DataFrame(parsed, columns=PARSED.fieldNames())


# Declared nondeterministic so that no filter on its result is moved below it, which
# would parse every page a second time.
parse_html = F.pandas_udf(_parse_batches, PARSED).asNondeterministic()


PAGE_KEY = ("page_id", "url")


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """The kept columns with (page_title, og_title, meta_author, blocks). A <br> ends a block, so
    paragraphs written with it are blocks like others."""
    return pages.select(*keep, parse_html("html").alias("page")).select(*keep, "page.*")


def explode_blocks(parsed: DataFrame) -> DataFrame:
    """(page_id, host, block_no, tag, place, text, n_chars, link_chars)."""
    return parsed.select(
        "page_id", url_host(F.col("url")).alias("host"), F.posexplode("blocks").alias("block_no", "b")
    ).select(
        "page_id",
        "host",
        "block_no",
        F.col("b.tag").alias("tag"),
        F.col("b.place").alias("place"),
        F.col("b.text").alias("text"),
        F.length("b.text").alias("n_chars"),
        F.col("b.link_chars").alias("link_chars"),
    )


def boilerplate_blocks(blocks: DataFrame, min_pages: int = MIN_REPEATS) -> DataFrame:
    """(host, block_hash, n_pages): texts that several pages of a host repeat.

    Counted on hashes after removing repeats within a page, so the shuffled rows
    are small and the counts combine before the shuffle, however large a host is.
    """
    return (
        blocks.select("host", F.xxhash64("text").alias("block_hash"), "page_id")
        .distinct()
        .groupBy("host", "block_hash")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= min_pages)
    )


def _texts(blocks: Column) -> Column:
    """Article text: everything but the title, the byline and lone dates."""
    body = F.filter(blocks, lambda b: ~b["tag"].isin(*NOT_TEXT))
    return F.array_join(F.transform(body, lambda b: b["text"]), "\n")


def _first_text(blocks: Column, tag: str) -> Column:
    return F.get(F.filter(blocks, lambda b: b["tag"] == tag), 0)["text"]


def _hardly_links(block: Column) -> Column:
    return block["link_chars"] <= F.length(block["text"]) * MAX_LINK_SHARE


def _select(parsed: DataFrame, keep: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """Title, author and text of each page from its blocks."""
    blocks = F.col("blocks")
    article = F.filter(blocks, lambda b: b["place"] == "article")
    dense = F.filter(blocks, lambda b: _hardly_links(b) | b["tag"].isin("h1", "byline"))
    has_article = F.exists(
        "blocks", lambda b: (b["place"] == "article") & ~b["tag"].isin(*NOT_TEXT)
    )
    with_choice = parsed.withColumn("chosen", F.when(has_article, article).otherwise(dense))
    text = _texts(F.col("chosen"))
    author = F.coalesce("meta_author", _first_text(blocks, "byline"))
    return with_choice.select(
        *keep,
        F.coalesce(_first_text(F.col("chosen"), "h1"), "og_title", "page_title").alias("title"),
        F.nullif(strip(F.regexp_replace(author, BY, "")), F.lit("")).alias("author"),
        F.when(strip(text) != "", text).alias("text"),
    )


def extract_all(pages: DataFrame, keep: tuple[str, ...] = PAGE_KEY) -> DataFrame:
    """The kept columns and (title, author, text) of every page; text is null where
    there is no article."""
    return _select(parse_pages(pages, keep), keep)


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, author, text) of the pages that hold an article.

    Needs nothing but the page itself, so there is no shuffle.
    """
    return extract_all(pages).where(F.col("text").isNotNull())


def extract_corpus(pages: DataFrame, min_pages: int = MIN_REPEATS) -> DataFrame:
    """The same with the corpus as context: where no element marks the article,
    blocks that a host repeats over its pages are left out.

    Pages are parsed once and written; only hashes are shuffled to find repeats,
    and only the numbers of repeated blocks come back to a page.
    """
    parsed = materialize(parse_pages(pages), "parsed-pages")
    unmarked = parsed.where(~F.exists("blocks", lambda b: b["place"] == "article"))
    # An author's name may stand on many pages.
    content = explode_blocks(unmarked).where(~F.col("tag").isin(*NOT_TEXT))
    keys = content.select(
        "page_id", "block_no", "host", F.xxhash64("text").alias("block_hash"), "text"
    )
    repeats = boilerplate_blocks(keys, min_pages).select("host", "block_hash")
    # Spread the blocks of a repeated text, which may come from very many pages.
    same = keys.drop("text").withColumn("key", F.struct("host", "block_hash"))
    marked = spread_join(
        same.drop("host", "block_hash"), repeats.select(F.struct("host", "block_hash").alias("key")), "key", "page_id", "inner"
    )
    dropped = marked.groupBy("page_id").agg(F.collect_list("block_no").alias("dropped"))
    selected = _select(
        parsed.join(dropped, "page_id", "left").withColumn(
            "blocks",
            F.when(F.col("dropped").isNull(), F.col("blocks")).otherwise(
                F.filter("blocks", lambda b, k: ~F.array_contains("dropped", k))
            ),
        )
    )
    return selected.where(F.col("text").isNotNull())


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title, name): the <title> element, and what to show for the page."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = F.nullif(strip(F.regexp_replace(title, r"\s+", " ")), F.lit(""))
    return pages.select(
        "page_id", text.alias("title"), display_title(text, F.col("url")).alias("name")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, href): the links of each page in order."""
    href = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(href).alias("link_no", "href"))
