"""The registered queries: every operator over the given tables, with its oracle."""

from __future__ import annotations

import gzip
import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    clean_tags,
    escape_html,
    iso_from_string,
    iso_from_unix,
    normalize_url,
    paragraphs,
    slugify,
    tokens,
)
from ..files import arrow_location
from ..operators import export, extract, ingest, resolve
from ..operators import search as s
from ..operators.index import Index
from ..operators.store import Store, list_articles, read_article, tag_strings, tags_for
from ..session import list_names, materialize, scratch_path
from ..sources import exports
from ..sources.responses import decode_responses
from ..streaming import capture
from . import oracles as o
from .fixtures import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Written once per session and data folder: what several queries read.
_written: dict[tuple[str, str, str], object] = {}


def _once(name: str, t: Tables, make: Callable[[], object]) -> object:
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _written:
        _written[key] = make()
    return _written[key]


def query(
    oracle: str | None = None, name: str | None = None
) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a query under its function's name, or another that a function has already."""

    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        QUERIES[name or build.__name__] = run
        if oracle is not None:
            ORACLES[name or build.__name__] = oracle
        return run

    return register


NOW = "2025-01-01T00:00:00Z"


# -- scalars -------------------------------------------------------------------


@query(o.statement(f"SELECT line_no, url AS raw_url, {o.normalized('url')} AS url FROM saves"), name="normalize_url")
def normalize_urls(t: Tables) -> DataFrame:
    saves = t["saves"]
    return saves.select("line_no", F.col("url").alias("raw_url"), normalize_url(F.col("url")).alias("url"))


_UNIX_TEXT = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a'
    WHEN event_type = 'view' THEN concat('-', CAST(user_id AS STRING))
    ELSE concat(CAST(saved_unix AS STRING), '.5') END AS typed, saved_unix FROM visits"""


@query(o.statement(f"""SELECT event_id, typed, CASE WHEN typed LIKE '%.5'
    THEN strftime(make_timestamp(saved_unix * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS saved
    FROM ({_UNIX_TEXT})"""), name="iso_from_unix")
def iso_from_unix_seconds(t: Tables) -> DataFrame:
    return t.sql(_UNIX_TEXT).select("event_id", "typed", iso_from_unix(F.col("typed")).alias("saved"))


_ISO_TEXT = """SELECT event_id, event_type, saved_unix, CASE WHEN event_type = 'error' THEN 'soon'
    WHEN event_type = 'view' THEN added_at
    WHEN event_type = 'click' THEN replace(added_at, 'Z', '.250+02:00')
    ELSE replace(replace(added_at, 'Z', ''), 'T', ' ') END AS typed FROM visits"""


@query(o.statement(f"""SELECT event_id, typed, CASE WHEN event_type <> 'error' THEN strftime(
    make_timestamp((saved_unix - CASE WHEN event_type = 'click' THEN 7200 ELSE 0 END) * 1000000),
    '%Y-%m-%dT%H:%M:%SZ') END AS saved FROM ({_ISO_TEXT})"""), name="iso_from_string")
def iso_from_text(t: Tables) -> DataFrame:
    return t.sql(_ISO_TEXT).select("event_id", "typed", iso_from_string(F.col("typed")).alias("saved"))


@query(o.statement(f"SELECT line_no, {o.clean_tags("string_split(tag_text, '|')")} AS tags FROM saves"), name="clean_tags")
def cleaned_tags(t: Tables) -> DataFrame:
    return t["items"].select("line_no", F.array_join(clean_tags(F.col("tags")), ",").alias("tags"))


@query(o.statement(f"SELECT id, {o.slug('title')} AS slug FROM articles"), name="slugify")
def slugs(t: Tables) -> DataFrame:
    return t["articles"].select("id", slugify(F.col("title")).alias("slug"))


@query(o.statement(f"""SELECT id, unnest(p) AS paragraph, unnest(range(len(p))) AS paragraph_no
    FROM (SELECT id, {o.paragraphs('text')} AS p FROM articles)"""), name="paragraphs")
def paragraph_split(t: Tables) -> DataFrame:
    return t["articles"].select(
        "id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph_no", "paragraph")
    ).select("id", F.col("paragraph_no").cast("bigint").alias("paragraph_no"), "paragraph")


# A page as an old site writes it: one table cell, hard-wrapped, paragraphs by <br>.
_BR_PAGES = """SELECT conv_id, turn, concat('<td>', replace(replace(text, ' ', chr(10)), concat('.', chr(10)),
    concat('. <br /><BR>', chr(10))), '</td>') AS html FROM conversations"""


@query(o.statement(f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(
    string_split_regex(html, '(?i)<br\\s*/?>|</?td>'),
    lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS text
    FROM ({_BR_PAGES})"""))
def br_paragraphs(t: Tables) -> DataFrame:
    return extract.extract_all(t.sql(_BR_PAGES), ("conv_id", "turn")).select("conv_id", "turn", "text")


# -- index and search ------------------------------------------------------------


def _library(t: Tables) -> tuple[DataFrame, DataFrame, Index, Store]:
    """All documents as a written archive, opened once: articles, tags, index and the store."""

    def build() -> tuple[DataFrame, DataFrame, Index, Store]:
        store = Store(t.spark, scratch_path(t.spark, "library"))
        given = t.as_given()  # the articles are dealt out by id where they are written
        store.append(given["articles"], given["tags"], 0)
        return store.articles().drop("batch_id"), store.tags().drop("batch_id"), store.index(), store

    return _once("library", t, build)


def _articles(t: Tables) -> DataFrame:
    return _library(t)[0]


def _tags(t: Tables) -> DataFrame:
    return _library(t)[1]


def _index(t: Tables) -> Index:
    return _library(t)[2]


# Bytes of text whose words a task counts, about.
TOKENIZED_SHARE = 8 << 20


@query(o.statement("""SELECT id, term, count(*) AS n FROM words WHERE field = 2 GROUP BY id, term"""))
def tokenize(t: Tables) -> DataFrame:
    """The words of an article are counted in the task that has it: each has as much text as another."""
    articles = t["articles"].select("id", "text")
    given = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")  # as it lies, not spread
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    dealt = articles.repartition(1 + size // TOKENIZED_SHARE, "id")
    words = dealt.select("id", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(o.statement("""SELECT w.term, w.id, max(d.dl) AS dl,
    string_agg(CAST(field * 536870912 + pos AS STRING), ' ' ORDER BY field, pos) AS at
    FROM words w JOIN lengths d ON d.id = w.id GROUP BY w.term, w.id"""))
def build_index(t: Tables) -> DataFrame:
    return (
        _index(t).postings.where(F.col("term") != "")
        .select("term", "id", F.col("dl").cast("bigint").alias("dl"),
                F.array_join(F.col("at").cast("array<string>"), " ").alias("at"))
    )


_POSTINGS = o.statement("""SELECT w.term, w.id, max(d.dl) AS dl,
    string_agg(CAST(field * 536870912 + pos AS STRING), ' ' ORDER BY field, pos) AS at
    FROM words w JOIN lengths d ON d.id = w.id GROUP BY w.term, w.id""")


@query(_POSTINGS)
def index_rerun(t: Tables) -> DataFrame:
    """All documents in batches of their sources; one is written with other rows first, one
    with rows that it loses, and two are merged in the end."""
    store = Store(t.spark, scratch_path(t.spark, "rerun"))
    rows, tags = t["articles"], t["tags"]
    source = F.regexp_extract("url", "src([0-9]+)", 1).cast("int")
    parts = {1: source < 5, 2: (source >= 5) & (source < 10), 3: (source >= 10) | source.isNull(), 4: F.lit(False)}
    for batch_id, part in {**parts, 1: parts[2], 4: parts[1]}.items():
        store.append(rows.where(part), tags.limit(0), batch_id)
    for batch_id in (1, 4):
        store.append(rows.where(parts[batch_id]), tags.limit(0), batch_id)
    store.merge([1, 2])
    return store.index().terms().select(
        "term", "id", F.col("dl").cast("bigint").alias("dl"), F.array_join(F.col("at").cast("array<string>"), " ").alias("at")
    )


@query(o.statement("SELECT term, count(DISTINCT id) AS df, count(*) AS hits FROM words GROUP BY term"))
def index_stats(t: Tables) -> DataFrame:
    return _index(t).document_frequencies()


@query(o.statement("SELECT term, count(DISTINCT id) AS df, count(*) AS hits FROM words WHERE term LIKE 'at%' GROUP BY term"))
def index_words(t: Tables) -> DataFrame:
    return _index(t).words("at")


def _search(name: str, composed: s.Query, oracle: str, limit: int | None = None) -> None:
    def run(t: Tables) -> DataFrame:
        return s.search(_index(t), _articles(t), composed, limit).withColumn(
            "score", F.round("score", 6)
        )

    query(oracle, name)(run)


_search("search_term", s.term("attion"), o.ranked({"h0": o.has_word("attion")}, "jh0.f > 0"))
_search(
    "search_and",
    s.both(s.term("thanea"), s.term("eron")),
    o.ranked({"h0": o.has_word("thanea"), "h1": o.has_word("eron")}, "jh0.f > 0 AND jh1.f > 0"),
)
_search(
    "search_or",
    s.either(s.term("queeau"), s.term("eriner"), s.term("ándoel")),
    o.ranked(
        {"h0": o.has_word("queeau"), "h1": o.has_word("eriner"), "h2": o.has_word("andoel")},
        "(jh0.f > 0 OR jh1.f > 0 OR jh2.f > 0)",
    ),
)
_search(
    "search_not",
    s.without(s.term("erin"), s.either(s.term("attion"), s.term("eron"))),
    o.ranked(
        {"h0": o.has_word("erin")},
        "jh0.f > 0 AND a.id NOT IN (SELECT id FROM words WHERE term IN ('attion', 'eron'))",
    ),
)
_search(
    "search_phrase",
    s.phrase("attion to thanedble"),
    o.ranked({"h0": o.has_phrase("attion", "to", "thanedble")}, "jh0.f > 0"),
)
_search(
    "search_prefix",
    s.term("atti", prefix=True),
    o.ranked({"h0": o.has_prefix("atti")}, "jh0.f > 0"),
)
_search(
    "search_column",
    s.either(s.within(s.term("and"), "title"), s.within(s.term("fr"), "text", exclude=True)),
    o.ranked(
        {"h0": o.has_word("and", "field = 0"), "h1": o.has_word("fr", "field <> 2")},
        "(jh0.f > 0 OR jh1.f > 0)",
    ),
)
_search(
    "search_near",
    s.near("erin", "eron", distance=20),
    o.ranked(
        {"h0": o.has_word("erin"), "h1": o.has_word("eron")},
        "jh0.f > 0 AND jh1.f > 0",
        {"h0": o.has_near("erin", "eron", 20), "h1": o.has_near("eron", "erin", 20)},
    ),
)
_search(
    "search_near_far",
    s.near("erin", "eron", distance=1000),
    o.ranked(
        {"h0": o.has_word("erin"), "h1": o.has_word("eron")},
        "jh0.f > 0 AND jh1.f > 0",
        {"h0": o.has_near("erin", "eron", 1000), "h1": o.has_near("eron", "erin", 1000)},
    ),
)
_search(
    "search_first",
    s.within(s.term("the", first=True), "title"),
    o.ranked({"h0": o.has_word("the", "field = 0 AND pos = 0")}, "jh0.f > 0"),
)
_search(
    "search_bm25",
    s.both(s.term("erin"), s.either(s.phrase("of the"), s.term("thn", prefix=True))),
    o.ranked(
        {"h0": o.has_word("erin"), "h1": o.has_phrase("of", "the"), "h2": o.has_prefix("thn")},
        "jh0.f > 0 AND (jh1.f > 0 OR jh2.f > 0)",
    )
    + " ORDER BY score, id LIMIT 20",
    limit=20,
)

_BATCH_WEIGHT = o.weight("p.f", "df.n")



def _batch_oracle(words: str) -> str:
    """The best ten articles of each benchmark item by some of its words."""
    return o.statement(f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank
    FROM (SELECT q.query_id, p.id, sum({_BATCH_WEIGHT}) AS score
          FROM (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark) q
          JOIN (SELECT id, term, count(*) AS f FROM words GROUP BY id, term) p ON p.term = q.term
          JOIN (SELECT term, count(DISTINCT id) AS n FROM words GROUP BY term) df ON df.term = q.term
          JOIN lengths d ON d.id = p.id CROSS JOIN corpus c
          JOIN (SELECT item_id, len(list_distinct({words})) AS n_words FROM benchmark) b
            ON b.item_id = q.query_id
          GROUP BY q.query_id, p.id, b.n_words HAVING count(*) = b.n_words)) WHERE rank <= 10""")


@query(_batch_oracle(o.tokens("text")))
def search_batch(t: Tables) -> DataFrame:
    queries = t["benchmark"].select(F.col("item_id").alias("query_id"), "text")
    return s.search_batch(_index(t), queries, k=10).withColumn("score", F.round("score", 6))


@query(_batch_oracle(f"list_slice({o.tokens('text')}, 1, 2)"))
def search_batch_blocks(t: Tables) -> DataFrame:
    """Queries of two words, which many articles match, block by block."""
    two = F.array_join(F.slice(tokens(F.col("text")), 1, 2), " ")
    queries = t["benchmark"].select(F.col("item_id").alias("query_id"), two.alias("text"))
    found = s.search_batch(_index(t), queries, k=10, one_block=0, first_blocks=1)
    return found.withColumn("score", F.round("score", 6))


@query(o.statement("""SELECT term, id >> 10 AS block, count(*) AS df, CAST(sum(f) AS BIGINT) AS hits,
    CAST(max(f) AS BIGINT) AS most, CAST(min(dl) AS BIGINT) AS shortest
    FROM (SELECT w.term, w.id, count(*) AS f, max(d.dl) AS dl
          FROM words w JOIN lengths d ON d.id = w.id GROUP BY w.term, w.id) GROUP BY term, id >> 10"""))
def index_blocks(t: Tables) -> DataFrame:
    """What bounds the scores of each word in each block of articles."""
    return _index(t).blocks.select(
        "term", "block", "df", "hits", F.col("most").cast("bigint").alias("most"), F.col("shortest").cast("bigint").alias("shortest")
    )


# -- listing -----------------------------------------------------------------------

_TAG_TEXT = "SELECT article_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM tags GROUP BY article_id"
_LISTED = "a.id, a.url, a.title, a.author, a.added_at, g.tags, coalesce(nullif(a.title, ''), a.url) AS name"


@query(o.statement(f"SELECT {_LISTED} FROM articles a LEFT JOIN ({_TAG_TEXT}) g ON g.article_id = a.id"), name="list_articles")
def list_all(t: Tables) -> DataFrame:
    return list_articles(_articles(t), _tags(t))


@query(o.statement(f"""SELECT {_LISTED} FROM articles a JOIN ({_TAG_TEXT}) g ON g.article_id = a.id
    WHERE a.id IN (SELECT article_id FROM tags WHERE tag = 'long read')"""))
def list_by_tag(t: Tables) -> DataFrame:
    return list_articles(_articles(t), _tags(t), " Long READ ")


@query(o.statement("SELECT tag FROM tags WHERE article_id = 42"), name="tags_for")
def tags_of_article(t: Tables) -> DataFrame:
    return tags_for(_tags(t), 42)


@query(o.statement("SELECT id, url, title, author, text, added_at FROM articles WHERE id = 42"), name="read_article")
def read_one_article(t: Tables) -> DataFrame:
    return read_article(_articles(t), 42)


# -- import --------------------------------------------------------------------------


def _stored(t: Tables) -> DataFrame:
    return t["stored"]


def _fetched(t: Tables) -> DataFrame:
    """Content of all linked pages by the import rule."""
    urls = t["responses"].select("url")
    return resolve.resolve_import(urls, _live(t), _copies(t))


def _page_articles(t: Tables) -> DataFrame:
    return _once(
        "page-articles", t, lambda: materialize(extract.extract_articles(t["pages"]), "page-articles")
    ).select("page_id", "title", "author", "text")


def _live(t: Tables) -> DataFrame:
    return t["responses"].join(_page_articles(t), "page_id", "left").select(
        "url", "status", "error", "title", "author", "text"
    )


def _copies(t: Tables) -> DataFrame:
    usable = resolve.pick_snapshots(t["snapshots"])
    pages = t["web_pages"].join(_page_articles(t), "page_id")
    return usable.join(pages, "url").select("url", "title", "author", "text")


def _outcomes(t: Tables) -> DataFrame:
    return _once(
        "outcomes", t,
        lambda: materialize(ingest.outcomes(t["items"], _stored(t), _fetched(t)), "outcomes"),
    )


@query(o.statement("""SELECT url, line_no, n_items, f.title AS title, f.author AS author,
    f.added_at AS added_at, f.text AS text FROM firsts"""))
def import_dedup(t: Tables) -> DataFrame:
    return ingest.deduplicate(t["items"]).drop("source_file")


@query(o.statement("SELECT f.url, f.n_items FROM firsts f JOIN stored s ON s.url = f.url"))
def import_skipped(t: Tables) -> DataFrame:
    return ingest.already_saved(t["items"], _stored(t))


@query(o.statement("""SELECT url, reason FROM (SELECT line_no, url, reason FROM rejects
    UNION ALL SELECT line_no, url, reason FROM outcomes WHERE status = 'failed')"""))
def import_failures(t: Tables) -> DataFrame:
    return ingest.failures(_outcomes(t))


@query(o.statement("""SELECT url, reason FROM (SELECT line_no, url, reason FROM rejects
    UNION ALL SELECT line_no, url, reason FROM outcomes WHERE status = 'failed')
    ORDER BY line_no LIMIT 20"""))
def import_first_failures(t: Tables) -> DataFrame:
    return ingest.failures(_outcomes(t), 20)


@query(o.statement("""SELECT count(*) FILTER (status = 'saved') AS saved,
    count(*) FILTER (source = 'export') AS from_export,
    count(*) FILTER (source = 'wayback') AS from_wayback,
    CAST(sum(CASE WHEN status = 'skipped' THEN n_items ELSE n_items - 1 END) AS BIGINT) AS skipped,
    count(*) FILTER (status = 'failed') + (SELECT count(*) FROM rejects) AS failed FROM outcomes"""))
def import_summary(t: Tables) -> DataFrame:
    return ingest.summary(_outcomes(t))


@query(o.statement("""SELECT status, source, CAST(sum(n) AS BIGINT) AS n_items FROM (
    SELECT status, source, n_items AS n FROM outcomes UNION ALL SELECT 'failed', NULL, 1 FROM rejects)
    GROUP BY status, source"""))
def import_counts(t: Tables) -> DataFrame:
    return ingest.counts(_outcomes(t))


def _import_store(t: Tables) -> Store:
    """An archive with the stored pages, into which the whole list was imported."""

    def run() -> str:
        root = scratch_path(t.spark, "archive")
        store = Store(t.spark, root)
        first = t["stored"].select(
            "id", "url", *[F.lit(None).cast("string").alias(c) for c in ("title", "author")],
            F.lit("stored before").alias("text"), F.lit(NOW).alias("added_at"),
        )
        store.append(first, t.spark.createDataFrame([], "article_id bigint, tag string"), 0)
        html = t["pages"].select("page_id", "html")
        # Every response and every copy twice, as crawls have them.
        responses = t["responses"].join(html, "page_id")
        copies = resolve.pick_snapshots(t["snapshots"]).join(t["web_pages"], "url").join(html, "page_id")
        responses, copies = responses.union(responses), copies.union(copies)
        links = ingest.links_to_fetch(t["items"], store.articles())
        fetched = resolve.fetch_for_import(links, responses, copies)
        ingest.run_import(store, t["items"], fetched, 1, F.lit(NOW))
        return root

    return Store(t.spark, _once("archive", t, run))


@query(o.statement("SELECT id, url, title, author, text, added_at FROM imported"))
def import_merge(t: Tables) -> DataFrame:
    return _import_store(t).articles().where(F.col("batch_id") == 1).drop("batch_id")


@query(o.statement("""SELECT a.id AS article_id, u.tag AS tag FROM url_tags u
    JOIN (SELECT id, url FROM imported UNION ALL SELECT id, url FROM stored) a ON a.url = u.url"""))
def merge_tags(t: Tables) -> DataFrame:
    return _import_store(t).tags().drop("batch_id")


@query(o.statement("SELECT url, id FROM articles"))
def saved_keys(t: Tables) -> DataFrame:
    """Which of all links, to articles and to other pages, the archive has."""
    urls = t["articles"].select("url").union(t["pages"].select(normalize_url(F.col("url")))).distinct()
    return _library(t)[3].keys(materialize(urls, "links"))


# Every document in a list by its language, with its text.
_LISTED_DOCUMENTS = """SELECT a.url, a.title, a.author, a.added_at, concat('saved ', coalesce(a.text, '')) AS text,
    a.id AS line_no, coalesce(d.lang, 'none') AS lang FROM articles a JOIN documents d ON d.doc_id + 1 = a.id"""


@query(o.statement(f"""SELECT CAST(CASE lang WHEN 'es' THEN first WHEN 'fr' THEN first_n + second
        ELSE first_n + second_n + third END AS BIGINT) AS id, url, title, text FROM (
    SELECT *, count(*) FILTER (lang IN ('en', 'es')) OVER () AS first_n, count(*) FILTER (lang = 'fr') OVER () AS second_n,
        count(*) FILTER (lang IN ('en', 'es')) OVER w AS first, count(*) FILTER (lang = 'fr') OVER w AS second,
        count(*) FILTER (lang NOT IN ('en', 'es', 'fr')) OVER w AS third
    FROM ({_LISTED_DOCUMENTS}) WINDOW w AS (ORDER BY line_no)) WHERE lang <> 'en'"""))
def import_rerun(t: Tables) -> DataFrame:
    """A first batch is imported, then a second, then the first once more with another list: what
    the second saved is skipped, what the first had keeps its id, new ids were never given."""
    store = Store(t.spark, scratch_path(t.spark, "imports"))
    listed = materialize(t.sql(_LISTED_DOCUMENTS), "listed").withColumns(
        {"source_file": F.lit("documents"), "tags": F.array().cast("array<string>")})
    nothing = t.spark.createDataFrame([], "url string, title string, author string, text string, source string, reason string")
    lang = F.col("lang")
    for batch_id, part in ((1, lang.isin("en", "es")), (2, lang.isin("es", "fr")), (1, lang != "en")):
        ingest.run_import(store, listed.where(part).drop("lang"), nothing, batch_id, F.lit(NOW))
    return store.articles().select("id", "url", "title", "text")


@query(o.statement(f"""SELECT a.id, a.url, g.tags, w.n_terms FROM articles a LEFT JOIN ({_TAG_TEXT}) g ON g.article_id = a.id
    LEFT JOIN (SELECT id, count(DISTINCT term) AS n_terms FROM words GROUP BY id) w ON w.id = a.id"""))
def merge_batches(t: Tables) -> DataFrame:
    """All documents in batches by source, merged by size: articles, tags and index as before."""
    store = Store(t.spark, scratch_path(t.spark, "merged"))
    given = t.as_given()  # each batch deals its articles out by id
    part = F.coalesce(F.regexp_extract("url", "src([0-9]+)", 1).try_cast("int") % 6, F.lit(0))
    articles = given["articles"].withColumn("part", part)
    for n in range(6):
        own = articles.where(F.col("part") == n).drop("part")
        tags = given["tags"].join(own.select(F.col("id").alias("article_id")), "article_id", "left_semi")
        store.append(own, tags, n)
    store.compact(fanout=3)
    store.vacuum()
    terms = store.index().terms().groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"))
    tagged = tag_strings(store.tags()).withColumnRenamed("article_id", "id")
    return store.articles().select("id", "url").join(tagged, "id", "left").join(terms, "id", "left")


# -- export files, written from the tables and read back -----------------------------


def _item_columns(items: DataFrame) -> DataFrame:
    """Items without the place they came from, which depends on how files were split."""
    return items.select(
        "url", "title", "author", "added_at", "text", F.array_join("tags", ",").alias("tags")
    )


def _write_csv(t: Tables, rows: DataFrame) -> str:
    path = scratch_path(t.spark, "csv")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return path


_NO = "CAST(NULL AS STRING)"
_UNIX_ISO = "strftime(make_timestamp(saved_unix * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_TYPED_TAGS = "array_to_string(string_split(tag_text, '|'), ',')"


@query(o.statement(f"""SELECT url, title || chr(10) || 'again' AS title, {_NO} AS author,
    {_UNIX_ISO} AS added_at, {_NO} AS text, replace(trim(tag_text), '|', ',') AS tags FROM saves"""))
def import_pocket_csv(t: Tables) -> DataFrame:
    rows = t["saves"].select(
        F.concat("title", F.lit("\nagain")).alias("Title"),
        F.col("url").alias(" URL "),
        F.col("saved_unix").alias("time_added"),
        F.col("tag_text").alias("tags"),
        F.lit("unread").alias("status"),
    )
    return _item_columns(exports.read_csv_export(t.spark, _write_csv(t, rows))[1])


@query(o.statement(f"""SELECT url, title, {_NO} AS author, {_UNIX_ISO} AS added_at, {_NO} AS text,
    {_NO} AS tags FROM saves"""))
def import_instapaper_csv(t: Tables) -> DataFrame:
    rows = t["saves"].select(
        F.col("url").alias("URL"), F.col("title").alias("Title"), F.lit("x").alias("Selection"),
        F.lit("Unread").alias("Folder"), F.col("saved_unix").alias("Timestamp"),
    )
    return _item_columns(exports.read_csv_export(t.spark, _write_csv(t, rows))[1])


@query(o.statement(f"""SELECT url, title, {_NO} AS author, {_NO} AS added_at, {_NO} AS text,
    {_NO} AS tags FROM saves"""))
def import_generic_csv(t: Tables) -> DataFrame:
    rows = t["saves"].select("author", "title", F.concat(F.lit(" "), "url").alias("url"))
    return _item_columns(exports.read_csv_export(t.spark, _write_csv(t, rows))[1])


def _link(date_attribute: str, with_tags: bool) -> Column:
    shown = F.concat(F.lit("<b>"), escape_html(F.col("title")), F.lit("</b>"))
    tags = F.concat(F.lit('" TAGS="'), F.replace("tag_text", F.lit("|"), F.lit(",")))
    return F.concat(
        F.lit('<!-- <A HREF="http://no.example/1">no</A> --><script>var x = \'<a href="http://no.example/2">no</a>\';</script>'),
        F.lit('<DT><A TITLE="a > b href=bad" HREF="'), escape_html(F.col("url")), F.lit(f'" {date_attribute}="'),
        F.col("saved_unix").cast("string"), tags if with_tags else F.lit(""), F.lit('">'),
        F.coalesce(shown, F.lit("")), F.lit("</A>"),
    )


def _write_text(t: Tables, rows: DataFrame) -> str:
    path = scratch_path(t.spark, "text")
    rows.write.text(path)
    return path


@query(o.statement(f"""SELECT url, title, {_NO} AS author, {_UNIX_ISO} AS added_at, {_NO} AS text,
    '' AS tags, 'bookmarks' AS kind FROM saves"""))
def import_bookmarks_html(t: Tables) -> DataFrame:
    path = _write_text(t, t["saves"].select(_link("ADD_DATE", False)))
    items = exports.read_link_export(t.spark, path)
    return items.select(
        "url", "title", "author", "added_at", "text", F.array_join("tags", ",").alias("tags"), "kind"
    )


@query(o.statement(f"""SELECT url, title, {_NO} AS author, {_UNIX_ISO} AS added_at, {_NO} AS text,
    {_TYPED_TAGS} AS tags, 'pocket' AS kind FROM saves"""))
def import_pocket_html(t: Tables) -> DataFrame:
    path = _write_text(t, t["saves"].select(_link("time_added", True)))
    return exports.read_link_export(t.spark, path).select(
        "url", "title", "author", "added_at", "text", F.array_join("tags", ",").alias("tags"), "kind"
    )


@query(o.statement(f"""SELECT url, {_NO} AS title, {_NO} AS author, {_NO} AS added_at, {_NO} AS text,
    {_NO} AS tags FROM saves WHERE url LIKE 'http://%' OR url LIKE 'https://%'"""))
def import_url_list(t: Tables) -> DataFrame:
    lines = t["saves"].select(
        F.concat(F.lit("  "), "url", F.lit("\t\n# "), F.coalesce("title", F.lit("")), F.lit("\n"))
    )
    return _item_columns(exports.read_url_list(t.spark, _write_text(t, lines)))


# An entry has its text in the export unless it is in English.
def _omnivore_entries(t: Tables) -> DataFrame:
    """(bundle, metadata, articles): up to twenty articles per metadata file."""
    entry = F.struct(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("doc "), F.col("id").cast("string")).alias("slug"),
        "title", "author", "url", F.col("added_at").alias("savedAt"),
        F.array(F.lit("Saved"), F.substring("added_at", 1, 7)).alias("labels"),
    )
    content = F.struct(F.concat(F.lit("doc "), F.col("id").cast("string")).alias("slug"), "text")
    return t["articles"].groupBy(F.floor(F.col("id") / 20).alias("bundle")).agg(
        F.to_json(F.sort_array(F.collect_list(entry)), {"ignoreNullFields": "false"}).alias("metadata"),
        F.collect_list(F.when(F.col("author").isNotNull(), content)).alias("articles"),
    )


_OMNIVORE = o.statement(f"""SELECT url, title, author, added_at,
    CASE WHEN author IS NOT NULL THEN nullif({o.strip('text')}, '') END AS text,
    'Saved,' || substr(added_at, 1, 7) AS tags FROM articles""")


@query(_OMNIVORE)
def import_omnivore(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "omnivore")
    _write_omnivore(t, root)
    return _item_columns(exports.read_omnivore(t.spark, root))


def _write_omnivore(t: Tables, root: str) -> None:
    entries = _omnivore_entries(t)
    metadata = entries.select(
        F.concat(F.lit("metadata_"), F.col("bundle").cast("string"), F.lit(".json")).alias("path"),
        F.col("metadata").alias("content"),
    )
    texts = entries.select(F.inline("articles")).select(
        F.concat(F.col("slug"), F.lit(".md")).alias("path"), F.col("text").alias("content")
    )
    export.write_files(metadata, root)
    export.write_files(texts, f"{root}/content")


def _write_bytes(files: DataFrame, folder: str) -> None:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = arrow_location(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with system.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    files.mapInPandas(write, "n bigint").write.format("noop").mode("overwrite").save()


def _zip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("export/metadata_0.json", row.metadata)
                for article in row.articles:
                    archive.writestr(f"export/content/{article['slug']}.md", article["text"])
            yield pd.DataFrame({"path": [f"export-{row.bundle}.zip"], "content": [out.getvalue()]})


@query(_OMNIVORE)
def import_omnivore_zip(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "zips")
    _write_bytes(_omnivore_entries(t).mapInPandas(_zip, "path string, content binary"), root)
    return _item_columns(exports.read_omnivore_zip(t.spark, root))


_FILES = """SELECT concat('f', CAST(page_id AS STRING), CASE WHEN url LIKE '%.html' THEN '.HTML'
    WHEN url LIKE 'https://m.%' THEN '.csv' WHEN url LIKE '%#top' THEN '.txt' ELSE '' END) AS path,
    CASE WHEN url LIKE '%#top' THEN url WHEN url LIKE 'https://m.%' THEN concat('url', chr(10), url)
    ELSE html END AS content FROM pages"""


@query(o.statement(f"""SELECT path AS name, CASE WHEN path LIKE '%.csv' THEN 'csv'
    WHEN path LIKE '%.HTML' OR contains(lower(content), '<a ') THEN 'links' ELSE 'urls' END AS kind
    FROM ({_FILES})"""))
def detect_export_kind(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "mixed")
    export.write_files(t.sql(_FILES), root)
    found = exports.detect_export_kinds(t.spark, root)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "kind")


@query(o.statement(f"""SELECT url, title, added_at, text, tags FROM (
    SELECT url, title || chr(10) || 'again' AS title, {_UNIX_ISO} AS added_at, {_NO} AS text, replace(trim(tag_text), '|', ',') AS tags FROM saves
    UNION ALL SELECT url, title, {_UNIX_ISO}, {_NO}, {_NO} FROM saves
    UNION ALL SELECT url, title, {_UNIX_ISO}, {_NO}, '' FROM saves
    UNION ALL SELECT url, title, {_UNIX_ISO}, {_NO}, '' FROM saves
    UNION ALL SELECT url, {_NO}, {_NO}, {_NO}, {_NO} FROM saves
    UNION ALL SELECT url, title, {_UNIX_ISO}, {_NO}, {_TYPED_TAGS} FROM saves
    UNION ALL SELECT url, {_NO}, {_NO}, {_NO}, {_NO} FROM saves WHERE url LIKE 'http://%' OR url LIKE 'https://%'
    UNION ALL SELECT url, title, added_at, CASE WHEN author IS NOT NULL THEN nullif({o.strip('text')}, '') END,
        'Saved,' || substr(added_at, 1, 7) FROM articles
    UNION ALL SELECT url, title, added_at, CASE WHEN author IS NOT NULL THEN nullif({o.strip('text')}, '') END,
        'Saved,' || substr(added_at, 1, 7) FROM articles)"""))
def import_mixed_folder(t: Tables) -> DataFrame:
    """Exports of every kind in one folder, with telling names or without."""
    root = scratch_path(t.spark, "mixed-exports")
    saves = t["saves"]
    pocket = saves.select(
        F.concat("title", F.lit("\nagain")).alias("Title"), F.col("url").alias(" URL "), F.col("saved_unix").alias("time_added"),
        F.col("tag_text").alias("tags"),
    )
    instapaper = saves.select(F.col("url").alias("URL"), F.col("title").alias("Title"), F.col("saved_unix").alias("Timestamp"))
    for name, rows in (("pocket", pocket), ("instapaper", instapaper)):
        rows.write.csv(f"{root}/{name}", header=True, quote='"', escape='"')
    page = F.array_join(F.collect_list("value"), "\n").alias("content")
    several = F.floor(F.col("line_no") / 1000).cast("string")  # files of some 1,000 links, as many as it takes
    for folder, suffix, link in (("bookmarks", ".HTML", _link("ADD_DATE", False)), ("pocket-pages", "", _link("time_added", True))):
        pages = saves.select(several.alias("n"), link.alias("value")).groupBy("n").agg(page)
        export.write_files(pages.select(F.concat("n", F.lit(suffix)).alias("path"), "content"), f"{root}/{folder}")
    urls = saves.select(several.alias("n"), F.col("url").alias("value")).groupBy("n").agg(page)
    export.write_files(urls.select(F.concat("n", F.lit(".list")).alias("path"), "content"), f"{root}/urls")
    _write_omnivore(t, f"{root}/omnivore")
    # Names that end otherwise than they look, a url far to the right, files that belong to an export.
    odd = saves.select(several.alias("n"), _link("ADD_DATE", False).alias("value")).groupBy("n").agg(page)
    export.write_files(odd.select(F.concat("n", F.lit(".html.bak")).alias("path"), "content"), f"{root}/odd")
    lines = saves.select(several.alias("n"), F.concat(F.lit("," * 299), "url").alias("value")).groupBy("n").agg(page)
    header = ",".join(f"c{k}" for k in range(299)) + ",URL\n"
    wide = lines.select(F.concat("n", F.lit(".html.csv")).alias("path"), F.concat(F.lit(header), "content").alias("content"))
    export.write_files(wide, f"{root}/wide")
    export.write_files(odd.select(F.concat("n", F.lit(".html")).alias("path"), "content"), f"{root}/omnivore/content", add=True)
    zips = _omnivore_entries(t).mapInPandas(_zip, "path string, content binary")
    _write_bytes(zips, f"{root}/zips")
    found = exports.read_exports(t.spark, root)
    return found.select("url", "title", "added_at", "text", F.array_join("tags", ",").alias("tags"))


# -- responses, copies, redirects, addresses -------------------------------------------


@F.pandas_udf(T.BinaryType())
def _compressed(texts: pd.Series, encodings: pd.Series) -> pd.Series:
    pack = {"gzip": gzip.compress, "deflate": zlib.compress, "": bytes}
    return pd.Series([pack[e](x.encode()) for x, e in zip(texts, encodings, strict=True)])


@query("SELECT page_id, html, CAST(NULL AS VARCHAR) AS error FROM pages", name="decode_responses")
def decode_bodies(t: Tables) -> DataFrame:
    encoding = F.when(F.col("url").contains("/en/"), "gzip").when(
        F.col("url").contains("/fr/"), "deflate").otherwise("")
    bodies = t["pages"].select(
        "page_id", _compressed("html", encoding).alias("body"), F.upper(encoding).alias("content_encoding")
    )
    return decode_responses(bodies)


@query(o.statement("SELECT url, raw_url FROM copies"))
def pick_snapshot(t: Tables) -> DataFrame:
    return resolve.pick_snapshots(t["snapshots"])


@query(o.statement("SELECT url, title, CAST(NULL AS VARCHAR) AS author, text, source, reason FROM fetched"))
def resolve_content_import(t: Tables) -> DataFrame:
    return _fetched(t)


@query(o.statement("""SELECT url, CASE WHEN source IS NOT NULL THEN title END AS title,
    CAST(NULL AS VARCHAR) AS author, CASE WHEN source IS NOT NULL THEN text END AS text, source,
    CASE WHEN source IS NULL THEN coalesce(CASE WHEN status = 200 THEN 'no article text' END, error,
         'HTTP Error ' || CAST(status AS STRING)) END AS reason
    FROM (SELECT *, CASE WHEN status = 200 AND text <> '' THEN 'live'
        WHEN (status IN (403, 404, 410, 429, 451) OR status >= 500) AND raw_url IS NOT NULL AND text <> ''
        THEN 'wayback' END AS source FROM sources)"""))
def resolve_content_add(t: Tables) -> DataFrame:
    return resolve.resolve_add(t["responses"].select("url"), _live(t), _copies(t))


@query(o.statement("SELECT url, given_url, final_url FROM resolved"))
def resolve_redirects(t: Tables) -> DataFrame:
    return resolve.resolve_redirects(t["pages"].select("url"), t["hops"])


@query(o.statement("""SELECT final_url, count(*) AS n_urls FROM (SELECT DISTINCT given_url, final_url FROM resolved)
    GROUP BY final_url HAVING count(*) > 1"""))
def same_final_page(t: Tables) -> DataFrame:
    return resolve.same_final_page(resolve.resolve_redirects(t["pages"].select("url"), t["hops"]))


@query(o.statement("SELECT url, reason IS NULL AS safe, reason FROM guarded"))
def unsafe_urls(t: Tables) -> DataFrame:
    return resolve.check_addresses(t["pages"].select("url"), t["hops"], t["resolutions"])


# -- extraction --------------------------------------------------------------------------


@query(o.statement(f"""SELECT page_id, title, coalesce(title, url) AS name FROM (SELECT page_id, url, nullif(
    {o.strip("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f]+', ' ', 'g')")}, '')
    AS title FROM pages)"""))
def extract_titles(t: Tables) -> DataFrame:
    return extract.page_titles(t["pages"])


@query(o.statement("""SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS link_no FROM (
    SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)"""))
def page_links(t: Tables) -> DataFrame:
    return extract.page_links(t["pages"]).withColumn("link_no", F.col("link_no").cast("bigint"))


@query(o.statement("SELECT page_id, host, block_no, place, text, length(text) AS n_chars FROM block_rows"))
def extract_blocks(t: Tables) -> DataFrame:
    blocks = extract.explode_blocks(extract.parse_pages(t["pages"]))
    return blocks.select(
        "page_id", "host", F.col("block_no").cast("bigint").alias("block_no"), "place", "text",
        F.col("n_chars").cast("bigint").alias("n_chars"),
    )


@query(o.statement("""SELECT page_id, raw_url AS url, title, CAST(NULL AS VARCHAR) AS author, text
    FROM page_articles WHERE text <> ''"""))
def extract_articles(t: Tables) -> DataFrame:
    return extract.extract_articles(t["pages"])


@query(o.statement("""SELECT page_id, url, title, 'Pat Reader' AS author, array_to_string(texts, chr(10)) AS text
    FROM bare_texts"""))
def extract_bare_pages(t: Tables) -> DataFrame:
    return extract.extract_articles(t["bare_pages"])


@query(o.statement("""SELECT p.page_id, any_value(p.url) AS url, any_value(p.title) AS title, 'Pat Reader' AS author,
    string_agg(b.text, chr(10) ORDER BY b.i) AS text FROM bare_texts p JOIN bare_blocks b ON b.page_id = p.page_id
    WHERE NOT EXISTS (SELECT 1 FROM bare_repeats r WHERE r.host = b.host AND r.text = b.text) GROUP BY p.page_id"""))
def extract_corpus(t: Tables) -> DataFrame:
    return extract.extract_corpus(t["bare_pages"])


@query(o.statement("""SELECT host, text, count(DISTINCT page_id) AS n_pages FROM block_rows
    GROUP BY host, text HAVING count(DISTINCT page_id) >= 2"""))
def boilerplate_blocks(t: Tables) -> DataFrame:
    blocks = materialize(
        extract.explode_blocks(extract.parse_pages(t["pages"])).select("page_id", "host", "text"), "blocks"
    )
    repeats = extract.boilerplate_blocks(blocks, 2)
    texts = blocks.select("host", "text", F.xxhash64("text").alias("block_hash")).distinct()
    return texts.join(repeats, ["host", "block_hash"]).select("host", "text", "n_pages")


# -- exports ---------------------------------------------------------------------------


def _markdown(order: str = "") -> str:
    name = "coalesce(nullif(title, ''), url)"
    front = " || chr(10) || ".join(
        f"'{key}: ' || {o.yaml(value)}"
        for key, value in (("title", name), ("url", "url"), ("author", "author"), ("saved", "added_at"))
    )
    path = f"CASE WHEN id < 10000 THEN lpad(CAST(id AS STRING), 4, '0') ELSE CAST(id AS STRING) END || '-' || {o.slug(name)} || '.md'"
    body = f"array_to_string({o.paragraphs('text')}, chr(10) || chr(10))"
    return (
        f"SELECT id, {path} AS path, '---' || chr(10) || {front} || chr(10) || '---' || chr(10) || chr(10) "
        f"|| '# ' || {name} || chr(10) || chr(10) || {body} || chr(10) AS content FROM articles"
    )


@query(o.statement(_markdown()))
def export_markdown(t: Tables) -> DataFrame:
    return export.markdown(_articles(t))


_BOOKS = """SELECT substr(added_at, 1, 7) AS book, id, url, title, author, text, added_at,
    coalesce(nullif(title, ''), url) AS name,
    row_number() OVER (PARTITION BY substr(added_at, 1, 7) ORDER BY added_at DESC, id) AS n FROM articles"""
_CHAPTER = (
    f"'{export.XHTML_HEAD}<head><title>'".replace("\n", "' || chr(10) || '")
    + f" || {o.escaped('name')} || '</title></head><body><h1>' || {o.escaped('name')}"
    + " || '</h1><p><small>' || "
    + o.escaped("concat_ws(' · ', nullif(author, ''), substr(added_at, 1, 10))")
    + f" || '<br/>' || {o.escaped('url')} || '</small></p>' || array_to_string(list_transform("
    + f"{o.paragraphs('text')}, lambda p: '<p>' || {o.escaped('p')} || '</p>'), '') || '</body></html>'"
)


@query(o.statement(f"""SELECT book, n, 'a' || CAST(n AS STRING) || '.xhtml' AS file, name, id,
    {_CHAPTER} AS content FROM ({_BOOKS})"""))
def export_chapters(t: Tables) -> DataFrame:
    return export.chapters(export.by_month(_articles(t)))


@query(o.statement(f"""SELECT tag AS book, n, '<li><a href="a' || n || '.xhtml">' || {o.escaped('name')} || '</a></li>' AS nav,
    '<item id="c' || n || '" href="a' || n || '.xhtml" media-type="application/xhtml+xml"/>' AS manifest,
    '<itemref idref="c' || n || '"/>' AS spine
    FROM (SELECT g.tag, coalesce(nullif(a.title, ''), a.url) AS name,
          row_number() OVER (PARTITION BY g.tag ORDER BY a.added_at DESC, a.id) AS n
          FROM articles a JOIN tags g ON g.article_id = a.id)"""))
def export_toc(t: Tables) -> DataFrame:
    return export.table_of_contents(export.by_tag(_articles(t), _tags(t)))


_RANKED = (
    "SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM ("
    + o.ranked({"h0": o.has_word("attion"), "h1": o.has_word("eron")}, "(jh0.f > 0 OR jh1.f > 0)", digits=None)
    + ")"
)


def _found(t: Tables) -> DataFrame:
    return export.select_articles(_articles(t), _index(t), s.either(s.term("attion"), s.term("eron")))


@query(f"""SELECT m.id, r.rank, m.path, m.content FROM ({o.statement(_markdown())}) m JOIN ({_RANKED}) r ON r.id = m.id""")
def export_search(t: Tables) -> DataFrame:
    return export.markdown(_found(t))


@query(f"""SELECT 'found' AS book, r.rank AS n, 'a' || CAST(r.rank AS STRING) || '.xhtml' AS file, b.name, b.id, b.content
    FROM ({o.statement(f"SELECT id, name, {_CHAPTER} AS content FROM ({_BOOKS})")}) b JOIN ({_RANKED}) r ON r.id = b.id""")
def export_search_book(t: Tables) -> DataFrame:
    return export.chapters(export.whole_book(_found(t), "found"))


# -- captures --------------------------------------------------------------------------

_CAPTURES = """SELECT event_id, CASE WHEN event_type = 'error' THEN concat('FILE:', split_part(p.url, ':', 2))
    ELSE p.url END AS url, CASE WHEN event_type = 'view' THEN '<p>' WHEN event_type = 'signup' THEN ''
    ELSE p.html END AS html, added_at FROM visits v JOIN pages p ON p.page_id = v.page_id"""
_CAPTURED = f"""SELECT c.event_id, CASE WHEN c.event_type = 'error' THEN c.raw_url ELSE c.url END AS url,
    c.event_type, c.page_id FROM (SELECT v.event_id, v.event_type, v.page_id, p.url AS page_url,
    concat('FILE:', split_part(p.url, ':', 2)) AS raw_url, {o.normalized('p.url')} AS url
    FROM visits v JOIN pages p ON p.page_id = v.page_id) c"""


def _web(t: Tables) -> capture.Web:
    html = t["pages"].select("page_id", "html")
    responses = t["responses"].join(html, "page_id").drop("page_id")
    copies = resolve.pick_snapshots(t["snapshots"]).join(t["web_pages"], "url").join(html, "page_id").select("url", "html")
    return capture.Web(responses.union(responses), copies, t["hops"], t["resolutions"])


# Bytes of pages in a file of captures, about.
INBOX_SHARE = 64 << 20


def _inbox(t: Tables) -> tuple[str, int]:
    """All captures as compressed files in two deliveries of so many files, so that the second
    micro-batch meets saved pages. There are as many files as there are pages to write; they are
    written where visits and pages meet, so that only the pages themselves are dealt out."""

    def write() -> tuple[str, int]:
        inbox = scratch_path(t.spark, "inbox")
        middle = t["events"].agg(F.avg("event_id")).scalar()
        size = t.as_given().sql(_CAPTURES).agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
        n = max(2, 1 + size // 2 // INBOX_SHARE)
        captures = t.dealt(n, "page_id", "visits", "pages").sql(_CAPTURES)
        captures = captures.withColumn("captured_at", F.replace("added_at", F.lit("T"), F.lit(" "))).drop("added_at")

        def deliver(part: DataFrame) -> None:
            part.write.mode("append").option("compression", "gzip").json(inbox)

        deliver(captures.where(F.col("event_id") <= middle))
        # The second delivery has no more files than the first, and both are a micro-batch each.
        n = max(1, sum(name.startswith("part-") for name in list_names(t.spark, inbox)))
        deliver(captures.where(F.col("event_id") > middle).coalesce(n))
        return inbox, n

    return _once("inbox", t, write)


def _capture_store(t: Tables) -> Store:
    """All captures sent through the stream, in two micro-batches; pages that are only named
    are guarded and looked up."""

    def run() -> str:
        root = scratch_path(t.spark, "captures")
        store = Store(t.spark, f"{root}/store")
        stream = capture.read_captures(t.spark, *_inbox(t))
        capture.capture_stream(stream, store, f"{root}/checkpoint", F.lit(NOW), _web(t)).awaitTermination()
        return f"{root}/store"

    return Store(t.spark, _once("captures", t, run))


# What becomes of a capture: refused, sent with its page, or named and looked up by the add rule.
_ADDED = """SELECT url AS given_url, CASE WHEN source IS NULL THEN coalesce(
        CASE WHEN status = 200 OR (refused AND raw_url IS NOT NULL) THEN 'no article text' END, error,
        'HTTP Error ' || CAST(status AS STRING), 'no response') END AS reason, source, page_id
    FROM (SELECT *, CASE WHEN status = 200 AND text <> '' THEN 'live'
            WHEN refused AND raw_url IS NOT NULL AND text <> '' THEN 'wayback' END AS source
          FROM (SELECT s.*, r.page_id, coalesce(s.status IN (403, 404, 410, 429, 451) OR s.status >= 500, false) AS refused
                FROM sources s JOIN responses r ON r.url = s.url))"""
_JUDGED = f"""SELECT v.event_id, CASE WHEN v.event_type = 'error' THEN c.raw_url
        WHEN v.event_type <> 'signup' THEN c.url WHEN a.source = 'wayback' THEN r.given_url ELSE r.final_url END AS url,
        CASE WHEN v.event_type = 'error' THEN 'unsupported URL scheme' WHEN v.event_type = 'view' THEN 'no article text'
             WHEN v.event_type = 'signup' THEN coalesce(g.reason, a.reason) END AS refused,
        CASE WHEN v.event_type = 'signup' THEN a.page_id ELSE v.page_id END AS content_id
    FROM visits v JOIN ({_CAPTURED.replace("c.page_id FROM (SELECT", "c.page_id, c.raw_url, c.page_url FROM (SELECT")}) c ON c.event_id = v.event_id
    JOIN resolved r ON r.url = c.page_url JOIN guarded g ON g.url = c.page_url
    LEFT JOIN ({_ADDED}) a ON a.given_url = r.given_url"""
_WINNERS = f"""SELECT event_id, url, content_id, row_number() OVER (ORDER BY event_id) AS id FROM (
    SELECT event_id, url, content_id, event_id = min(event_id) OVER (PARTITION BY url) AS first
    FROM ({_JUDGED}) WHERE refused IS NULL) WHERE first"""


@query(o.statement(f"""SELECT j.event_id, j.url, w.id IS NOT NULL AS ok,
    CASE WHEN w.id IS NULL THEN coalesce(j.refused, 'already saved') END AS reason, w.id
    FROM ({_JUDGED}) j LEFT JOIN ({_WINNERS}) w ON w.event_id = j.event_id"""))
def capture_stream(t: Tables) -> DataFrame:
    return capture.read_outcomes(_capture_store(t)).select("event_id", "url", "ok", "reason", "id")


@query(o.statement(f"""SELECT w.id, w.url, a.title, a.text FROM ({_WINNERS}) w
    JOIN page_articles a ON a.page_id = w.content_id"""))
def capture_articles(t: Tables) -> DataFrame:
    return _capture_store(t).articles().select("id", "url", "title", "text")


@query(o.statement(f"""SELECT p.page_id AS event_id, CASE WHEN a.source = 'wayback' THEN r.given_url ELSE r.final_url END AS url,
    p.page_id = min(CASE WHEN a.reason IS NULL THEN p.page_id END) OVER (PARTITION BY
        CASE WHEN a.source = 'wayback' THEN r.given_url ELSE r.final_url END) IS TRUE AS ok, a.reason
    FROM pages p JOIN resolved r ON r.url = p.url LEFT JOIN ({_ADDED}) a ON a.given_url = r.given_url"""))
def add_links(t: Tables) -> DataFrame:
    """A reader's own links, without the guard."""
    store = Store(t.spark, scratch_path(t.spark, "added"))
    links = t["pages"].select(F.col("page_id").alias("event_id"), "url")
    added = capture.add_links(store, links, _web(t), 0, F.lit(NOW))
    return added.select("event_id", "url", "ok", F.when(F.col("reason") != capture.ALREADY_SAVED, F.col("reason")).alias("reason"))


@query(o.statement(f"""SELECT url, arg_min(event_id, (added_at, event_id)) AS event_id FROM (
    SELECT event_id, added_at, {o.normalized('url')} AS url FROM ({_CAPTURES}))
    GROUP BY url"""))
def capture_dedup(t: Tables) -> DataFrame:
    captures = t.sql(_CAPTURES).withColumnRenamed("added_at", "captured_at")
    return capture.first_captures(captures).select("url", "event_id")


@query(o.statement(f"SELECT DISTINCT {o.normalized('url')} AS url FROM ({_CAPTURES})"))
def capture_dedup_stream(t: Tables) -> DataFrame:
    """The same on the stream: repeats within a delay that covers all captures."""
    root = scratch_path(t.spark, "firsts")
    stream = capture.first_captures(capture.read_captures(t.spark, *_inbox(t)), "10000 days")
    (
        stream.select("url").writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return t.spark.read.schema("url string").parquet(f"{root}/out")


@query(o.statement(f"""SELECT term, count(*) AS df, CAST(sum(f) AS BIGINT) AS hits FROM (
    SELECT id, term, count(*) AS f FROM (
        SELECT w.id, unnest({o.tokens("a.title || ' ' || a.text")}) AS term FROM ({_WINNERS}) w
        JOIN page_articles a ON a.page_id = w.content_id)
    GROUP BY id, term) GROUP BY term"""))
def incremental_index(t: Tables) -> DataFrame:
    return _capture_store(t).index().document_frequencies()
