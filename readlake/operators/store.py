"""The archive: Parquet tables of committed batches, with their index.

A batch that is written again replaces all it wrote before: articles, tags and index
are committed together. Articles are ordered by id, so a few ids are few row groups.

Beside the articles stand their keys, (url, id) in buckets by the hash of the url, with a
Bloom filter of the urls in every file. Whether urls are saved is asked of their buckets.

An id is given once: new ones begin above the largest that was ever given. Several jobs may
write; a batch whose urls or ids another one took meanwhile is refused at its commit.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import clean_tag
from ..functions.text import display_title
from .generations import FANOUT, Commit, Conflict, Generations, Rewrite, State, Table, counted
from .index import FIELDS, Index, postings, write_postings

ARTICLE_SCHEMA = "id bigint, url string, title string, author string, text string, added_at string"
TAG_SCHEMA = "article_id bigint, tag string"
KEY_SCHEMA = "url string, id bigint, url_bucket int"
INDEX = "index/"
URL_BUCKETS = 64
# So few urls are looked up by value, which Parquet answers from its Bloom filters.
FEW_URLS = 500


def url_bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(URL_BUCKETS)).cast("int")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    @property
    def batches(self) -> Generations:
        return Generations(self.spark, self.root)

    def articles(self, state: State | None = None) -> DataFrame:
        return self.batches.read("articles", ARTICLE_SCHEMA, state=state)

    def tags(self, state: State | None = None, without: int | None = None) -> DataFrame:
        """The tags that all batches brought, or all but one."""
        return self.batches.read("tags", TAG_SCHEMA, without=without, state=state)

    def read(self, table: str, schema: str) -> DataFrame:
        return self.batches.read(table, schema)

    def index(self) -> Index:
        return Index.committed(self.batches, INDEX)

    def last_id(self) -> int:
        """The largest id that was ever given; kept with the commits, so no table is read."""
        return self.batches.state().last_id

    def keys(
        self,
        urls: DataFrame,
        state: State | None = None,
        only: Collection[int] | None = None,
        without: int | None = None,
    ) -> DataFrame:
        """(url, id) of those of some distinct urls that the archive has, or some of its batches.

        The buckets that the urls fall into are read, and no others. A few urls are looked
        up by value besides, so that files without any of them are passed over.
        """
        wanted = urls.select("url", url_bucket(F.col("url")).alias("url_bucket"))
        # At most URL_BUCKETS numbers.
        buckets = sorted(r[0] for r in wanted.select("url_bucket").distinct().collect())
        saved = self.batches.read("keys", KEY_SCHEMA, only=only, without=without, state=state)
        saved = saved.where(F.col("url_bucket").isin(buckets))
        if len(buckets) < URL_BUCKETS:  # else there are many
            few = [r[0] for r in wanted.select("url").limit(FEW_URLS + 1).collect()]
            if len(few) <= FEW_URLS:
                saved = saved.where(F.col("url").isin(few))
        return saved.join(wanted, ["url_bucket", "url"], "left_semi").select("url", "id")

    def _write_keys(self, rows: DataFrame, batch_id: int, generation: str, n: int) -> dict[str, Table]:
        dealt = rows.select("url", "id", url_bucket(F.col("url")).alias("url_bucket"))
        dealt = dealt.hint("rebalance", "url_bucket").sortWithinPartitions("url_bucket", "url")
        options = {"parquet.bloom.filter.enabled#url": "true",
                   "parquet.bloom.filter.expected.ndv#url": str(max(64, 2 * n // URL_BUCKETS))}
        return {"keys": self.batches.write(dealt, "keys", batch_id, generation, ("url_bucket",), options)}

    def _write_articles(self, rows: DataFrame, batch_id: int, generation: str) -> dict[str, Table]:
        rows = rows.select("id", "url", "title", "author", "text", "added_at")
        ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
        return {"articles": self.batches.write(ordered, "articles", batch_id, generation)}

    def _no_clash(self, own: DataFrame, later: list[Commit], now: State) -> None:
        """Refuse a batch if one committed meanwhile has one of its urls or ids."""
        theirs = self.batches.read("keys", KEY_SCHEMA, only={c.batch_id for c in later}, state=now)
        for column in ("url", "id"):
            found = own.join(theirs.select(column), column, "left_semi").first()
            if found:
                raise Conflict(f"{column} {found[column]} was saved by another batch meanwhile")

    def append(
        self,
        articles: DataFrame,
        tags: DataFrame,
        batch_id: int,
        more: dict[str, DataFrame] | None = None,
        state: State | None = None,
    ) -> None:
        """Write one batch and commit it: articles, their keys and tags, their part of the index,
        and other tables that belong to it. ``state`` is the one that ids and urls were
        compared with; ``Conflict`` is raised if what was committed since clashes with them."""
        batches = self.batches
        state = batches.state() if state is None else state
        generation = batches.new(batch_id, state)
        tables = self._write_articles(articles, batch_id, generation)
        written = self.spark.read.schema(ARTICLE_SCHEMA).parquet(batches.path("articles", batch_id, generation))
        n, last = counted(written, "id")
        if n:
            tables |= self._write_keys(written, batch_id, generation, n)
            tables |= write_postings(postings(written.select("id", *FIELDS)), batches, batch_id, generation, INDEX)
        else:
            tables = {}
        for table, frame in {"tags": tags.select("article_id", "tag"), **(more or {})}.items():
            tables[table] = batches.write(frame, table, batch_id, generation)
        own = written.select("url", "id")
        batches.commit(
            generation, batch_id, tables, state, n, last, check=lambda later, now: self._no_clash(own, later, now)
        )

    def _rewrite(self) -> dict[str, Rewrite]:
        """How tables with an order of their own are merged; what is derived from one is made anew."""

        def articles(rows: DataFrame, batch_id: int, generation: str) -> dict[str, Table]:
            tables = self._write_articles(rows, batch_id, generation)
            written = self.spark.read.schema(ARTICLE_SCHEMA).parquet(self.batches.path("articles", batch_id, generation))
            return tables | self._write_keys(written, batch_id, generation, written.count())

        def terms(rows: DataFrame, batch_id: int, generation: str) -> dict[str, Table]:
            return write_postings(rows, self.batches, batch_id, generation, INDEX)

        return {"articles": articles, f"{INDEX}postings": terms}

    def merge(self, batch_ids: Collection[int]) -> None:
        """Rewrite several batches as one, with all their tables, so that many small ones do not
        slow reading down. They cannot be written again afterwards."""
        self.batches.merge(batch_ids, self._rewrite())

    def compact(self, keep: Collection[int] = (), fanout: int = FANOUT) -> int:
        """Merge batches of like size until few are left; those to ``keep`` stay open."""
        return self.batches.compact(keep, self._rewrite(), fanout)

    def vacuum(self, older_than: float = 0) -> None:
        """Delete what replaced, merged or unfinished batches have left, so many seconds ago."""
        self.batches.vacuum(older_than)


def known_urls(saved: DataFrame, urls: DataFrame) -> DataFrame:
    """Which of some distinct urls are saved.

    The archive is the streamed side and the urls the one that may be broadcast:
    for a small batch Spark then reads the archive's url column without moving it.
    """
    return saved.select("url").join(urls.select("url"), "url", "left_semi")


def tag_strings(tags: DataFrame) -> DataFrame:
    """(article_id, tags): the sorted tags of each article in one text."""
    return tags.groupBy("article_id").agg(
        F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags")
    )


def list_articles(articles: DataFrame, tags: DataFrame, tag: str | None = None) -> DataFrame:
    """Newest first, with each article's tags; only those tagged ``tag`` if given."""
    wanted = clean_tag(tag) if tag else None
    listed = articles.select("id", "url", "title", "author", "added_at")
    if wanted is not None:
        ids = tags.where(F.col("tag") == wanted).select("article_id").distinct()
        listed = listed.join(ids, F.col("id") == F.col("article_id"), "left_semi")
        tags = tags.join(ids, "article_id", "left_semi")
    texts = tag_strings(tags).withColumnRenamed("article_id", "id")
    return (
        listed.join(texts, "id", "left")
        .withColumn("name", display_title(F.col("title"), F.col("url")))
        .orderBy(F.desc("added_at"), "id")
    )


def read_article(articles: DataFrame, article_id: int) -> DataFrame:
    return articles.where(F.col("id") == article_id)


def tags_for(tags: DataFrame, article_id: int) -> DataFrame:
    return tags.where(F.col("article_id") == article_id).select("tag").orderBy("tag")
