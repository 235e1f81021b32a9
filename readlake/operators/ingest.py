"""Importing reading lists: dedup, merge with the archive, and the report.

Items are (url, title, author, added_at, text, tags, source_file, line_no); the
last two give the order in which the first occurrence of a url wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import clean_tags
from ..functions.urls import has_import_scheme, normalize_url
from ..session import Scratch, materialize
from .generations import Conflict, State
from .numbering import number_rows
from .store import Store, known_urls

ITEM_SCHEMA = (
    "url string, title string, author string, added_at string, text string, "
    "tags array<string>, source_file string, line_no bigint"
)
# The wording of the report.
BAD_SCHEME = "not an http(s) URL"
NO_TEXT = "no article text"
NOT_FETCHED = "no response"

_ORDER = ["source_file", "line_no"]
PAGE_FIELDS = ("title", "author", "text", "source", "reason")

# A batch that clashes with one committed meanwhile is made again, so often at most.
ATTEMPTS = 5
_PLACES = (1 << 62) - 1


def _order() -> Column:
    return F.struct(*_ORDER)


def one_per_url(pages: DataFrame, fields: tuple[str, ...], name: str, rank: tuple[Column, ...] = ()) -> DataFrame:
    """(url, name): one row per url, the fields as a struct. Crawls bring a page more than once;
    the smallest by ``rank`` stays, then one with a text, then the smallest by the fields."""
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    ranked = F.struct(*(r.alias(f"_{k}") for k, r in enumerate((*rank, empty))), *fields)
    return pages.groupBy("url").agg(F.min(ranked).alias("one")).select(
        "url", F.struct(*(F.col(f"one.{c}").alias(c) for c in fields)).alias(name)
    )


def rejected(items: DataFrame) -> DataFrame:
    """Items whose url is not a web address."""
    return items.where(~F.coalesce(has_import_scheme(F.col("url")), F.lit(False)))


def _placed(items: DataFrame) -> DataFrame:
    """Items with a place that can be compared. One that has none gets one from its url, so
    that items without places do not all meet at one."""
    place = F.coalesce("line_no", F.xxhash64("url").bitwiseAND(F.lit(_PLACES)))
    return items.withColumns({"source_file": F.coalesce("source_file", F.lit("")), "line_no": place})


def _addressed(items: DataFrame) -> DataFrame:
    """Items with a web address, by their normalized url."""
    web = _placed(items).where(has_import_scheme(F.col("url")))
    return web.withColumn("url", normalize_url(F.col("url")))


def first_keys(items: DataFrame) -> DataFrame:
    """(url, source_file, line_no, n_items): where each normalized url comes first, and how often.

    Only keys are moved; they are combined before the shuffle, so a url that makes up a
    large part of the list costs one row per task.
    """
    return _firsts(_addressed(items))


def _firsts(addressed: DataFrame) -> DataFrame:
    per_file = addressed.groupBy("url", "source_file").agg(
        F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n")
    )
    # A few rows per url are left, one per file.
    return per_file.groupBy("url").agg(
        F.min(_order()).alias("first"), F.sum("n").alias("n_items")
    ).select("url", "first.*", "n_items")


def _same_url() -> Column:
    """Whether an item joined by its place is the one that was meant. Asked of both sides, so
    that it is not a key of the join: urls are normalized only where places agree."""
    return F.when(F.col("n_items") > 0, normalize_url(F.col("raw_url"))) == F.col("url")


def _with_content(keys: DataFrame, items: DataFrame) -> DataFrame:
    """The keys with what the items at their places say: one row per key. Texts are moved
    once, and repeats of a url do not meet."""
    content = _placed(items).select(F.col("url").alias("raw_url"), *_ORDER, "title", "author", "added_at", "text")
    return keys.join(content, _ORDER).where(_same_url()).drop("raw_url").dropDuplicates(["url", *_ORDER])


def deduplicate(items: DataFrame) -> DataFrame:
    """The first item of each normalized url, and how often the url occurs."""
    return _with_content(first_keys(items), items).select(
        "url", "title", "author", "added_at", "text", *_ORDER, "n_items"
    )


def url_tags(items: DataFrame) -> DataFrame:
    """Distinct (url, tag) over all occurrences of a url: repeats bring their tags."""
    return _tags_of(_addressed(items))


def _tags_of(addressed: DataFrame) -> DataFrame:
    return addressed.select("url", F.explode(clean_tags(F.col("tags"))).alias("tag")).distinct()


def already_saved(items: DataFrame, saved: DataFrame) -> DataFrame:
    """The distinct urls of a list that the archive has, with their occurrences."""
    keys = first_keys(items).select("url", "n_items")
    return keys.join(known_urls(saved, keys), "url", "left_semi")


def links_to_fetch(items: DataFrame, saved: DataFrame) -> DataFrame:
    """The urls whose content is needed: not saved yet, and listed without their text."""
    keys = materialize(first_keys(items), "keys")
    fresh = keys.join(known_urls(saved, keys), "url", "left_anti")
    bare = _placed(items).where(F.coalesce(F.col("text"), F.lit("")) == "")
    bare = bare.select(F.col("url").alias("raw_url"), *_ORDER)
    return fresh.join(bare, _ORDER).where(_same_url()).select("url").distinct()


def outcomes(
    items: DataFrame, saved: DataFrame, fetched: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """What becomes of every url: one row per distinct url and per rejected item.

    ``fetched`` is (url, title, author, text, source, reason) for the links that
    brought no text, with a null text where nothing could be had; of several rows for
    one url, the smallest. status is saved, skipped or failed; source is export, live or
    wayback. Whatever the archive has needs no content: only keys of it are read. ``keys``
    are the items' first keys, if they are at hand as a written table.
    """
    keys = materialize(first_keys(items), "keys") if keys is None else keys
    known = known_urls(saved, keys)
    old = keys.join(known, "url", "left_semi").select(
        "url",
        F.lit("skipped").alias("status"),
        *[F.lit(None).cast("string").alias(c) for c in ("source", "reason")],
        "n_items",
        *[F.lit(None).cast("string").alias(c) for c in ("title", "author", "text", "added_at")],
        *_ORDER,
    )
    fresh = _with_content(keys.join(known, "url", "left_anti"), items).withColumn(
        "inline", F.coalesce(F.col("text") != "", F.lit(False))
    )
    joined = fresh.join(one_per_url(fetched, PAGE_FIELDS, "page"), "url", "left")
    found = F.coalesce(F.col("page.text") != "", F.lit(False))
    status = F.when(F.col("inline") | found, "saved").otherwise("failed")
    title = F.when(F.col("inline"), F.col("title")).otherwise(
        F.coalesce(F.nullif(F.col("page.title"), F.lit("")), F.col("title"))
    )
    reason = F.when(
        status == "failed", F.coalesce(F.col("page.reason"), F.lit(NOT_FETCHED))
    )
    done = joined.select(
        "url",
        status.alias("status"),
        F.when(status != "saved", F.lit(None))
        .when(F.col("inline"), F.lit("export"))
        .otherwise(F.col("page.source"))
        .alias("source"),
        reason.alias("reason"),
        "n_items",
        title.alias("title"),
        F.when(F.col("inline"), F.col("author")).otherwise(F.col("page.author")).alias("author"),
        F.when(F.col("inline"), F.col("text")).otherwise(F.col("page.text")).alias("text"),
        "added_at",
        *_ORDER,
    )
    bad = rejected(_placed(items)).select(
        "url",
        F.lit("failed").alias("status"),
        F.lit(None).cast("string").alias("source"),
        F.lit(BAD_SCHEME).alias("reason"),
        F.lit(1).cast("bigint").alias("n_items"),
        "title",
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("text"),
        "added_at",
        *_ORDER,
    )
    return done.unionByName(old).unionByName(bad)


def summary(done: DataFrame) -> DataFrame:
    """One row: saved, from_export, from_wayback, skipped, failed."""
    status, source, n = F.col("status"), F.col("source"), F.col("n_items")
    repeats = F.when(status == "skipped", n).otherwise(n - 1)
    return done.agg(
        F.count_if(status == "saved").alias("saved"),
        F.count_if(source == "export").alias("from_export"),
        F.count_if(source == "wayback").alias("from_wayback"),
        F.coalesce(F.sum(repeats), F.lit(0)).alias("skipped"),
        F.count_if(status == "failed").alias("failed"),
    )


def counts(done: DataFrame) -> DataFrame:
    """(status, source, n_items): how many items of the list ended how."""
    return done.groupBy("status", "source").agg(F.sum("n_items").alias("n_items"))


def failures(done: DataFrame, limit: int | None = None) -> DataFrame:
    """(url, reason) in list order; the first few for a screen, or all for a file."""
    rows = done.where(F.col("status") == "failed").orderBy(*_ORDER)
    return (rows if limit is None else rows.limit(limit)).select("url", "reason")


def write_failures(done: DataFrame, path: str) -> None:
    """url<TAB>reason, one per line."""
    failures(done).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def _stamped(numbered: DataFrame, now: Column | None) -> DataFrame:
    """Article rows; without a date of their own they get the time of the import."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                        "yyyy-MM-dd'T'HH:mm:ss'Z'") if now is None else now
    return numbered.select(
        "id", "url", "title", "author", "text", F.coalesce("added_at", now).alias("added_at")
    )


def new_tags(pairs: DataFrame, articles: DataFrame, existing: DataFrame) -> DataFrame:
    """(article_id, tag) for the (url, tag) pairs whose article exists and lacks the tag."""
    return (
        pairs.join(articles.select("url", F.col("id").alias("article_id")), "url")
        .select("article_id", "tag")
        .distinct()
        .join(existing.select("article_id", "tag"), ["article_id", "tag"], "left_anti")
    )


@dataclass(frozen=True)
class ImportResult:
    outcomes: DataFrame

    def summary(self) -> DataFrame:
        return summary(self.outcomes)

    def failures(self, limit: int | None = None) -> DataFrame:
        return failures(self.outcomes, limit)


def run_import(
    store: Store, items: DataFrame, fetched: DataFrame, batch_id: int, now: Column | None = None
) -> ImportResult:
    """Save every item that the archive does not have; repeats bring their tags.

    Running a batch again replaces what it wrote, also when later batches were committed since:
    what those have saved is skipped, a url that the batch had saved before keeps its id, and
    new ones get ids that were never given. A later batch with the same list saves nothing.
    If another job takes one of the urls or ids meanwhile, the batch is made once more.
    """
    for left in reversed(range(ATTEMPTS)):
        try:
            return _import(store, items, fetched, batch_id, now)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def _import(store: Store, items: DataFrame, fetched: DataFrame, batch_id: int, now: Column | None) -> ImportResult:
    state = store.batches.state()
    store.batches.new(batch_id, state)  # a closed batch is refused before any work
    with Scratch(store.spark) as scratch:
        # Every url is normalized once.
        addressed = scratch.write(_addressed(items).select("url", *_ORDER, "tags"), "addressed")
        keys = scratch.write(_firsts(addressed), "keys")
        saved = store.keys(keys, state, without=batch_id)
        done = materialize(outcomes(items, saved, fetched, keys), "outcomes")
        fresh = done.where(F.col("status") == "saved")
        ids = scratch.write(assign_ids(store, fresh.select("url", *_ORDER), batch_id, state, scratch), "ids")
        # Ids alone were written; the texts go from the outcomes to the archive.
        articles = _stamped(fresh.join(ids, "url"), now)
        tagged = saved.unionByName(ids)
        tags = new_tags(_tags_of(addressed), tagged, store.tags(state, without=batch_id))
        store.append(articles, tags, batch_id, state=state)
    return ImportResult(done)


def assign_ids(store: Store, fresh: DataFrame, batch_id: int, state: State, scratch: Scratch) -> DataFrame:
    """(url, id) for the urls that a batch is going to save, one row per url with its place: the
    id they had if the batch is written again, else the next ones in the order of the list."""
    start = F.lit(state.last_id + 1)
    if batch_id not in state.valid:
        return number_rows(fresh, [*_ORDER, "url"], start, write=scratch.write).select("url", "id")
    had = scratch.write(store.keys(fresh, state, only=[batch_id]), "had")
    new = fresh.join(had, "url", "left_anti")
    numbered = number_rows(new, [*_ORDER, "url"], start, write=scratch.write).select("url", "id")
    return numbered.unionByName(had)
