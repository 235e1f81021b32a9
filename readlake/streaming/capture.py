"""Captured pages as a stream: each is checked, extracted, saved once and searchable.

The stream carries (event_id, url, html, captured_at); event_id gives the order.
Exactness comes from the archive itself: a micro-batch is compared with everything
that other batches saved, and a batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import has_web_scheme, normalize_url
from ..operators.extract import extract_all
from ..operators.generations import Conflict
from ..operators.ingest import ATTEMPTS, NO_TEXT, NOT_FETCHED, assign_ids
from ..operators.joins import spread_join
from ..operators.resolve import LIVE_COLUMNS, check_addresses, resolve_add, resolve_redirects
from ..operators.store import Store
from ..session import Scratch

CAPTURE_SCHEMA = "event_id bigint, url string, html string, captured_at timestamp"
OUTCOME_SCHEMA = "event_id bigint, url string, ok boolean, reason string, id bigint"

# The largest page, and the wording of the outcomes.
MAX_PAGE_BYTES = 32 * 1024 * 1024
# So many pages a task remembers, to keep those that come again once.
REMEMBERED = 100_000
NO_URL = "no url given"
BAD_SCHEME = "unsupported URL scheme"
TOO_LARGE = "missing or oversized body"
ALREADY_SAVED = "already saved"


@dataclass(frozen=True)
class Web:
    """What is known of pages that a capture only names: tables instead of a network.

    responses (url, status, error, html), copies (url, html), hops (url, hop,
    target) and resolutions (host, ip); the urls in the first two are normalized.
    """

    responses: DataFrame
    copies: DataFrame
    hops: DataFrame
    resolutions: DataFrame


def read_captures(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of JSON captures dropped into a folder."""
    return (
        spark.readStream.schema(CAPTURE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def first_captures(captures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One capture per url. On a stream, repeats within the delay; on a table, the
    earliest of all."""
    keyed = captures.withColumn("url", normalize_url(F.col("url")))
    if captures.isStreaming:
        return keyed.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["url"])
    others = [c for c in keyed.columns if c != "url"]
    return (
        keyed.groupBy("url")
        .agg(F.min_by(F.struct(*others), F.struct("captured_at", "event_id")).alias("first"))
        .select("url", "first.*")
    )


def check_captures(captures: DataFrame, max_page_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """The captures with a reason why they are refused, or null."""
    url = F.coalesce("url", F.lit(""))
    reason = (
        F.when(F.octet_length("html") > max_page_bytes, F.lit(TOO_LARGE))
        .when(url == "", F.lit(NO_URL))
        .when(~has_web_scheme(url), F.lit(BAD_SCHEME))
    )
    return captures.withColumn("refused", reason)


# Of each capture two things are kept apart: what happened to it, one narrow row (event_id,
# url, content_key, reason), and what its page says (content_key, title, author, text), one
# row per different page however often it was sent.


def _pages_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Captures whose page the same task has seen already go without it; their key says which it is."""
    seen: set[bytes] = set()
    for batch in batches:
        first = []
        for key in batch.column("content_key").to_pylist():
            first.append(key is not None and key not in seen)
            seen.add(key)
        if len(seen) > REMEMBERED:
            seen.clear()
        at = batch.schema.get_field_index("html")
        page = pc.if_else(pa.array(first, pa.bool_()), batch.column(at), pa.scalar(None, batch.schema.field(at).type))
        yield batch.set_column(at, batch.schema.field(at), page)


def _kept(checked: DataFrame) -> DataFrame:
    """(event_id, url, refused, content_key, html): the captures with the key of the page that each
    brings, null if none, and the page itself where a task has it first."""
    page = F.when(F.col("refused").isNull() & (F.col("html") != ""), F.col("html"))
    keyed = checked.select("event_id", "url", "refused", F.sha2(page, 256).alias("content_key"), page.alias("html"))
    return keyed.mapInArrow(_pages_once, keyed.schema)


def _sent_pages(batch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Captures that bring their page. Equal pages are parsed once."""
    bringing = batch.where(F.col("html").isNotNull()).select("event_id", "content_key", "html")
    firsts = bringing.groupBy("content_key").agg(F.min("event_id").alias("event_id"))
    pages = bringing.join(firsts, ["event_id", "content_key"], "left_semi")
    content = scratch.write(extract_all(pages.dropDuplicates(["event_id", "content_key"]), ("content_key",)), "content")
    empty = content.where(F.col("text").isNull()).select("content_key", F.lit(NO_TEXT).alias("reason"))
    # Very many captures may send one page.
    sent = batch.where(F.col("content_key").isNotNull()).select("event_id", "url", "content_key")
    judged = spread_join(sent, empty, "content_key", "event_id")
    return judged.withColumn("url", normalize_url(F.col("url"))), content


def _named(batch: DataFrame) -> DataFrame:
    """Captures that only name a page."""
    return batch.where(F.col("refused").isNull() & F.col("content_key").isNull()).select("event_id", "url")


def _named_pages(batch: DataFrame, web: Web, guard: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Captures that only name a page: looked up, behind the address guard if asked for."""
    named = _named(batch)
    urls = scratch.write(named.select("url").distinct(), "urls")
    resolved = resolve_redirects(urls, web.hops)
    wanted = resolved.select(F.col("given_url").alias("url")).distinct()
    live = extract_all(web.responses.join(wanted, "url", "left_semi"), LIVE_COLUMNS)
    copies = extract_all(web.copies.join(wanted, "url", "left_semi"), ("url",))
    content = scratch.write(resolve_add(wanted, live, copies).withColumnRenamed("url", "given_url"), "named")
    if guard:
        guarded = check_addresses(urls, web.hops, web.resolutions).withColumnRenamed("reason", "unsafe")
    else:
        guarded = urls.withColumn("unsafe", F.lit(None).cast("string"))
    # A copy from the archive is kept under the url that was given.
    final = F.when(F.col("source") == "wayback", F.col("given_url")).otherwise(F.col("final_url"))
    per_url = (
        guarded.join(resolved, "url")
        .join(content.select("given_url", "source", "reason"), "given_url", "left")
        .select(
            F.col("url").alias("raw_url"),
            final.alias("page_url"),
            F.concat(F.lit("named "), "given_url").alias("content_key"),
            F.coalesce("unsafe", "reason").alias("reason"),
        )
    )
    # Very many captures may name one page.
    events = spread_join(
        named.withColumnRenamed("url", "raw_url"), per_url, "raw_url", "event_id", "inner"
    )
    key = F.concat(F.lit("named "), "given_url").alias("content_key")
    return (
        events.select("event_id", F.col("page_url").alias("url"), "content_key", "reason"),
        content.select(key, "title", "author", "text"),
    )


def save_captures(
    store: Store,
    captures: DataFrame,
    batch_id: int,
    now: Column,
    web: Web | None = None,
    guard: bool = True,
    max_page_bytes: int = MAX_PAGE_BYTES,
) -> DataFrame:
    """Save one micro-batch; the outcome of every capture in it: (event_id, url, ok, reason,
    id). Pages that are only named are looked up in ``web``. A batch that is saved again keeps
    the ids of its pages; one that clashes with another job's is made once more."""
    for left in reversed(range(ATTEMPTS)):
        try:
            _save(store, captures, batch_id, now, web, guard, max_page_bytes)
            break
        except Conflict:
            if not left:
                raise
    return store.batches.read("outcomes", OUTCOME_SCHEMA, only=[batch_id]).drop("batch_id")


def _save(
    store: Store, captures: DataFrame, batch_id: int, now: Column, web: Web | None, guard: bool, max_page_bytes: int
) -> None:
    state = store.batches.state()
    store.batches.new(batch_id, state)  # a closed batch is refused before any work
    with Scratch(store.spark) as scratch:
        # The batch is read once; its source may be gone or changed on another read.
        batch = scratch.write(_kept(check_captures(captures, max_page_bytes)), "batch")
        events, content = _sent_pages(batch, scratch)
        if web is not None:
            more_events, more_content = _named_pages(batch, web, guard, scratch)
            events, content = events.unionByName(more_events), content.unionByName(more_content)
        else:
            events = events.unionByName(
                _named(batch).select("event_id", normalize_url(F.col("url")).alias("url"),
                                     F.lit(NOT_FETCHED).alias("reason")),
                allowMissingColumns=True,
            )
        events = scratch.write(events, "events")
        # The first capture that has a text wins, unless another batch has the url.
        firsts = events.where(F.col("reason").isNull()).groupBy("url").agg(F.min("event_id").alias("event_id"))
        firsts = scratch.write(firsts, "firsts")
        fresh = firsts.join(store.keys(firsts, state, without=batch_id), "url", "left_anti")
        placed = fresh.select("url", F.lit("").alias("source_file"), F.col("event_id").alias("line_no"))
        ids = assign_ids(store, placed, batch_id, state, scratch).join(firsts, "url").select("event_id", "id")
        ids = scratch.write(ids, "ids")
        # A batch may hold an event twice; the page is saved once.
        winners = events.join(ids, "event_id").where("reason IS NULL").dropDuplicates(["id"])
        articles = winners.select("id", "url", "content_key").join(content, "content_key").select(
            "id", "url", "title", "author", "text", now.alias("added_at")
        )
        ok = F.col("id").isNotNull()
        done = events.join(ids, "event_id", "left").select(
            "event_id",
            "url",
            ok.alias("ok"),
            F.when(~ok, F.coalesce("reason", F.lit(ALREADY_SAVED))).alias("reason"),
            "id",
        )
        refused = batch.where(F.col("refused").isNotNull()).select(
            "event_id",
            "url",
            F.lit(False).alias("ok"),
            F.col("refused").alias("reason"),
            F.lit(None).cast("bigint").alias("id"),
        )
        no_tags = store.spark.createDataFrame([], "article_id bigint, tag string")
        store.append(articles, no_tags, batch_id, {"outcomes": done.unionByName(refused)}, state)


def add_links(
    store: Store, links: DataFrame, web: Web, batch_id: int, now: Column | None = None, guard: bool = False
) -> DataFrame:
    """Add pages by their urls, as one batch: (event_id, url, ok, reason, id) of each link.

    ``links`` is (event_id, url); the order of event_id decides which of several links to one
    page is the one saved. A reader's own links are not guarded, unless asked for.
    """
    captures = links.select(
        "event_id", "url", F.lit(None).cast("string").alias("html"), F.lit(None).cast("timestamp").alias("captured_at")
    )
    return save_captures(store, captures, batch_id, _stamp(now), web, guard)


def _stamp(now: Column | None) -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'") if now is None else now


def capture_stream(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    now: Column | None = None,
    web: Web | None = None,
    first_batch: int = 0,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Run a stream of captures into the archive until its input is used up. Micro-batch n is
    batch ``first_batch`` + n of the archive. After every so many micro-batches the small ones
    are merged, but for the last, which the stream may send again."""

    def save(batch: DataFrame, batch_id: int) -> None:
        save_captures(store, batch, first_batch + batch_id, _stamp(now), web)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact(keep=[first_batch + batch_id])

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_outcomes(store: Store) -> DataFrame:
    return store.read("outcomes", OUTCOME_SCHEMA)
