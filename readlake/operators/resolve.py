"""Where a page's content comes from: responses, archived copies, redirects, and
which addresses a capture may reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import (
    WEB_SCHEMES,
    is_blocked_ipv4,
    is_blocked_ipv6,
    ipv4_number,
    ipv6_digits,
    normalize_url,
    raw_snapshot_url,
    url_host,
    url_scheme,
)
from ..session import materialize
from .extract import extract_all
from .ingest import NO_TEXT, NOT_FETCHED, one_per_url
from .joins import spread_join

# The answers after which an archived copy may stand in.
REFUSED = (403, 404, 410, 429, 451)
SERVER_ERROR = 500


# -- archived copies ---------------------------------------------------------


def pick_snapshots(snapshots: DataFrame) -> DataFrame:
    """(url, raw_url): the closest copy of each page, if that one is usable.

    The latest is picked first and tested afterwards: a bad latest copy is not
    replaced by an older good one.
    """
    closest = snapshots.groupBy("url").agg(
        F.max_by(
            F.struct("available", "snapshot_url", "status", "timestamp"),
            F.struct("timestamp", "snapshot_url"),
        ).alias("c")
    )
    usable = (
        F.col("c.available")
        & (F.coalesce(F.col("c.snapshot_url"), F.lit("")) != "")
        & (F.col("c.status").cast("string") == "200")
    )
    return closest.where(usable).select(
        "url", raw_snapshot_url(F.col("c.snapshot_url"), F.col("c.timestamp")).alias("raw_url")
    )


# -- live page or archived copy ------------------------------------------------


def _error_text(live: str) -> Column:
    return F.coalesce(
        F.col(f"{live}.error"),
        F.concat(F.lit("HTTP Error "), F.col(f"{live}.status").cast("string")),
        F.lit(NOT_FETCHED),
    )


def _with_sources(urls: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """One row per url, also where a crawl has several responses for it: of those, one that
    answered, if possible with a text, else the smallest."""
    unanswered = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    one_live = one_per_url(live, ("status", "error", "title", "author", "text"), "live", (unanswered,))
    one_copy = one_per_url(archived, ("title", "author", "text"), "copy")
    return urls.select("url").distinct().join(one_live, "url", "left").join(one_copy, "url", "left")


def _has_text(page: str) -> Column:
    return F.coalesce(F.trim(F.col(f"{page}.text")) != "", F.lit(False))


def _taken(source: Column, reason: Column) -> list[Column]:
    fields = [
        F.when(source == "live", F.col(f"live.{f}")).when(source == "wayback", F.col(f"copy.{f}"))
        .alias(f)
        for f in ("title", "author", "text")
    ]
    return [F.col("url"), *fields, source.alias("source"),
            F.when(source.isNull(), reason).alias("reason")]


def resolve_import(
    urls: DataFrame, live: DataFrame, archived: DataFrame, use_archive: bool = True
) -> DataFrame:
    """The import rule: any failure, even a page without article text, may fall back.

    ``live`` is (url, status, error, title, author, text) and ``archived`` (url,
    title, author, text), both after extraction. The result is (url, title, author, text,
    source, reason), one row per url.
    """
    answered = F.coalesce(F.col("live.status").between(200, 299), F.lit(False))
    source = F.when(answered & _has_text("live"), F.lit("live"))
    if use_archive:
        source = F.coalesce(source, F.when(_has_text("copy"), F.lit("wayback")))
    reason = F.when(answered, F.lit(NO_TEXT)).otherwise(_error_text("live"))
    return _with_sources(urls, live, archived).select(*_taken(source, reason))


def resolve_add(urls: DataFrame, live: DataFrame, archived: DataFrame) -> DataFrame:
    """The rule for adding one page: only a refusing server is passed over.

    Never after a failed connection (the address may be internal), never after a
    page that holds no article.
    """
    status = F.col("live.status")
    answered = F.coalesce(status.between(200, 299), F.lit(False))
    refused = F.coalesce(status.isin(*REFUSED) | (status >= SERVER_ERROR), F.lit(False))
    copied = refused & F.col("copy").isNotNull()
    source = F.when(answered & _has_text("live"), F.lit("live")).when(
        copied & _has_text("copy"), F.lit("wayback")
    )
    reason = F.when(answered | copied, F.lit(NO_TEXT)).otherwise(_error_text("live"))
    return _with_sources(urls, live, archived).select(*_taken(source, reason))


LIVE_COLUMNS = ("url", "status", "error")


def fetch_for_import(
    urls: DataFrame, responses: DataFrame, copies: DataFrame, use_archive: bool = True
) -> DataFrame:
    """The import rule from raw pages: responses (url, status, error, html) and archived
    copies (url, html). Only what is asked for is extracted, and of the copies only
    those whose live page gave nothing."""
    live = materialize(
        extract_all(responses.join(urls, "url", "left_semi"), LIVE_COLUMNS), "live-pages"
    )
    gave_text = live.where(F.col("status").between(200, 299) & F.col("text").isNotNull())
    left = urls.join(gave_text.select("url"), "url", "left_anti")
    archived = extract_all(copies.join(left, "url", "left_semi"), ("url",))
    return resolve_import(urls, live, archived, use_archive)


# -- redirects -----------------------------------------------------------------


def _by_page(hops: DataFrame) -> DataFrame:
    """Hops by the normalized url they begin at: whatever any spelling of it is known to
    lead to counts for all spellings."""
    return hops.select(normalize_url(F.col("url")).alias("given_url"), "hop", "target").distinct()


def _chain_ends(steps: DataFrame) -> DataFrame:
    """(page, end, reason): where each page's redirects lead in the end, and the first reason on
    the way, its own included.

    ``steps`` is (page, next, reason), one row per page that leads anywhere. Pointers are jumped:
    in every round a page takes over the page that the one it points to points to, so a chain
    takes as many rounds as the logarithm of its length. Pages that lead around in a circle, and
    those that lead into it, end at the circle's smallest page.
    """
    state = materialize(steps.select("page", F.col("next").alias("ptr"), F.col("page").alias("low"), "reason"), "chains")
    pages, reached = state.count(), 1

    def ahead(*names: str) -> DataFrame:
        return state.select(F.col("page").alias("ptr"), *(F.col(n).alias(f"{n}_ahead") for n in names))

    while reached <= pages:
        # Very many pages may lead to one.
        joined = spread_join(state, ahead("ptr", "low", "reason"), "ptr", "page")
        state = materialize(
            joined.select(
                "page",
                F.coalesce("ptr_ahead", "ptr").alias("ptr"),
                F.least("low", "low_ahead").alias("low"),
                F.coalesce("reason", "reason_ahead").alias("reason"),
                F.coalesce(F.col("ptr_ahead") != F.col("ptr"), F.lit(False)).alias("moved"),
            ),
            "chains",
        )
        reached *= 2
        if state.where("moved").isEmpty():
            break
    ends = spread_join(state, ahead("low"), "ptr", "page")
    return ends.select("page", F.coalesce("low_ahead", "ptr").alias("end"), "reason")


def resolve_redirects(urls: DataFrame, hops: DataFrame) -> DataFrame:
    """(url, given_url, final_url): the latter two normalized. A page leads to its last hop's
    target; if that page is known to lead on, so does this one, and so forth."""
    last = _by_page(hops).groupBy("given_url").agg(F.max_by("target", F.struct("hop", "target")).alias("target"))
    steps = last.select(
        F.col("given_url").alias("page"),
        F.coalesce(normalize_url(F.col("target")), "given_url").alias("next"),
        F.lit(None).cast("string").alias("reason"),
    )
    ends = _chain_ends(steps).select(F.col("page").alias("given_url"), "end")
    named = urls.select("url", normalize_url(F.col("url")).alias("given_url"))
    return spread_join(named, ends, "given_url", "url").select(
        "url", "given_url", F.coalesce("end", "given_url").alias("final_url")
    )


def same_final_page(resolved: DataFrame) -> DataFrame:
    """Final pages that several given urls lead to."""
    return (
        resolved.select("given_url", "final_url")
        .distinct()
        .groupBy("final_url")
        .agg(F.count(F.lit(1)).alias("n_urls"))
        .where(F.col("n_urls") > 1)
    )


# -- addresses a capture must not reach ------------------------------------------


def host_addresses(resolutions: DataFrame) -> DataFrame:
    """(host, blocked): whether any address of a host is not public, or cannot be read."""
    distinct = resolutions.select(F.lower("host").alias("host"), F.trim("ip").alias("ip")).distinct()
    read = distinct.select("host", "ip", ipv4_number(F.col("ip")).alias("number"), ipv6_digits(F.col("ip")).alias("digits"))
    v6 = F.coalesce(F.col("ip").contains(":"), F.lit(False))
    blocked = F.when(v6, is_blocked_ipv6(F.col("digits"))).otherwise(is_blocked_ipv4(F.col("number")))
    return read.groupBy("host").agg(F.bool_or(blocked).alias("blocked"))


# Why a target is refused; with a host where there is one.
NOT_WEB, HOSTLESS, UNKNOWN_HOST, INTERNAL = "not-web", "hostless", "unknown-host", "internal-host"


def _refusals(targets: DataFrame, resolutions: DataFrame, spread_by: str) -> DataFrame:
    """The targets with the reason why each is refused, or null."""
    hosted = targets.withColumn("host", url_host(F.col("target")))
    reason = (
        F.when(~url_scheme(F.col("target")).isin(*WEB_SCHEMES), F.lit(NOT_WEB))
        .when(F.col("host").isNull(), F.lit(HOSTLESS))
        .when(F.col("blocked").isNull(), F.concat(F.lit(f"{UNKNOWN_HOST} "), "host"))
        .when(F.col("blocked"), F.concat(F.lit(f"{INTERNAL} "), "host"))
    )
    judged = spread_join(hosted, host_addresses(resolutions), "host", spread_by)
    return judged.withColumn("reason", reason).drop("host", "blocked")


def check_addresses(urls: DataFrame, hops: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(url, safe, reason): the url and every redirect target must be public, also those of the
    pages that it leads to.

    Redirects are looked up by the normalized url, so another spelling does not get around
    one. The reason is that of the first target that is refused. Many urls share a
    host, so the verdicts per host are joined spread over several tasks.
    """
    judged = _refusals(_by_page(hops), resolutions, "given_url")
    hop = F.struct("hop", "target")
    per_page = judged.groupBy("given_url").agg(
        F.max_by("target", hop).alias("target"), F.min_by("reason", F.when(F.col("reason").isNotNull(), hop)).alias("reason")
    )
    steps = per_page.select(
        F.col("given_url").alias("page"), F.coalesce(normalize_url(F.col("target")), "given_url").alias("next"), "reason"
    )
    onward = _chain_ends(steps).select(F.col("page").alias("given_url"), F.col("reason").alias("reason_ahead"))
    named = urls.select("url", F.col("url").alias("target"), normalize_url(F.col("url")).alias("given_url")).distinct()
    own = _refusals(named, resolutions, "url")
    reason = F.coalesce("reason", "reason_ahead")
    return spread_join(own, onward, "given_url", "url").select("url", reason.isNull().alias("safe"), reason.alias("reason"))
