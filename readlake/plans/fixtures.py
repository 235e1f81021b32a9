"""Tables derived from the given tables, for the registered queries.

Most are one SELECT that Spark and DuckDB share, with ``{..}`` where the two name a
function differently. Every table uses all rows of what it is derived from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..session import spread_rows

GIVEN = ("pages", "documents", "events", "conversations", "benchmark")

SPREAD_BY = {"pages": "page_id", "documents": "doc_id"}

SPARK_WORDS = {
    "epoch_of_ts": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
    "no_text": "CAST(NULL AS STRING)",
}

SHARED = {
    # The article store: every document, saved one hour after the other.
    "articles": """
        SELECT doc_id + 1 AS id,
               concat('https://', source, '.example.org/', CAST(doc_id AS STRING)) AS url,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN lang = 'en' THEN {no_text} ELSE concat(source, ' ', lang) END AS author,
               text,
               concat(CAST(DATE '2024-01-01' + CAST(floor(doc_id / 24.0) AS INT) AS STRING), 'T',
                      lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':00:00Z') AS added_at
        FROM documents""",
    # Tags of those articles as their readers typed them.
    "typed_tags": """
        SELECT doc_id + 1 AS article_id, lang AS tag FROM documents
        UNION ALL SELECT doc_id + 1, concat(' ', upper(source)) FROM documents
        UNION ALL SELECT doc_id + 1, upper(lang) FROM documents
        UNION ALL SELECT doc_id + 1, CASE WHEN n_chars > 2000 THEN 'Long Read' ELSE '' END
                  FROM documents""",
    "tags": """
        SELECT DISTINCT article_id, lower(trim(tag)) AS tag FROM typed_tags WHERE trim(tag) <> ''""",
    # A reading list: every event saves a page, in some spelling of its url.
    "visits": """
        SELECT event_id, event_type, user_id, value, props, {epoch_of_ts} AS saved_unix,
               concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), 'Z') AS added_at,
               event_id % (SELECT count(*) FROM pages) AS page_id
        FROM events""",
    "saves": """
        SELECT CASE WHEN event_type = 'error' THEN concat('ftp:', split_part(p.url, ':', 2))
                    WHEN event_type = 'click' AND p.url LIKE '%?%'
                         THEN replace(p.url, '?', '?utm_campaign=list&')
                    WHEN event_type = 'click' AND p.url LIKE '%#%'
                         THEN replace(p.url, '#', '?utm_campaign=list#')
                    WHEN event_type = 'click' THEN concat(p.url, '?utm_campaign=list')
                    ELSE p.url END AS url,
               CASE WHEN event_type = 'view' THEN {no_text}
                    ELSE concat('"', event_type, '" by ', CAST(user_id AS STRING)) END AS title,
               CASE WHEN event_type = 'signup' THEN concat('user ', CAST(user_id AS STRING))
                    ELSE {no_text} END AS author,
               v.added_at AS added_at,
               v.saved_unix AS saved_unix,
               CASE WHEN event_type = 'purchase' THEN concat('Note ', props)
                    ELSE {no_text} END AS text,
               concat(event_type, '|', upper(event_type), ' || ', 'k', CAST(user_id AS STRING))
                   AS tag_text,
               'events' AS source_file,
               event_id AS line_no
        FROM visits v JOIN pages p ON p.page_id = v.page_id""",
    # Pages as older sites write them: no article element, a byline, paragraphs by <br>, and
    # short lines that a site repeats on all its pages.
    "bare_pages": """
        SELECT page_id, url, concat(
                 replace(split_part(html, '</h1>', 1), '<article>', '<div>'),
                 '</h1><p class="byline">By Pat Reader</p>',
                 replace(replace(substr(html, instr(html, '</h1>') + 5), '. ', '.<br /> <br>'), '</article>',
                         concat('<p>Share this</p><p>', split_part(url, '/', 3), ' news.</p></div>'))) AS html
        FROM pages""",
    # One page per normalized url, and which of them earlier imports saved.
    "web_pages": """
        SELECT url, min(page_id) AS page_id FROM page_urls GROUP BY url""",
    "stored": """
        SELECT page_id + 1 AS id, url FROM web_pages WHERE url LIKE '%/de/%'""",
    "responses": """
        SELECT w.url AS url, p.page_id AS page_id,
               CASE WHEN p.url LIKE '%.html' THEN 404 WHEN p.url LIKE '%/fr/%' THEN 403
                    WHEN p.url LIKE '%#top' THEN NULL WHEN p.url LIKE '%/es/%' THEN 503
                    ELSE 200 END AS status,
               CASE WHEN p.url LIKE '%#top' AND p.url NOT LIKE '%.html' AND p.url NOT LIKE '%/fr/%'
                    THEN 'connection refused' ELSE {no_text} END AS error
        FROM web_pages w JOIN pages p ON p.page_id = w.page_id""",
    # Two archived copies of each page; the later one is not always usable.
    "snapshots": """
        SELECT url, true AS available, '20200101000000' AS timestamp, '200' AS status,
               concat('http://web.archive.org/web/20200101000000/', url) AS snapshot_url
        FROM web_pages
        UNION ALL
        SELECT url, url NOT LIKE '%.net/es/%' AS available, '20240101000000' AS timestamp,
               CASE WHEN url LIKE '%//blog.%' THEN '404' ELSE '200' END AS status,
               concat('http://web.archive.org/web/20240101000000/', url) AS snapshot_url
        FROM web_pages""",
    # Redirects: plain http moves to https; a page with a query moves on to the next page.
    # They were seen from another spelling of the url, where there is an easy one.
    "hops": """
        SELECT DISTINCT CASE WHEN url LIKE '%#%' THEN split_part(url, '#', 1)
                             WHEN url LIKE '%?%' THEN concat(url, '&utm_source=hop')
                             ELSE concat(url, '/') END AS url,
               1 AS hop, replace(url, 'http://', 'https://') AS target
        FROM pages WHERE url LIKE 'http://%'
        UNION ALL
        SELECT p.url, 2 AS hop, n.url AS target
        FROM pages p JOIN pages n ON n.page_id = p.page_id + 1 WHERE p.url LIKE '%?%'""",
    "hosts": """
        SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages""",
    # Name answers: some hosts have an internal address too, some have none.
    "resolutions": """
        SELECT host, '93.184.216.34' AS ip FROM hosts WHERE host NOT LIKE '%pills%'
        UNION ALL
        SELECT host, CASE WHEN host LIKE 'm.%' THEN '10.0.0.5' WHEN host LIKE 'www.%' THEN '172.32.0.1'
                          WHEN host LIKE '%spam%' THEN '169.254.169.254' ELSE '8.8.8.8' END AS ip
        FROM hosts WHERE host NOT LIKE '%pills%'
        UNION ALL
        SELECT host, CASE WHEN host LIKE 'blog.therr%' THEN 'fd00::1' ELSE '2606:4700::1111' END AS ip
        FROM hosts WHERE host LIKE 'blog.%'
        UNION ALL
        SELECT host, CASE WHEN host LIKE '%.net' THEN '999.1.1.1' WHEN host LIKE '%.org' THEN '2001:DB8::7'
                          WHEN host LIKE '%.com' THEN '2001:4860:4860:0:0:0:0:8888' ELSE 'fe80::1%eth0' END AS ip
        FROM hosts WHERE host LIKE 'm.%' OR host LIKE 'blog.%'""",
}


def references(sql: str, names) -> list[str]:
    """The tables among ``names`` that a statement reads."""
    words = set(re.findall(r"\w+", sql))
    return [name for name in names if name in words]


class Tables:
    """The given and derived tables of one data folder, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: bool = True) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.spread = spread
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._make(name)
        return self._known[name]

    def _make(self, name: str) -> DataFrame:
        if name in GIVEN:
            rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            # The given tables are a file or a few each; the work per row is heavy on these.
            return spread_rows(rows, SPREAD_BY[name]) if self.spread and name in SPREAD_BY else rows
        if name == "page_urls":
            return self["pages"].select("page_id", normalize_url(F.col("url")).alias("url"))
        if name == "items":
            return self["saves"].withColumn("tags", F.split("tag_text", r"\|")).drop(
                "tag_text", "saved_unix"
            )
        rows = self.sql(SHARED[name])
        return spread_rows(rows, "line_no") if name == "saves" else rows

    def as_given(self) -> "Tables":
        """The same tables where rows stay as they lie, for what deals them out itself."""
        return Tables(self.spark, self.sf_dir, spread=False)

    def dealt(self, n: int, by: str, *names: str) -> "Tables":
        """The same tables, some of them dealt out to so many parts by a column they share, where a join
        on it finds them; the others stay as they lie."""
        other = self.as_given()
        other._known = {name: other[name].repartition(n, by) for name in names}
        return other

    def sql(self, statement: str) -> DataFrame:
        """Run a shared statement over these tables."""
        names = references(statement, (*GIVEN, "page_urls", *SHARED))
        return self.spark.sql(
            re.sub(
                r"\b(FROM|JOIN) (\w+)\b",
                lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in names else m[0],
                statement.replace("{epoch_of_ts}", SPARK_WORDS["epoch_of_ts"]).replace(
                    "{no_text}", SPARK_WORDS["no_text"]
                ),
            ),
            **{name: self[name] for name in names},
        )
