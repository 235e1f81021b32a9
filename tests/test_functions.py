"""Scalars against stated facts and against the standard library."""

import datetime
import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from readlake.functions import (
    clean_tags,
    display_title,
    escape_html,
    is_blocked_ipv4,
    iso_from_string,
    iso_from_unix,
    normalize_url,
    paragraphs,
    raw_snapshot_url,
    saved_day,
    slugify,
    strip,
    tokens,
    url_host,
    yaml_quote,
)
from readlake.functions.urls import ipv4_number
from readlake.functions.text import tokenize_words
from readlake.functions.urls import TRACKING_PARAMS, has_import_scheme, has_web_scheme


def evaluate(spark, function, values, schema="v string"):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v)
                                for i, v in enumerate(values)], "i int, " + schema)
    columns = [F.col(c) for c in df.columns[1:]]
    return [r.o for r in df.select("i", function(*columns).alias("o")).orderBy("i").collect()]


EDGE_URLS = [
    "https://example.com/a?utm_source=x&id=1&utm_medium=y",
    "https://example.com/a/", "https://example.com/a///", "https://example.com",
    "https://example.com/", "https://example.com/a#part", "http://example.com/a?b=1&a=2&b=1",
    "HTTPS://User:pw@Example.COM:8080/Path/?Q=1&ref=z&REF=z", "https://e.org/?a=&b&c=%20x*y~z/é",
    "https://e.org/p?x=%FF&y=100%&z=%zz+1", "https://e.org//two//?a=b=c", "  https://e.org/a\nb",
    "mailto:someone@example.org", "https://e.org/a;p?x=1;y=2", "//e.org/a/", "notes.txt",
    "https://e.org?x=1#a#b?c", "http:/one/slash/", "ftp://e.org/a/?source=1&s=2",
]


def stdlib_normalized(url):
    parts = urlsplit(url)
    kept = [(k, v) for k, v in parse_qsl(parts.query) if k not in TRACKING_PARAMS]
    path = parts.path
    while path.endswith("/"):
        path = path[:-1]
    return urlunsplit((parts.scheme, parts.netloc, path if path else "/", urlencode(kept), ""))


def test_normalize_url_equals_stdlib(spark, sf_dir):
    urls = EDGE_URLS + pq.read_table(f"{sf_dir}/pages.parquet")["url"].to_pylist()
    assert evaluate(spark, normalize_url, urls) == [stdlib_normalized(u) for u in urls]


def test_url_parts(spark):
    urls = ["https://User@Example.com:8080/x", "http://[::1]:80/", "nohost", "HTTP://h/"]
    assert evaluate(spark, url_host, urls) == ["example.com", "::1", None, "h"]
    assert evaluate(spark, has_web_scheme, ["HTTP://h", "ftp://h", "x"]) == [True, False, False]
    assert evaluate(spark, has_import_scheme, ["HTTP://h", "http://h"]) == [False, True]


def test_blocked_addresses(spark):
    cases = {"127.0.0.1": True, "169.254.169.254": True, "10.0.0.5": True, "93.184.216.34": False,
             "172.31.0.1": True, "172.32.0.1": False, "192.0.0.9": False, "192.0.0.1": True,
             "240.0.0.1": True, "224.0.0.1": True, "0.0.0.0": True, "8.8.8.8": False}
    assert evaluate(spark, lambda ip: is_blocked_ipv4(ipv4_number(ip)), list(cases)) == list(cases.values())


def test_iso_from_unix(spark):
    values = ["1451606400", "1600000000", "1500000000.9", "1e9", "0", "-5", "", None, "soon",
              "999999999999999", " 1451606400 ", "nan"]
    assert evaluate(spark, iso_from_unix, values) == [
        "2016-01-01T00:00:00Z", "2020-09-13T12:26:40Z", "2017-07-14T02:40:00Z",
        "2001-09-09T01:46:40Z", None, None, None, None, None, None, "2016-01-01T00:00:00Z", None]


def test_iso_from_string(spark):
    values = ["2024-05-01T10:00:00Z", "2024-05-01", "2024-05-01 10:00", "2024-05-01T10:00:00.123+02:00",
              "2024-05-01T10:00:00-0530", "20240501T101112", "2024-02-30", "yesterday", "", None,
              "2024-05-01T25:00:00", "2024-05-01T10:00:00.5Z"]

    def expected(value):
        try:
            at = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            return None
        at = at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)
        return at.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    assert evaluate(spark, iso_from_string, values) == [expected(v) for v in values]


def test_clean_tags(spark):
    values = [(["Python", "essays", "python ", ""],), (None,), ([" B\t", "b", None],)]
    assert evaluate(spark, clean_tags, values, "v array<string>") == [["python", "essays"], [], ["b"]]


TITLES = ['Trains: "A Short" History', "  __Hello   World__ ", "Été à la plage — ½ prix", "!!!", "",
          "x" * 59 + " yz", "漢字 テスト_a-b", "tab\tand nbsp"]


def test_slugify_equals_plain_rule(spark):
    def expected(title):
        kept = "".join(c for c in title.lower() if c.isalnum() or c in "_-" or c.isspace())
        joined = re.sub(r"[\s_-]+", "-", kept).strip("-")[:60].strip("-")
        return joined if joined else "article"

    assert evaluate(spark, slugify, TITLES) == [expected(t) for t in TITLES]


def test_quoting(spark):
    values = ['a "b" \\ c', None, "<a href='x'>&amp;</a>"]
    assert evaluate(spark, yaml_quote, values) == ['"a \\"b\\" \\\\ c"', '""', "\"<a href='x'>&amp;</a>\""]
    assert evaluate(spark, escape_html, values) == [html.escape(v) if v is not None else None for v in values]


def test_titles_and_days(spark):
    assert evaluate(spark, display_title, [("", "u"), (None, "u"), ("t", "u")], "a string, b string") == ["u", "u", "t"]
    assert evaluate(spark, saved_day, ["2024-01-02T03:04:05Z", None]) == ["2024-01-02", ""]


def test_strip_and_paragraphs_equal_stdlib(spark):
    values = ["  a b \n\n c\t\r\nd\x0be\x0cf\x1cg\x85h i　 \r", "", " \n ", "one"]
    assert evaluate(spark, strip, values) == [v.strip() for v in values]
    assert evaluate(spark, paragraphs, values) == [
        [line.strip() for line in v.splitlines() if line.strip()] for v in values]


@pytest.mark.parametrize("text,expected", [
    ("Café señor don't under_score", ["cafe", "senor", "don", "t", "under", "score"]),
    ("Straße øre łódź Ünï é", ["straße", "øre", "łodz", "uni", "e"]),
    ("", []), ("... 3.14", ["3", "14"]),
])
def test_tokens(spark, text, expected):
    assert evaluate(spark, tokens, [text]) == [expected]
    assert tokenize_words(text) == expected


def test_raw_snapshot_url(spark):
    values = [("http://web.archive.org/web/2020/http://web.archive.org/web/2020/x", "2020"),
              ("https://web.archive.org/web/2020/http://e.org/", "2019"), ("http://e.org", None)]
    assert evaluate(spark, raw_snapshot_url, values, "a string, b string") == [
        "https://web.archive.org/web/2020id_/http://web.archive.org/web/2020/x",
        "https://web.archive.org/web/2020/http://e.org/", "http://e.org"]


def test_only_text_beyond_ascii_is_folded(spark, monkeypatch):
    from readlake.functions import text

    samples = ["", "Ab c-9_x", "KK k", "İstanbul", "naïve café A1", "áb", "x y", "中文 ab", "\x00a\x7fb"]
    rows = spark.createDataFrame([(s,) for s in samples], "v string").coalesce(1)
    got = [r[0] for r in rows.select(text.tokens(F.col("v"))).collect()]
    assert got == [text.tokenize_words(s) for s in samples]
    monkeypatch.setattr(text, "FOLD_FROM", "a")
    monkeypatch.setattr(text, "FOLD_TO", "o")
    few = spark.createDataFrame([("banana",), ("bananña",)], "v string").coalesce(1)
    assert [r[0] for r in few.select(text.tokens(F.col("v"))).collect()] == [["banana"], ["bononño"]]
