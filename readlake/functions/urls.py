"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "ref_src", "source",
)
WEB_SCHEMES = ("http", "https")
# Schemes whose URLs keep an empty authority ("//") when rebuilt.
_AUTHORITY_SCHEMES = ("http", "https", "ftp", "file")

_SCHEME = r"\A([a-zA-Z][a-zA-Z0-9+.-]*):"
_PARTS = r"(?s)\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
# What nearly all urls look like: site, path without its last slashes, query.
_USUAL = (
    r"(?s)\A([a-z][a-z0-9+.-]*://[^/?#\x00-\x20]+)((?:/+[^/?#\x00-\x20]+)*)/*"
    r"(?:\?([^#\x00-\x20]*))?(?:#[^\x00-\x20]*)?\z"
)

# IPv4 blocks that are not public (first address, last address).
BLOCKED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)
_OCTET = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IPV4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"

# Of the IPv6 blocks for public hosts, those that are not public
# (first address, last address); outside of them nothing is public.
PUBLIC_IPV6 = ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff")
BLOCKED_IPV6 = (
    ("2001::", "2001:1::"),
    ("2001:1::3", "2001:2:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("2001:4::", "2001:4:111:ffff:ffff:ffff:ffff:ffff"),
    ("2001:4:113::", "2001:1f:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("2001:40::", "2001:1ff:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("2002::", "2002:ffff:ffff:ffff:ffff:ffff:ffff:ffff"),
    ("3fff::", "3fff:fff:ffff:ffff:ffff:ffff:ffff:ffff"),
)


def _tidy(url: Column) -> Column:
    """Leading control characters and blanks go, and line breaks anywhere."""
    return F.translate(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), "\t\r\n", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_tidy(url), _SCHEME, 1))


def _decode(text: Column) -> Column:
    """Form decoding; a '%' that starts no escape stays as it is."""
    return F.url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    """Form encoding that keeps letters, digits and ``_.-~`` only."""
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def _clean_query(query: Column) -> Column:
    def pair(text: Column) -> Column:
        return F.struct(
            _decode(F.substring_index(text, "=", 1)).alias("name"),
            _decode(F.regexp_replace(text, r"(?s)\A[^=]*=", "")).alias("value"),
        )

    # A parameter without "=" or with a blank value is dropped.
    valued = F.filter(F.split(query, "&"), lambda text: text.rlike(r"(?s)=."))
    wanted = F.filter(F.transform(valued, pair), lambda p: ~p["name"].isin(*TRACKING_PARAMS))
    return F.array_join(
        F.transform(wanted, lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))),
        "&",
    )


def normalize_url(url: Column) -> Column:
    """One spelling per page: no fragment, no tracking parameters, no trailing slash."""
    # Every part is used once, since Spark would compute it anew for each use.
    site, path, query = (F.regexp_extract(url, _USUAL, group) for group in (1, 2, 3))
    cleaned = F.when(url.contains("="), _clean_query(query)).otherwise(F.lit(""))
    usual = F.concat(site, F.regexp_replace(path, r"\A\z", "/"), _with_mark(cleaned))
    return F.when(url.rlike(_USUAL), usual).otherwise(_normalize_any(url))


def _with_mark(query: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("?"), query), r"\A\?\z", "")


def _normalize_any(url: Column) -> Column:
    tidy = _tidy(url)
    scheme = url_scheme(url)
    netloc = F.regexp_extract(tidy, _PARTS, 1)
    path = F.coalesce(
        F.nullif(F.rtrim(F.regexp_extract(tidy, _PARTS, 2), F.lit("/")), F.lit("")), F.lit("/")
    )
    query = _clean_query(F.regexp_extract(tidy, _PARTS, 3))
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin(*_AUTHORITY_SCHEMES) & path.startswith("/"), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        body,
        _with_mark(query),
    )


def has_web_scheme(url: Column) -> Column:
    """http or https in any case: what a capture may be."""
    return url_scheme(url).isin(*WEB_SCHEMES)


def has_import_scheme(url: Column) -> Column:
    """An import tests the prefix as written, case-sensitively."""
    return url.startswith("http://") | url.startswith("https://")


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port or brackets; null when there is none."""
    netloc = F.regexp_extract(_tidy(url), _PARTS, 1)
    address = F.regexp_replace(netloc, r"\A.*@", "")
    host = F.when(
        address.startswith("["), F.regexp_extract(address, r"\A\[([^\]]*)\]", 1)
    ).otherwise(F.substring_index(address, ":", 1))
    return F.nullif(F.lower(host), F.lit(""))


def ipv4_number(ip: Column) -> Column:
    octet = [F.split(ip, r"\.")[i].cast("bigint") for i in range(4)]
    return F.when(
        ip.rlike(IPV4), octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    )


def _ipv4_int(ip: str) -> int:
    a, b, c, d = (int(part) for part in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_blocked_ipv4(number: Column) -> Column:
    """Private, loopback, link-local, reserved, multicast or unspecified; also what could not
    be read as an address. ``number`` is a column of its own."""
    blocked = F.lit(False)
    for first, last in BLOCKED_IPV4:
        blocked = blocked | number.between(_ipv4_int(first), _ipv4_int(last))
    return F.coalesce(blocked, F.lit(True))


def ipv6_digits(ip: Column) -> Column:
    """All 32 hexadecimal digits of an IPv6 address; null if it is not readable."""
    # A dotted end is two groups.
    dotted = F.split(F.regexp_extract(ip, rf"[:]({_OCTET}(?:\.{_OCTET}){{3}})\z", 1), r"\.")
    octet = [F.lpad(F.conv(F.get(dotted, i), 10, 16), 2, "0") for i in range(4)]
    tail = F.concat(octet[0], octet[1], F.lit(":"), octet[2], octet[3])
    plain = F.when(ip.contains("."), F.concat(F.regexp_extract(ip, r"\A(.*:)", 1), tail)).otherwise(ip)
    halves = F.split(F.lower(plain), "::")

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    head, end = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    missing = 8 - F.size(head) - F.size(end)
    whole = F.when(
        (F.size(halves) == 2) & (missing >= 1), F.concat(head, F.array_repeat(F.lit("0"), missing), end)
    ).when((F.size(halves) == 1) & (missing == 0), head)
    readable = F.forall(whole, lambda group: group.rlike(r"\A[0-9a-f]{1,4}\z"))
    return F.when(readable, F.array_join(F.transform(whole, lambda group: F.lpad(group, 4, "0")), ""))


def _ipv6_digits(ip: str) -> str:
    head, _, end = ip.partition("::")
    first, last = (half.split(":") if half else [] for half in (head, end))
    return "".join(group.zfill(4) for group in [*first, *["0"] * (8 - len(first) - len(last)), *last])


def is_blocked_ipv6(digits: Column) -> Column:
    """The same for the digits of an IPv6 address, a column of its own."""
    blocked = ~digits.between(*map(_ipv6_digits, PUBLIC_IPV6))
    for first, last in BLOCKED_IPV6:
        blocked = blocked | digits.between(_ipv6_digits(first), _ipv6_digits(last))
    return F.coalesce(blocked, F.lit(True))


def raw_snapshot_url(snapshot_url: Column, timestamp: Column) -> Column:
    """The raw form of an archived copy: ``/web/<ts>id_/`` (first only) over https."""
    stamp = F.nullif(timestamp, F.lit(""))
    plain = F.concat(F.lit("/web/"), stamp, F.lit("/"))
    found = F.instr(snapshot_url, plain)
    rewritten = F.when(
        found > 0,
        F.concat(
            F.substr(snapshot_url, F.lit(1), found - 1),
            F.concat(F.lit("/web/"), stamp, F.lit("id_/")),
            F.substr(snapshot_url, found + F.length(plain)),
        ),
    ).otherwise(snapshot_url)
    return F.regexp_replace(
        rewritten, r"(?s)\A(.*?)http://web\.archive\.org", "$1https://web.archive.org"
    )
