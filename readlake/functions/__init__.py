"""Column expressions: everything here is built from JVM-side Spark functions."""

from .dates import iso_from_string, iso_from_unix
from .tags import clean_tags, split_tags
from .text import (
    display_title,
    escape_html,
    paragraphs,
    saved_day,
    slugify,
    strip,
    tokens,
    yaml_quote,
)
from .urls import (
    has_import_scheme,
    has_web_scheme,
    is_blocked_ipv4,
    normalize_url,
    raw_snapshot_url,
    url_host,
    url_scheme,
)

__all__ = [
    "clean_tags",
    "display_title",
    "escape_html",
    "has_import_scheme",
    "has_web_scheme",
    "is_blocked_ipv4",
    "iso_from_string",
    "iso_from_unix",
    "normalize_url",
    "paragraphs",
    "raw_snapshot_url",
    "saved_day",
    "slugify",
    "split_tags",
    "strip",
    "tokens",
    "url_host",
    "url_scheme",
    "yaml_quote",
]
