"""Fetched responses: bodies as the server sent them."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content encodings that are undone.
GZIP_ENCODINGS = ("gzip", "x-gzip")
DEFLATE = "deflate"
_CHARSET = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w-]+)", re.IGNORECASE)


def _plain(body: bytes, encoding: str) -> bytes:
    if encoding in GZIP_ENCODINGS:
        return gzip.decompress(body)
    if encoding == DEFLATE:
        try:
            return zlib.decompress(body)
        except zlib.error:  # no zlib header
            return zlib.decompress(body, wbits=-zlib.MAX_WBITS)
    return body


def _text(body: bytes) -> str:
    declared = _CHARSET.search(body)
    charset = declared.group(1).decode("ascii") if declared else "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


_DECODED = T.StructType().add("html", T.StringType()).add("error", T.StringType())


@F.pandas_udf(_DECODED)
def _decode(bodies: pd.Series, encodings: pd.Series) -> pd.DataFrame:
    rows = []
    for body, encoding in zip(bodies, encodings, strict=True):
        if body is None:
            rows.append((None, None))
            continue
        try:
            rows.append((_text(_plain(bytes(body), encoding)), None))
        except (OSError, EOFError, zlib.error) as error:
            rows.append((None, f"{type(error).__name__}: {error}"))
    return pd.DataFrame(rows, columns=["html", "error"])


def decode_responses(responses: DataFrame) -> DataFrame:
    """Replace (content_encoding, body) by html; a body that is broken becomes an error."""
    encoding = F.lower(F.trim(F.coalesce("content_encoding", F.lit(""))))
    kept = [c for c in responses.columns if c not in ("content_encoding", "body", "error")]
    error = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    return responses.withColumn("decoded", _decode("body", encoding)).select(
        *kept,
        F.col("decoded.html").alias("html"),
        F.coalesce(error, F.col("decoded.error")).alias("error"),
    )
