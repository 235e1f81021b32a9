"""Files that tasks write or read by themselves, by the names Spark uses for them."""

from __future__ import annotations

import re

import pyarrow.fs as pafs

# Hadoop's schemes that Arrow knows by other names. Others, such as file, hdfs,
# s3, gs and abfs, have the same name for both.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def arrow_location(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder or file; a plain path is a local or mounted one."""
    scheme, found, rest = uri.partition(":")
    if not found or scheme == "file":
        # Hadoop writes one slash where Arrow wants three.
        return pafs.LocalFileSystem(), re.sub(r"\Afile:/*", "/", uri)
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}:{rest}")
