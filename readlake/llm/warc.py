"""WARC archives with a two-level capture index.

Records are gzip members of their own, so each can be read by its place. The capture index
holds one line per record, sorted by the reversed host and the rest of the URL, in
compressed blocks; a directory names each block's first key and place. A lookup searches
the parts, then a part's directory, then the block by halving, and only then reads the
record's range.

Files are written by tasks under names that carry the attempt, and count once the table of
what was written is committed; what a lost attempt leaves is never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import arrow_location
from ..session import materialize, scratch_path

MIN_SHARED = 1000  # payloads of fewer bytes are never revisits
FILE_BYTES = 1 << 30
BLOCK_LINES = 256
LEVEL = 3
GAP_BYTES = 1 << 16  # ranges that lie closer are read at once
READ_BYTES = 4 << 20
TASK_BYTES = 64 << 20  # what a task reads of the archives, compressed
LEAST_BYTES = 1 << 20  # and at least, where there is less than that for every core
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


@contextmanager
def _new_file(uri: str):
    system, path = arrow_location(uri)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def sort_key(url: Column) -> Column:
    """The URL with its host reversed, com,example,www)/path; `-` for a null URL. Signs that
    would break a line are percent-encoded."""
    host = F.lower(F.regexp_extract(url, rf"{_AUTHORITY}([^/?#:]*)", 1))
    rest = F.regexp_extract(url, rf"(?s){_AUTHORITY}[^/?#:]*(.*)$", 1)
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    key = F.when(F.length(host) > 0, turned).otherwise(url)
    for sign, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(sign), F.lit(code))
    return F.coalesce(key, F.lit("-"))


def _page_text(page_id: int | None) -> str:
    """An id as 20 signs that sort as the ids do, nulls last."""
    return "~" * 20 if page_id is None else f"{page_id + (1 << 63):020d}"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, response: bool) -> bytes:
    def name(page) -> str:
        return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}:{digest}')}>"

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    packed = base64.b32encode(bytes.fromhex(digest)).decode()
    head += [f"WARC-Date: {DATE}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Payload-Digest: sha1:{packed}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if not response:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    body = http + payload if response else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says: its own headers, and of its payload the size and the SHA-1. Those of
    a response are taken from the payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {
        "page_id": int(fields["Page-ID"]) if "Page-ID" in fields else None,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in fields else None,
    }
    if out["record_type"] == "response":
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError("a payload does not have its digest")
        return out | {"payload_bytes": len(payload), "payload_digest": stated, "payload": payload}
    size = re.search(rb"(?i)\r\nContent-Length: (\d+)", http)
    return out | {"payload_bytes": int(size[1]), "payload_digest": stated, "payload": None}


def decide(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, digest, size, refers_to) of each different page_id and payload. Of equal
    payloads of ``min_shared`` bytes or more, the one with the largest page_id is the response
    and refers to nothing; if all their ids are null, all are responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"))
    marks = materialize(marks.distinct(), "payloads")
    first = marks.where(F.col("size") >= min_shared).groupBy("digest").agg(F.max("page_id").alias("first"))
    other = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")
    return marks.join(first, "digest", "left").select("page_id", "digest", "size", other)


def write_archive(pages: DataFrame, root: str, min_shared: int = MIN_SHARED, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of (page_id, url, html) below ``root``; returns the table of
    records: key, page_id, file, offset, length.

    A null or empty html is an empty payload; a null url has no target. Rows with equal
    page_id and payload are written one by one. Other columns are not read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), sort_key(F.col("url")).alias("key"))
    decided = decide(pages, min_shared).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "size", "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    ready = source.join(decided, same).select(
        "page_id",
        "url",
        "key",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        "size",
        "digest",
        "refers_to",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, stream, uri, at = 0, None, "", 0
        with ExitStack() as files:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if stream is None or at >= file_bytes:
                        files.close()
                        uri, at = f"{root}/warc/{_attempt()}-{number:05d}.warc.gz", 0
                        stream, number = files.enter_context(_new_file(uri)), number + 1
                    response = row["refers_to"] is None
                    fields = [row[c] for c in ("size", "digest", "refers_to")]
                    data = record(row["page_id"], row["url"], row["payload"] or b"", *fields, response)
                    member = gzip_member(data)
                    stream.write(member)
                    rows.append((row["key"], row["page_id"], uri, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r)) for r in rows], schema=_RECORD)

    return materialize(ready.mapInArrow(write, "key string, page_id bigint, file string, offset bigint, length bigint"), "records")


_RECORD = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_PART = pa.schema([("first", pa.string()), ("last", pa.string()), ("blocks", pa.string()), ("directory", pa.string())])


def _line_key(key: str, page_id: int | None) -> str:
    return f"{key} {_page_text(page_id)}"


def write_index(records: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the records by key and write them as compressed blocks with a directory per part;
    returns one row per part: its first and last line key and its two files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = f"{root}/index/{_attempt()}.cdx.gz"
        directory, lines, first, last, at = [], [], None, None, 0

        def flush(stream) -> None:
            nonlocal at
            if lines:
                member = gzip_member("".join(line + "\n" for _, line in lines).encode())
                directory.append(f"{lines[0][0]}\t{at}\t{len(member)}")
                stream.write(member)
                at += len(member)
                lines.clear()

        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        if row is None:
            return
        with _new_file(blocks) as stream:
            while row is not None:
                last = _line_key(row["key"], row["page_id"])
                first = first or last
                place = json.dumps({"file": row["file"], "offset": row["offset"], "length": row["length"]})
                lines.append((last, f"{last} {place}"))
                if len(lines) >= block_lines:
                    flush(stream)
                row = next(rows, None)
            flush(stream)
        with _new_file(blocks.replace(".cdx.gz", ".dir")) as stream:
            stream.write("\n".join(directory).encode())
        yield pa.RecordBatch.from_pylist(
            [{"first": first, "last": last, "blocks": blocks, "directory": blocks.replace(".cdx.gz", ".dir")}], schema=_PART
        )

    order = ["key", F.col("page_id").asc_nulls_last()]
    ordered = records.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(write, "first string, last string, blocks string, directory string"), "parts")


class Index:
    """Lookups in a written index; holds one part's directory and one block at a time."""

    def __init__(self, parts: list[tuple[str, str, str, str]]):
        self.parts = sorted(parts)
        self.lasts = [part[1] for part in self.parts]
        self.part = self.block = None
        self.reads = 0

    def _open(self, part: int) -> None:
        if self.part != part:
            system, path = arrow_location(self.parts[part][3])
            with system.open_input_stream(path, compression=None) as stream:
                lines = stream.read().decode().split("\n")
            self.directory = [line.split("\t") for line in lines]
            self.firsts = [line[0] for line in self.directory]
            self.part, self.block = part, None

    def _load(self, block: int) -> None:
        if self.block != block:
            _, offset, length = self.directory[block]
            system, path = arrow_location(self.parts[self.part][2])
            with system.open_input_file(path) as file:
                data = file.read_at(int(length), int(offset))
            self.lines = zlib.decompress(data, 31).decode().split("\n")[:-1]
            self.block, self.reads = block, self.reads + 1

    def find(self, key: str, page_id: int | None = None, any_page: bool = False) -> Iterator[dict]:
        """The places of the records of a key, or of one page under it."""
        prefix = f"{key} " if any_page else f"{_line_key(key, page_id)} "
        part = bisect_left(self.lasts, prefix.rstrip(" "))
        while part < len(self.parts) and (self.parts[part][0] + " ")[: len(prefix)] <= prefix:
            self._open(part)
            block = max(0, bisect_left(self.firsts, prefix.rstrip(" ")) - 1)
            while block < len(self.firsts) and (self.firsts[block] + " ")[: len(prefix)] <= prefix:
                self._load(block)
                for line in self.lines[bisect_left(self.lines, prefix) :]:
                    if not line.startswith(prefix):
                        break
                    yield json.loads(line.split(" ", 2)[2])
                block += 1
            part += 1


def locate(spark: SparkSession, parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up each different (key, page_id) in the index: (file, offset, length) of the records
    found. Lookups are sorted by key, so that a task reads each block once. The list of
    parts, one row per task that wrote the index, goes to all tasks."""
    shared = spark.sparkContext.broadcast([tuple(row) for row in parts.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("page_id").to_pylist()
            found = [place for key, page in zip(keys, ids) for place in index.find(key, page)]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(list(_RECORD)[2:]))

    order = ["key", F.col("page_id").asc_nulls_last()]
    asked = wanted.select("key", "page_id").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return asked.mapInArrow(find, "file string, offset bigint, length bigint")


def read_records(places: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read and parse the records at (file, offset, length). A file's ranges are read in order,
    neighbouring ones together. There are as many tasks as there is to read of the archives,
    however few bytes the places themselves take."""

    def members(rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
        held, uri, begin, data, file = [], None, 0, b"", None

        def drain() -> Iterator[bytes]:
            if held:
                start, end = held[0][0], held[-1][0] + held[-1][1]
                data = file.read_at(end - start, start)
                for offset, length in held:
                    yield zlib.decompress(data[offset - start : offset - start + length], 31)
                held.clear()

        for name, offset, length in rows:
            far = held and (offset > sum(held[-1]) + GAP_BYTES or offset + length - held[0][0] > READ_BYTES)
            if name != uri or far:
                yield from drain()
            if name != uri:
                if file is not None:
                    file.close()
                system, path = arrow_location(name)
                uri, file = name, system.open_input_file(path)
            held.append((offset, length))
        yield from drain()
        if file is not None:
            file.close()

    kind = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    if with_payload:
        kind += ", payload binary"
    schema = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        + ([("payload", pa.binary())] if with_payload else [])
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        held, size = [], 0
        for data in members(rows):
            held.append(parse_record(data))
            if not with_payload:
                held[-1].pop("payload")
            size += len(data) if with_payload else 200
            if size >= READ_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = places.sparkSession.sparkContext.defaultParallelism
    tasks = 1 + max(total // TASK_BYTES, min(cores - 1, total // LEAST_BYTES))
    ordered = places.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(read, kind)


def archive_and_read(pages: DataFrame, root: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write the pages, index them, look each one up and read it back: per page ``page_id``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    ``root`` is a folder that all executors reach; by default one below spark.checkpoint.dir.
    """
    spark = pages.sparkSession
    root = root or scratch_path(spark, "archive")
    parts = write_index(write_archive(pages, root), root)
    wanted = pages.select(sort_key(F.col("url")).alias("key"), "page_id")
    places = materialize(locate(spark, parts, wanted), "places")
    return read_records(places, with_payload).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else []))
