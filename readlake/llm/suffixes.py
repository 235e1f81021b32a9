"""Removal of byte strings that occur again, by a column-wise suffix order.

A string of LENGTH bytes is found where it occurs again in three steps.

1. Each window of LENGTH bytes has one anchor, the leftmost of its rarest-hashed runs of GRAM
   bytes. It depends on the window's bytes alone, so equal windows have equal anchors at
   equal places. The windows of one anchor are a segment; only segments whose anchor
   occurs again can hold a repeat.
2. Segments with the same anchor are lined up at it and built up as a collection, column by
   column from the right: a round inserts one symbol in front of every segment, which
   brings the collection's suffix order (its Burrows-Wheeler order) and the common prefixes
   of neighbours in it up to date. Because equal windows stand in the same column, the
   suffixes of a column need only be ordered among themselves, and a round is linear.
   Windows whose neighbour shares LENGTH bytes occur again.
3. What was found for a segment holds for all its copies, wherever they are.

Equal segments are counted before anything is moved, and only one of them is built up; what
occurs twice has itself for a neighbour. A collection of more than CROWD different segments
is not built in one task: its windows are counted one by one instead, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import text as t

LENGTH = 200
GRAM = 16
CROWD = 50_000
ROUND_ROWS = 1 << 15
_PLACE_BITS = 24
PIECE = 1 << 22  # window starts of a text that are looked at together


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of all texts: hash of the anchor, its place, first window, end of the last
    window (places in ``raw``)."""
    grams = len(raw) - GRAM + 1
    width = length - GRAM + 1
    windows = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none.astype(np.uint64), none, none, none
    starts = np.arange(grams)
    hashes = t.range_hashes(raw, starts, starts + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (hashes & ~low) | starts.astype(np.uint64)
    # The least key of each window, from least keys of blocks' beginnings and ends.
    padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    place = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begin = np.flatnonzero(text[:windows] == text[length - 1 :])
    if not len(begin):
        return none.astype(np.uint64), none, none, none
    place = place[begin]
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(begin) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(begin)] - 1
    return hashes[place[first]], place[first], begin[first], begin[last] + length


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts as they are or, of one very long text, parts that share length - 1 bytes."""
    if len(raw) <= PIECE:
        yield 0, raw, offsets
        return
    for begin, end in zip(offsets, offsets[1:]):
        for at in range(int(begin), max(int(begin) + 1, int(end) - length + 1), PIECE):
            part = raw[at : min(at + PIECE + length - 1, int(end))]
            yield at, part, np.array([0, len(part)])


def build_up(segments: list[bytes], before: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first window, last window) of all runs of windows that a segment shares with
    another of its group at the same distance from the anchor; windows by their distance
    from it. ``before`` is how many bytes stand before the anchor; groups are contiguous."""
    m = len(segments)
    sizes = np.array([len(s) for s in segments])
    zero = int(before.max())
    columns = int((sizes - before).max()) + zero
    symbols = np.zeros((columns, m), np.uint16)  # 0: the segment does not reach here
    flat = np.frombuffer(b"".join(segments), np.uint8)
    row = np.repeat(np.arange(m), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    symbols[at + (zero - before)[row], row] = flat.astype(np.uint16) + 1
    repeated = np.zeros((columns - length + 1, m), bool)
    order = np.arange(m)
    major = group.astype(np.int64) << 10
    common = np.zeros(m, np.int32)  # with the one before in the order
    for column in range(columns - 1, -1, -1):
        key = major + symbols[column, order]
        shared = key & 1023 > 0
        if (key[1:] < key[:-1]).any():
            moved = np.argsort(key, kind="stable")
            key, shared = key[moved], shared[moved]
            gap = np.flatnonzero((moved[1:] != moved[:-1] + 1) & (key[1:] == key[:-1]) & shared[1:])
            least = common[moved]
            if len(gap):
                bounds = np.stack([moved[gap] + 1, moved[gap + 1] + 1], axis=1).ravel()
                least[gap + 1] = np.minimum.reduceat(np.r_[common, 0], bounds)[::2]
            order = order[moved]
        else:
            least = common
        same = np.r_[False, key[1:] == key[:-1]] & shared
        common = np.where(same, least + 1, 0).astype(np.int32)
        if column + length <= columns:
            best = np.maximum(common, np.r_[common[1:], 0])
            repeated[column, order[best >= length]] = True
    edges = np.diff(np.pad(repeated, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    who, start = np.nonzero((edges == 1).T)
    _, stop = np.nonzero((edges == -1).T)
    return list(zip(who.tolist(), (start - zero).tolist(), (stop - 1 - zero).tolist()))


def repeats(documents: DataFrame, length: int = LENGTH, text_column: str = "text", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The documents with a key of their text's content (k1, k2) and their text without null,
    ``_text``; and (k1, k2, ranges): the byte ranges of that text that hold strings of
    ``length`` bytes which occur again, start << 32 | end, in any order."""
    if length < GRAM:
        raise ValueError(f"the length is {GRAM} bytes or more")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    keyed = documents.withColumn("_text", text).withColumns(
        {"k1": F.xxhash64("_text"), "k2": F.xxhash64(F.lit("second"), "_text")}
    )
    texts = keyed.select("k1", "k2", "_text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "_text"):
                whole, borders = t.utf8(part.column("_text"))
                for shift, raw, offsets in _pieces(whole, borders, length):
                    anchor, place, first, end = anchors(raw, offsets, length)
                    owner = np.searchsorted(borders, first + shift, "right") - 1
                    before, after = place - first, end - place
                    shape = (before.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
                    digest = t.mix(t.range_hashes(raw, first, end) ^ t.mix(shape))
                    arrays = [part.column(c).take(pa.array(owner)) for c in ("k1", "k2")]
                    arrays += [pa.array(x.view(np.int64)) for x in (anchor, digest)]
                    arrays += [pa.array(x.astype(np.int32)) for x in (place + shift - borders[owner], before, after)]
                    yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "anchor", "digest", "at", "before", "after"])

    found = texts.mapInArrow(
        find, "k1 bigint, k2 bigint, anchor bigint, digest bigint, at int, before int, after int"
    )
    found = materialize(found, "anchors")
    # Written, so that the join deals its sides out anew and a common anchor's rows can be split.
    again = materialize(found.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated")
    places = materialize(found.join(again, "anchor", "left_semi"), "places")
    ones = [F.first(c).alias(c) for c in ("k1", "k2", "at", "before", "after")]  # all of one row
    kinds = places.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), *ones)
    kinds = materialize(kinds, "segments")
    sizes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    asked = kinds.join(sizes.where("m > 1"), "anchor")
    wanted = asked.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "digest", "n", "m", "at", "before", "after")).alias("wanted")
    )
    names = ["anchor", "digest", "n", "m", "before"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for part in t.slices(batch, "_text"):
                rows = {c: [] for c in names}
                cuts = []
                for k1, k2, text, wanted in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "_text", "wanted"))):
                    if (k1, k2) == seen:  # copies come one after another
                        continue
                    seen, raw = (k1, k2), text.encode()
                    for one in wanted:
                        for c in names:
                            rows[c].append(one[c])
                        cuts.append(raw[one["at"] - one["before"] : one["at"] + one["after"]])
                arrays = [pa.array(rows[c], pa.int32() if c == "before" else pa.int64()) for c in names]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(cuts, pa.binary())], [*names, "bytes"])

    pieces = texts.join(wanted.hint("shuffle_merge"), ["k1", "k2"]).mapInArrow(
        cut, "anchor bigint, digest bigint, n bigint, m bigint, before int, bytes binary"
    )
    pieces = materialize(pieces, "pieces")
    spans = "anchor bigint, digest bigint, lo int, hi int"
    names_out = ["anchor", "digest", "lo", "hi"]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in collections(batches):
            anchor, digest = rows["anchor"], rows["digest"]
            group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])
            hits = build_up(rows["bytes"], rows["before"], group, length)
            who = np.array([h[0] for h in hits], np.int64)
            lo = np.array([h[1] for h in hits], np.int32)
            hi = np.array([h[2] + length for h in hits], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[who], digest[who], lo, hi)], names_out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                before = part.column("before").to_numpy()
                blob = part.column("bytes").to_pylist()
                count = np.array([len(b) for b in blob]) - length + 1
                row = np.repeat(np.arange(len(blob)), count)
                at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                text = [hashlib.blake2b(blob[i][j : j + length], digest_size=16).digest() for i, j in zip(row, at)]
                columns = [part.column(c).take(pa.array(row)) for c in ("anchor", "digest", "n")]
                lo = pa.array((at - before[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*columns, lo, pa.array(text)], ["anchor", "digest", "n", "lo", "window"])

    lined_up = pieces.where(F.col("m") <= crowd).repartition("anchor").sortWithinPartitions("anchor", "digest")
    whole = kinds.where("n > 1").select("anchor", "digest", (-F.col("before")).alias("lo"), F.col("after").alias("hi"))
    hits = whole.unionByName(lined_up.mapInArrow(order, spans))
    crowds = pieces.where(F.col("m") > crowd)
    if crowds.take(1):
        single = materialize(
            crowds.dropDuplicates(["anchor", "digest"]).mapInArrow(
                windows, "anchor bigint, digest bigint, n bigint, lo int, window binary"
            ),
            "windows",
        )
        twice = single.groupBy("anchor", "lo", "window").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
        shared = single.drop("n").join(twice, ["anchor", "lo", "window"], "left_semi")
        hits = hits.unionByName(shared.select("anchor", "digest", "lo", (F.col("lo") + length).alias("hi")))
    start, end = (F.col("at") + F.col(c) for c in ("lo", "hi"))
    spread = places.join(hits.distinct(), ["anchor", "digest"]).select(
        "k1", "k2", (F.shiftleft(start.cast("bigint"), 32) + end).alias("range")
    )
    return keyed, spread.groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges"))


def collections(batches: Iterator[pa.RecordBatch], rows: int = ROUND_ROWS) -> Iterator[dict]:
    """Whole groups of segments, sorted by anchor and digest, some thousand segments at a time;
    a segment that comes twice is taken once."""
    names = ["anchor", "digest", "before", "bytes"]
    held: dict[str, list] = {c: [] for c in names}

    def packed(upto: int) -> dict:
        out = {c: np.array(held[c][:upto], np.int64) for c in names[:3]} | {"bytes": held["bytes"][:upto]}
        for c in names:
            del held[c][:upto]
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held["anchor"] and (held["anchor"][-1], held["digest"][-1]) == row[:2]:
                continue
            if len(held["anchor"]) >= rows and held["anchor"][-1] != row[0]:
                yield packed(len(held["anchor"]))
            for c, value in zip(names, row):
                held[c].append(value)
    if held["anchor"]:
        yield packed(len(held["anchor"]))


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, crowd: int = CROWD, with_kept: bool = False
) -> DataFrame:
    """Per row its id as ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (longest removed runs)
    and ``kept_sha256`` of the bytes that stay; with ``with_kept`` also those bytes, ``kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same text or another; strings are those of the input. Texts are UTF-8 bytes, so a
    removal may split a character. A null text is empty. Repeated rows repeat each other's
    text, so they lose it if it has ``length`` bytes. Other columns are not read.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    keyed, ranges = repeats(source, length, "text", crowd)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    schema += ", kept binary" if with_kept else ""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_kept else 5]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "_text"):
                out = []
                for text, found in zip(part.column("_text").to_pylist(), part.column("ranges").to_pylist()):
                    raw = text.encode()
                    kept, removed, spans, at, end = [], 0, 0, 0, -1
                    for packed in sorted(found or ()):
                        start, stop = packed >> 32, packed & 0xFFFFFFFF
                        if start > end:
                            kept.append(raw[at:start])
                            spans += 1
                        begin = max(start, at)
                        if stop > begin:
                            removed += stop - begin
                        at = end = max(stop, at)
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    out.append((len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest))
                columns = list(zip(*out))[: len(names) - 1] or [[] for _ in names[1:]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    joined = keyed.select("doc_id", "k1", "k2", "_text").join(ranges, ["k1", "k2"], "left")
    return joined.select("doc_id", "_text", "ranges").mapInArrow(remove, schema)
