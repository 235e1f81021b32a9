"""SimHash fingerprints and near-duplicate classes by an anchor-point covering.

The anchors are a covering code: pairs of words of the binary Golay code [23, 12, 7], laid
over two blocks of 23 fingerprint bits. The code is perfect with covering radius 3, so a
block has one nearest code word, and a fingerprint one home anchor. Two fingerprints that
differ in at most t bits meet at the home of either: its radius is at most 3 per block, so
the other one is within 3 + t1 and 3 + t2 of it with t1 + t2 <= t, and is sent there.
Fingerprints of a home are compared with those sent to it over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import fresh
from .components import components
from .text import slices

SEED = 42
SHINGLE = 3
THRESHOLD = 2
BITS, RADIUS, GENERATOR = 23, 3, 0xC75  # the Golay code: length, covering radius, polynomial
BLOCKS = 2
# A home with more fingerprints than this is compared through the finest covering instead
# (every string is an anchor): exact as well, and no group has more than 65 members.
DENSE_HOME = 64


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    line = b" ".join(words)
    starts = [0, *ends[:-1]]
    width = min(SHINGLE, len(words))
    hashed = xxhash.xxh64_intdigest
    hashes = [hashed(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): a hash of the text's bytes, and its fingerprint as a signed number."""
    text = F.col(f"`{text_column}`")
    source = documents.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [fingerprint(text) for text in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), part.column("text_hash"), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(hashed, f"doc_id {kind}, text_hash bigint, fp bigint")


def _remainder(block: int) -> int:
    for shift in range(BITS - 1, BITS - 13, -1):
        if block >> shift & 1:
            block ^= GENERATOR << (shift - 11)
    return block


@lru_cache(4)
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high bits of a block, and for each syndrome the patterns of
    at most ``reach`` bits that lead from a block to a code word: all in one array, in the
    order of syndromes, with where each syndrome begins."""
    one = [_remainder(1 << k) for k in range(BITS)]

    def span(units: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for unit in units:
            table = np.r_[table, table ^ unit]
        return table

    found = [
        (int(np.bitwise_xor.reduce([one[k] for k in bits] or [0])), sum(1 << k for k in bits))
        for weight in range(reach + 1)
        for bits in combinations(range(BITS), weight)
    ]
    syndromes, patterns = np.array(found, dtype=np.int64).T
    order = np.argsort(syndromes, kind="stable")
    starts = np.searchsorted(syndromes[order], np.arange((1 << 11) + 1))
    return span(one[:12]), span(one[12:]), patterns[order], starts


def _words_near(block: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block its number, each code word within ``reach`` bits, and their distance."""
    low, high, patterns, starts = _patterns(reach)
    syndrome = low[block & 0xFFF] ^ high[block >> 12]
    count = starts[syndrome + 1] - starts[syndrome]
    row = np.repeat(np.arange(len(block)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + starts[syndrome][row]
    return row, block[row] ^ patterns[at], np.bitwise_count(patterns[at])


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint its number, its anchors, and whether the anchor is its home."""
    row, anchor, spent = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64)
    home = np.ones(len(fp), bool)
    for b in range(BLOCKS):
        block = (fp >> (BITS * b)) & ((1 << BITS) - 1)
        of, word, distance = _words_near(block, RADIUS + threshold)
        first = np.searchsorted(of, np.arange(len(fp) + 1))
        count = (first[1:] - first[:-1])[row]
        pick = np.repeat(np.arange(len(row)), count)
        at = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count) + first[row[pick]]
        over = np.maximum(distance[at].astype(np.int64) - RADIUS, 0)
        keep = spent[pick] + over <= threshold
        pick, at, over = pick[keep], at[keep], over[keep]
        anchor = (anchor[pick] << BITS) | word[at]
        home = home[pick] & (distance[at] <= RADIUS)
        spent, row = spent[pick] + over, row[pick]
    return row, anchor, home


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that join up all fingerprints ``fp`` within ``threshold`` bits of each other.

    Every such pair is given, but for pairs at a dense home with a threshold of two: there each
    fingerprint is linked to the smallest of those it shares a neighbour with, which joins
    the same ones up.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the threshold is 0, 1 or 2 bits")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                fp = batch.column("fp").slice(start, 2048).to_numpy()
                row, anchor, home = anchors(fp, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"]
                )

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.r_[0, np.int64(1) << np.arange(64, dtype=np.int64)]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                fp = batch.column("fp").slice(start, 2048).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, 65))], ["centre", "fp"]
                )

    # Fingerprints are few bytes, what becomes of them is many: as many tasks as the join has.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = distinct.repartition(tasks, "fp").mapInArrow(placed, "anchor bigint, fp bigint, home boolean")
    homes = materialize(sent.where("home").select("anchor", F.col("fp").alias("at_home")), "homes")
    dense = homes.groupBy("anchor").count().where(F.col("count") > DENSE_HOME).select("anchor")
    # A dense home has one mark instead of its fingerprints: what is sent there is a crowd.
    marks = homes.join(dense, "anchor", "left_anti").union(dense.withColumn("at_home", F.lit(None).cast("bigint")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("at_home"))) <= threshold
    met = materialize(
        sent.select("anchor", "fp")
        .join(marks.hint("shuffle_hash"), "anchor")
        .where(F.col("at_home").isNull() | ((F.col("fp") < F.col("at_home")) & near))
        .select("fp", "at_home"),
        "met",
    )
    pairs = met.where("at_home IS NOT NULL").select(F.col("fp").alias("a"), F.col("at_home").alias("b"))
    crowd = met.where("at_home IS NULL").select("fp")
    if threshold == 0 or not crowd.take(1):  # different fingerprints differ in a bit
        return pairs
    crowd = crowd.distinct()
    around = materialize(crowd.mapInArrow(balls, "centre bigint, fp bigint"), "balls")
    if threshold == 1:  # the neighbours of a fingerprint that are fingerprints themselves
        others = crowd.select(F.col("fp").alias("centre"))
        close = around.where(F.col("fp") < F.col("centre")).join(others, "centre")
        return pairs.union(close.select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    # Neighbours of one string differ in at most two bits; two strings that differ in at
    # most two bits share a neighbour.
    smallest = around.groupBy("centre").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = around.join(smallest, "centre").where(F.col("a") < F.col("fp"))
    return pairs.union(stars.select("a", F.col("fp").alias("b")).distinct())


def _rooted(marked: DataFrame, first: Column, threshold: int) -> DataFrame:
    """(fp, first, root): each fingerprint with the smallest ``first`` of its rows, and its component."""
    classes = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "classes")
    linked = components(links(classes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    return classes.join(linked, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """Per row its id as ``doc_id``, its ``fp`` and ``component_id``: the smallest id reached
    over links of at most ``threshold`` differing bits, its own included.

    Texts without a word (null, empty, white space) have fingerprint 0 and link like any
    other. Copies share a fingerprint and are linked once, as a class. A null id is never a
    component's name, unless all its ids are null. Repeated rows come back as they are; other
    columns are not read.
    """
    marked = materialize(fingerprints(documents, id_column, text_column), "fingerprints")
    named = _rooted(marked, F.col("doc_id"), threshold)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, found: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Of each ``root`` in ``found`` the row whose ``first`` is the smallest (nameless, doc_id, text_hash)."""
    name, own_id, own_hash = fresh(documents, "text_hash", "kept_id", "kept_hash")
    kept = found.groupBy("root").agg(F.min("first").alias("kept")).select(
        F.col("kept.doc_id").alias(own_id), F.col("kept.text_hash").alias(own_hash)
    )
    keyed = documents.withColumn(name, F.xxhash64(F.col(f"`{text_column}`")))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(own_id)) & (F.col(name) == F.col(own_hash))
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_column, name]).drop(name)


def keep_one(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """One row of each group of near-duplicates stays, with all its columns: that with the
    smallest id (null last), of those the one whose text has the smallest hash."""
    marked = materialize(fingerprints(documents, id_column, text_column), "fingerprints")
    # The first of a group is the first of its fingerprints' firsts: documents are not joined to their groups.
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    return keep_first(documents, _rooted(marked, first, threshold), id_column, text_column)
