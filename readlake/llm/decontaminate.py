"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared where they share a seed, a run of five words.
Tiles are then marked longest first: each round takes the longest match of words that are
still unmarked on both sides, found from running Karp-Rabin hashes. The share of an item's
words that tiles cover does not depend on their order, so moved passages count as well.

Benchmarks are taken in blocks whose size is bounded; each block is one pass over the
documents, and the passes' results are put together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import text as t
from .columns import fresh

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES = 32 << 20
_FILTER_BITS = 24


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words here (ASCII letters and digits, and all of other scripts),
    and the same bytes in lower case."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    inside[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, punctuation and case left out, and the number of
    each word's text."""
    raw, offsets = t.utf8(column)
    inside, lower = _letters()
    starts, ends = t.runs(raw, offsets, inside[raw])
    return t.firm_hashes(lower[raw], starts, ends), t.text_of(starts, offsets)


class Block:
    """Benchmark items with an index of their seeds."""

    def __init__(self, item_ids: list, texts: list[str | None], min_match: int = MIN_MATCH):
        self.min_match, self.item_ids = min_match, item_ids
        self.words, owner = word_hashes(pa.array(texts, pa.string()))
        self.starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        seeds = t.window_hashes(self.words, min_match)
        at = np.flatnonzero(owner[: len(seeds)] == owner[min_match - 1 :])
        order = np.argsort(seeds[at], kind="stable")
        self.at, self.item = at[order], owner[at[order]]
        self.seeds = seeds[self.at]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def shared(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in words, in self.words) of equal seeds."""
        seeds = t.window_hashes(words, self.min_match)
        place = np.flatnonzero(self.filter[seeds >> np.uint64(64 - _FILTER_BITS)])
        place = place[owner[place] == owner[place + self.min_match - 1]]
        low = np.searchsorted(self.seeds, seeds[place], "left")
        count = np.searchsorted(self.seeds, seeds[place], "right") - low
        pick = np.repeat(np.arange(len(place)), count)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(count) - count, count)
        return place[pick], self.at[low[pick] + nth]

    def coverage(self, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, covered share of the item's words, longest tile) for all that share a seed."""
        place, at = self.shared(words, owner)
        if not len(place):
            return
        item = np.searchsorted(self.starts, at, "right") - 1
        order = np.lexsort((place, place - at, item, owner[place]))
        place, at, item, text = place[order], at[order], item[order], owner[place[order]]
        # Neighbouring seeds on one diagonal are one maximal match.
        new = np.r_[True, (np.diff(place) != 1) | (np.diff(at) != 1) | (np.diff(item) != 0) | (np.diff(text) != 0)]
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(place)]) + self.min_match - 1
        pair = np.flatnonzero(np.r_[True, (np.diff(item[first]) != 0) | (np.diff(text[first]) != 0)])
        for a, b in zip(pair, [*pair[1:], len(first)]):
            k, i = first[a], int(item[first[a]])
            matches = zip(length[a:b].tolist(), place[first[a:b]].tolist(), at[first[a:b]].tolist())
            covered, longest = tile(list(matches), self.min_match)
            yield int(text[k]), i, covered / int(self.starts[i + 1] - self.starts[i]), longest


def tile(matches: list[tuple[int, int, int]], least: int) -> tuple[int, int]:
    """Words covered by greedy tiles, and the longest tile's length, from maximal matches
    (length, place in the text, place in the item)."""
    if len(matches) == 1:
        return matches[0][0], matches[0][0]
    queue = [(-length, j, i) for length, j, i in matches]
    heapq.heapify(queue)
    in_text: set[int] = set()
    in_item: set[int] = set()
    longest = 0
    while queue:
        length, j, i = heapq.heappop(queue)
        free = [j + k not in in_text and i + k not in in_item for k in range(-length)]
        if all(free):
            longest = longest or -length
            in_text.update(range(j, j - length))
            in_item.update(range(i, i - length))
            continue
        start = None  # what is left of the match waits for its turn
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= least:
                    heapq.heappush(queue, (start - k, j + start, i + start))
                start = None
    return len(in_item), longest


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items, some megabytes at a time."""
    items = benchmark.select(F.col(id_column).alias("item_id"), F.col(text_column).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes) or 1
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.orderBy("item_id", "text").collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def _judge(items: tuple[list, list], benchmark_id: str, coverage: float, min_match: int, spark: SparkSession) -> Callable:
    """A column function: what the items of one block make of a text."""
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf(f"struct<item_ids:array<{benchmark_id}>,best_coverage:double,longest_tile:bigint>")
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(*shared.value, min_match)
        kind = pa.array(block.item_ids).type if block.item_ids else pa.null()
        for batch in texts:
            parts = []
            for part in t.slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                found: list[list] = [[] for _ in range(part.num_rows)]
                best, longest = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                for text, item, share, length in block.coverage(*word_hashes(part.column("text"))):
                    best[text] = max(best[text], share)
                    longest[text] = max(longest[text], length)
                    if share >= coverage:
                        found[text].append(block.item_ids[item])
                lists = pa.array(found, pa.list_(kind))
                parts.append(pa.StructArray.from_arrays([lists, pa.array(best), pa.array(longest)], _FIELDS))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.null())

    return judge.asNondeterministic()  # or a filter on its result would run it twice


_FIELDS = ["item_ids", "best_coverage", "longest_tile"]


def with_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    name: str,
    coverage: float = COVERAGE,
    min_match: int = MIN_MATCH,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with one more column, a struct: ``item_ids`` (of the items that a text's
    tiles cover to ``coverage`` or more, in order), ``best_coverage`` (the largest share of an
    item that they cover) and ``longest_tile`` in words.

    Null and empty texts, items of fewer than ``min_match`` words, and an empty benchmark give
    an empty list and zeros. Repeated rows are judged one by one; items with equal ids count
    one by one.
    """
    spark = documents.sparkSession
    kind = benchmark.schema[item_column].dataType.simpleString()
    judges = [
        _judge(items, kind, coverage, min_match, spark)
        for items in _blocks(benchmark, item_column, item_text_column, block_bytes)
    ]
    text = F.col(f"`{text_column}`")
    if len(judges) == 1:
        judged = documents.withColumn(name, judges[0](text))
    else:
        # One pass per block over the different texts; documents then look theirs up.
        (by,) = fresh(documents, "text_key")
        key = F.sha2(F.coalesce(text, F.lit("")), 256)
        texts = materialize(documents.select(key.alias(by), text.alias("text")).dropDuplicates([by]), "texts")
        passes = [texts.select(by, judge(F.col("text")).alias("found")) for judge in judges]
        merged = (
            reduce(DataFrame.unionByName, passes)
            .groupBy(by)
            .agg(
                F.struct(
                    F.flatten(F.collect_list("found.item_ids")).alias("item_ids"),
                    F.max("found.best_coverage").alias("best_coverage"),
                    F.max("found.longest_tile").alias("longest_tile"),
                ).alias(name)
            )
        )
        judged = documents.withColumn(by, key).join(merged, by).drop(by)
    return judged.withColumn(name, F.col(name).withField("item_ids", F.array_sort(F.col(name)["item_ids"])))


def contamination(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """Per document its id as ``doc_id``, ``contaminated``, ``n_items``, and the fields of
    ``with_contamination``, whose options it takes; other columns are not read."""
    text_column = options.pop("text_column", "text")
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = with_contamination(source, benchmark, "found", **options).select("doc_id", "found")
    n_items = F.size("found.item_ids").cast("bigint").alias("n_items")
    return found.select("doc_id", (n_items > 0).alias("contaminated"), n_items, "found.*")


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item; all their columns stay."""
    (name,) = fresh(documents, "found")
    judged = with_contamination(documents, benchmark, name, **options)
    return judged.where(F.size(F.col(name)["item_ids"]) == 0).drop(name)
