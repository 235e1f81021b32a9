"""Quality rules: counts per text, and repetition inside a text by a suffix array of words.

The suffix array orders, within each text, the suffixes that begin with a window seen
elsewhere in the text; others share no repeat that is long enough to count and stay
out. It is built by doubling and works on a slice of texts at once. Neighbours in it give the longest common prefixes, and
those the spans of all maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t

WINDOW = 8
LONG_REPEAT = 16
MAX_COVERED = 0.25
MAX_LONGEST = 50
MAX_LONGEST_SHARE = 0.1
MAX_LONGEST_WORDS = 500
MIN_WORDS = 20
SYMBOLS = b"#*$%&|<>"

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "long_repeat_words", "longest_repeat"]


def _word_at(hashes: np.ndarray, owner: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of each suffix; 0, which sorts first, past the end of its text."""
    at = np.minimum(places + k, len(hashes) - 1)
    return np.where((places + k < len(hashes)) & (owner[at] == owner[places]), hashes[at], np.uint64(0))


def common_prefixes(hashes: np.ndarray, owner: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that begin a repeat of ``width`` words or more in their text, in
    suffix order, and for each the longest prefix (in words) that some other suffix of the
    same text shares with it."""
    n = len(hashes)
    windows = t.window_hashes(hashes, width)
    starts = np.flatnonzero(owner[: len(windows)] == owner[width - 1 :])
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    keys = t.mix(windows[starts] + owner[starts].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    places = starts[order][np.r_[False, same] | np.r_[same, False]]
    if not len(places):
        return places, np.zeros(0, np.int64)
    # Ranks are places in the order of first width words, then of twice as many, and so on;
    # suffixes that agree so far share one. What can follow a shared window is ranked too.
    follow = places + width
    follow = follow[follow < n]
    ranked = np.union1d(places, follow)
    window = np.stack([_word_at(hashes, owner, ranked, k) for k in range(width)])
    order = np.lexsort((*window[::-1], owner[ranked]))
    new = (window[:, order][:, 1:] != window[:, order][:, :-1]).any(0) | (np.diff(owner[ranked][order]) != 0)
    first = np.maximum.accumulate(np.where(np.r_[True, new], np.arange(len(ranked)), 0))
    rank = -np.arange(1, n + 1, dtype=np.int64)
    rank[ranked[order]] = first
    levels, length = [], width
    while True:
        levels.append(rank)
        after = np.minimum(places + length, n - 1)
        # Of the suffixes of one rank at most one can end here; it comes first.
        ends = (places + length >= n) | (owner[after] != owner[places])
        second = np.where(ends, -1, rank[after])
        order = np.lexsort((second, rank[places]))
        places, second = places[order], second[order]
        key, at = rank[places], np.arange(len(places))
        group = np.r_[True, key[1:] != key[:-1]]
        part = group | np.r_[True, second[1:] != second[:-1]]
        if part.all():
            break
        rank = rank.copy()
        rank[places] += np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        length *= 2
    left, right = places[:-1].copy(), places[1:].copy()
    lcp = np.zeros(len(left), np.int64)
    for k in reversed(range(len(levels))):
        rank, step = levels[k], width << k
        equal = (left < n) & (right < n)
        equal[equal] = rank[left[equal]] == rank[right[equal]]
        lcp += step * equal
        left, right = left + step * equal, right + step * equal
    going = lcp > 0
    for _ in range(width - 1):
        at = np.flatnonzero(going)
        a, b = _word_at(hashes, owner, places[:-1][at], lcp[at]), _word_at(hashes, owner, places[1:][at], lcp[at])
        going[at] = (a == b) & (a != 0)
        lcp += going
    return places, np.maximum(np.r_[0, lcp], np.r_[lcp, 0])


def _covered(n: int, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.bincount(places, minlength=n + 1) - np.bincount(places + lengths, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def measures(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COLUMNS for each text."""
    n_texts = len(offsets) - 1
    starts, ends = t.words(raw, offsets)
    owner = t.text_of(starts, offsets)
    per_text = partial(np.bincount, minlength=n_texts)
    inside = ~t._members(t.WORD_SPACE)[raw] & ((raw & 0xC0) != 0x80)
    out = {
        "n_words": per_text(owner),
        "word_chars": t.sums(inside, offsets),
        "n_symbols": t.sums(t._members(SYMBOLS)[raw], offsets),
    }
    line_starts, line_ends = t.runs(raw, offsets, raw != 10)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = t.text_of(line_starts, offsets)
    lines = np.stack([line_owner.astype(np.uint64), t.firm_hashes(raw, line_starts, line_ends)])
    order = np.lexsort(lines[::-1])
    again = (lines[:, order][:, 1:] == lines[:, order][:, :-1]).all(0)
    out["n_dup_lines"] = per_text(line_owner[order][1:][again])
    places, lengths = common_prefixes(t.firm_hashes(raw, starts, ends), owner)
    out["n_repeat_words"] = per_text(owner[_covered(len(starts), places, lengths)])
    long = lengths >= LONG_REPEAT
    out["long_repeat_words"] = per_text(owner[_covered(len(starts), places[long], lengths[long])])
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, owner[places], lengths)
    return out | {"longest_repeat": longest}


def quality_rules(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    max_longest_share: float = MAX_LONGEST_SHARE,
    max_longest_words: int = MAX_LONGEST_WORDS,
) -> DataFrame:
    """Per row its id as ``doc_id``, the counts of COLUMNS, ``base_failed`` and ``kept``.

    Base: fewer than 20 words, or over 30 % of the words in 8-word windows that the text has
    twice. Method: a text goes if maximal repeats of 16 words or more cover over
    ``max_covered`` of its words, or if its longest repeat has ``max_longest`` words or more
    and over ``max_longest_share`` of its words, or ``max_longest_words`` or more of whatever
    share. A null or empty text has all counts 0, fails
    the base and is not kept. Rows with equal ids are judged one by one; other columns are
    not read.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}", *(f"{c} bigint" for c in COLUMNS)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in t.slices(batch, "text"):
                found = measures(*t.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], ["doc_id", *COLUMNS]
                )

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    repetitive = (F.col("long_repeat_words") > max_covered * F.col("n_words")) | (
        (F.col("longest_repeat") >= max_longest) & (F.col("longest_repeat") > max_longest_share * F.col("n_words"))
    )
    repetitive = repetitive | (F.col("longest_repeat") >= max_longest_words)
    return (
        source.mapInArrow(measured, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(F.col("base_failed") | repetitive))
    )
