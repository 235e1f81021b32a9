"""Phrases whose words stand together more often than their parts would, by stripes.

Texts are cut into pieces at ``.,;:!?`` and line ends, pieces at spaces and tabs into words, A-Z
lower-cased. A stripe belongs to one first word of one language and counts what comes next: the
next word, and the next two. Tasks build stripes for some hundred thousand words at a time;
stripes of the same word meet sorted, and are merged entry by entry. The merged stripes hold
everything: an entry of one word is a phrase of two and the total of the longer prefix, an entry
of two words extends it, and the largest extensions say which phrases are only parts of others.

A word so frequent that its stripe would outgrow a task has it dealt out in portions, by the
hash of the entry. Those words are found by counting all words first; as each of them is a
stated share of all words, there are at most ``HEAVY_PER_TASK`` of them per shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from ..session import materialize
from .text import _members, mix, range_hashes, runs, slices, text_of, utf8

UNKNOWN = "und"
MIN_COUNT = 10
TOP = 2000
COVERED_PERCENT = 50
SLICE = 2 << 20  # bytes of text that are counted together
BLOCK_WORDS = 1 << 20  # a longer text is counted in overlapping blocks
CODE_BITS = 21
ROW_ENTRIES = 256  # a longer stripe travels in several rows
HEAVY_PER_TASK = 4
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _source(documents: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_column}`").cast("string"), F.lit(UNKNOWN))
    return documents.select(lang.alias("lang"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))


class _Words:
    """The words of some texts: each one's code, hash and whether the next one is in its piece.
    A code stands for a language and a word; codes begin at 1."""

    def __init__(self, part: pa.RecordBatch):
        raw, offsets = utf8(part.column("text"))
        raw = _LOWER[raw]
        inside = ~_members(PIECE_ENDS + BLANKS)[raw]
        starts, ends = runs(raw, offsets, inside)
        self.n = len(starts)
        if not self.n:
            return
        bounds = np.zeros(self.n + 1, np.int32)
        np.cumsum(ends - starts, out=bounds[1:])
        packed = pa.Array.from_buffers(
            pa.binary(), self.n, [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside].tobytes())]
        ).dictionary_encode()
        langs = part.column("lang").dictionary_encode()
        text = text_of(starts, offsets)
        lang = langs.indices.to_numpy()[text].astype(np.int64)
        word = packed.indices.to_numpy().astype(np.int64)
        pairs, first, code = np.unique(lang << 32 | word, return_index=True, return_inverse=True)
        self.codes = code.astype(np.int64) + 1
        self.words = packed.dictionary.cast(pa.string()).take(pa.array(pairs & 0xFFFFFFFF))
        self.langs = langs.dictionary.take(pa.array(pairs >> 32))
        self.hashes = np.r_[np.zeros(1, np.uint64), range_hashes(raw, starts[first], ends[first])]
        # Two words are in one piece if nothing that ends a piece stands between them.
        marks = np.cumsum(_members(PIECE_ENDS)[raw], dtype=np.int32)
        self.joined = np.zeros(self.n, bool)
        self.joined[:-1] = (marks[starts[1:]] == marks[ends[:-1] - 1]) & (text[1:] == text[:-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            found = _Words(part)
            if found.n:
                yield found


def word_counts(documents: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, word, n): how often each language has each word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = np.bincount(block.codes)[1:]
            yield pa.RecordBatch.from_arrays([block.langs, block.words, pa.array(n)], ["lang", "word", "n"])

    parts = _source(documents, text_column, lang_column).mapInArrow(counted, "lang string, word string, n bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _stripes(block: _Words, begin: int, portions: np.ndarray) -> pa.RecordBatch:
    """The stripes of the words from ``begin`` on, a block of them."""
    end = min(begin + BLOCK_WORDS, block.n)
    codes, joined = block.codes[begin : end + 2], block.joined[begin : end + 2]
    if block.n > BLOCK_WORDS:  # codes of the block alone, so that they stay small
        used, codes = np.unique(codes, return_inverse=True)
        codes = codes + 1
    else:
        used = np.arange(1, len(block.words) + 1)
    size = end - begin
    nothing = np.zeros(2, np.int64)
    one, two = np.r_[codes[1:], nothing][:size], np.r_[codes[2:], nothing][:size]
    pair = joined[:size]
    triple = pair & np.r_[joined[1:], np.zeros(2, bool)][:size]
    prefix = codes[:size] << 2 * CODE_BITS | one << CODE_BITS
    entries, n = np.unique(np.r_[prefix[pair], (prefix | two)[triple]], return_counts=True)
    mask = (1 << CODE_BITS) - 1
    used = np.r_[0, used]
    first, second, third = used[entries >> 2 * CODE_BITS], used[entries >> CODE_BITS & mask], used[entries & mask]
    parts = portions[first]
    portion = np.zeros(len(entries), np.int64)
    split = np.flatnonzero(parts > 1)
    if len(split):
        hashed = mix(block.hashes[second[split]] * np.uint64(3) + block.hashes[third[split]])
        portion[split] = (hashed % parts[split].astype(np.uint64)).astype(np.int64)
        order = np.argsort(first << 32 | portion, kind="stable")
        first, second, third, n, portion = first[order], second[order], third[order], n[order], portion[order]
    row = first << 32 | portion
    place = np.arange(len(row))
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    inside = place - np.repeat(begins, np.diff(np.r_[begins, len(row)]))
    begins = np.flatnonzero(inside % ROW_ENTRIES == 0)
    bounds = pa.array(np.r_[begins, len(row)].astype(np.int32))
    longer = np.flatnonzero(third)
    text = block.words.take(pa.array(second - 1))
    if len(longer):
        both = pc.binary_join_element_wise(text.take(pa.array(longer)), block.words.take(pa.array(third[longer] - 1)), " ")
        text = pc.replace_with_mask(text, pa.array(third > 0), both)
    return pa.RecordBatch.from_arrays(
        [
            block.langs.take(pa.array(first[begins] - 1)),
            block.words.take(pa.array(first[begins] - 1)),
            pa.array(portion[begins].astype(np.int32)),
            pc.binary_join(pa.ListArray.from_arrays(bounds, text), "\n"),
            pa.ListArray.from_arrays(bounds, pa.array(n.astype(np.int64))),
        ],
        ["lang", "first", "portion", "next", "n"],
    )


def stripes(documents: DataFrame, heavy: dict[tuple[str, str], int], text_column: str, lang_column: str) -> DataFrame:
    """(lang, first, portion, next, n): stripes of some texts each. ``next`` has an entry a line,
    ``n`` their counts. ``heavy`` says in how many portions a word's stripe is dealt out."""
    names = pa.array(["\n".join(key) for key in heavy], pa.string())
    parts = np.array([1, *heavy.values()], np.int64)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            own = pc.binary_join_element_wise(block.langs, block.words, "\n")
            at = pc.fill_null(pc.index_in(own, names), -1).to_numpy().astype(np.int64)
            portions = np.r_[1, parts[at + 1]]
            for begin in range(0, block.n, BLOCK_WORDS):
                yield _stripes(block, begin, portions)

    schema = "lang string, first string, portion int, next string, n array<bigint>"
    return _source(documents, text_column, lang_column).mapInArrow(built, schema)


def merged_stripes(parts: DataFrame, min_count: int) -> DataFrame:
    """(lang, first, next, n): the entries of the merged stripes that count at least so much.

    Stripes come sorted; one stripe's entries are held at a time, with what a batch has.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        open_next, open_n = pa.array([], pa.string()), np.zeros(0, np.int64)

        def entries(langs: pa.Array, firsts: pa.Array, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([langs, firsts, texts, pa.array(n)], ["lang", "first", "next", "n"])

        def closed() -> Iterator[pa.RecordBatch]:
            enough = np.flatnonzero(open_n >= min_count)
            if open_key is not None and len(enough):
                same = [pa.array([open_key[k]] * len(enough), pa.string()) for k in (0, 1)]
                yield entries(*same, open_next.take(pa.array(enough)), open_n[enough])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, first, portion = (batch.column(k) for k in ("lang", "first", "portion"))
            begins = np.zeros(batch.num_rows, bool)
            for column in (lang, first, portion):
                begins[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            key = (lang[0].as_py(), first[0].as_py(), portion[0].as_py())
            begins[0] = key != open_key
            if begins[0]:
                yield from closed()
                open_next, open_n = pa.array([], pa.string()), np.zeros(0, np.int64)
            # The stripe that is still open is group 0 of this batch.
            group = np.cumsum(begins) - int(begins[0])
            lists = pc.split_pattern(batch.column("next"), "\n")
            texts = pa.concat_arrays([open_next, lists.flatten()])
            lengths = pc.list_value_length(lists).to_numpy()
            of = np.r_[np.zeros(len(open_next), np.int64), np.repeat(group, lengths)]
            n = np.r_[open_n, batch.column("n").flatten().to_numpy()]
            coded = texts.dictionary_encode()
            keys = of * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(keys, kind="stable")
            heads = np.flatnonzero(np.diff(keys[order], prepend=-1))
            total, head = np.add.reduceat(n[order], heads), order[heads]
            last = int(group[-1])
            done = (of[head] < last) & (total >= min_count)
            if done.any():
                row = np.searchsorted(group, of[head[done]])
                rows = pa.array(row)
                yield entries(lang.take(rows), first.take(rows), texts.take(pa.array(head[done])), total[done])
            rest = of[head] == last
            open_next, open_n = texts.take(pa.array(head[rest])), total[rest]
            open_key = (lang[-1].as_py(), first[-1].as_py(), portion[-1].as_py())
        yield from closed()

    keys = ["lang", "first", "portion"]
    together = parts.repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(merged, "lang string, first string, next string, n bigint")


def _portions(words: DataFrame) -> dict[tuple[str, str], int]:
    """In how many portions the stripes of the most frequent words are dealt out. Each has at
    least its share of all words, so the list is bounded by the shuffle partitions."""
    tasks = HEAVY_PER_TASK * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = words.where(F.col("n") * tasks > total).collect()
    return {(r["lang"], r["word"]): -(-r["n"] * tasks // total) for r in heavy}


def _part(first: str, size: Column | int) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    documents: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    covered_percent: int = COVERED_PERCENT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each
    language (null: ``und``).

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` the words of the
    language; ``score`` is floor(1000000 * a * a / (l * r)), exact while counts have up to 14
    digits. A phrase that stands in a longer one for ``covered_percent`` of its occurrences is left
    out. Null and empty texts have no words; an empty table has no phrases; repeated rows count as
    often as they come; ties are ordered by count, then by phrase. Other columns are not read.
    """
    words = materialize(word_counts(documents, text_column, lang_column), "words")
    parts = stripes(documents, _portions(words), text_column, lang_column)
    merged = materialize(merged_stripes(parts, min_count), "stripes")
    found = merged.select(
        "lang", F.concat_ws(" ", "first", "next").alias("phrase"), F.col("n").alias("a")
    ).withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    # Every part of a phrase occurs as often as the phrase at least.
    known = words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("part"), "n")
    known = known.union(found.where(size == 2).select("lang", "phrase", "a"))

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    for name, part in (("l", _part(1, F.col("k"))), ("r", F.array_join(F.slice("words", F.col("k") + 1, size), " "))):
        counted = known.select(F.struct("lang", "part").alias("key"), F.col("n").alias(name))
        cuts = spread_join(cuts.withColumn("key", F.struct("lang", part.alias("part"))), counted, "key", "phrase", "inner")
        cuts = cuts.drop("key")
    wide = "CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0))"
    score = F.expr(f"({wide}) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )

    inner = F.array(_part(1, size - 1), _part(2, size - 1))
    longer = found.where(size == 3).select("lang", F.explode(inner).alias("phrase"), "a")
    largest = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(largest, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent)
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the best of each share first, then the best of those.
    shares = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    few = flat.withColumn("share", share).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))
    ).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, body FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS body FROM documents)),
split AS (
  SELECT piece, lang, unnest(parts) AS word, unnest(range(len(parts))) AS i
  FROM (SELECT piece, lang, regexp_split_to_array(body, '[\x20\x09]+') AS parts FROM pieces)),
places AS (
  SELECT lang, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third
  FROM split WHERE word <> '' WINDOW w AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS size, word AS phrase, count(*) AS f FROM places GROUP BY ALL
  UNION ALL
  SELECT lang, 2, word || ' ' || second, count(*) FROM places WHERE second IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, 3, word || ' ' || second || ' ' || third, count(*) FROM places WHERE third IS NOT NULL GROUP BY ALL),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, lang || chr(9) || array_to_string(w[: k], ' ') AS lhs,
    lang || chr(9) || array_to_string(w[k + 1 :], ' ') AS rhs
  FROM candidates, (VALUES (1), (2)) cut(k) WHERE k < size),
parts AS (SELECT lang || chr(9) || phrase AS part, f FROM grams WHERE f >= 10),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN parts x ON x.part = lhs JOIN parts y ON y.part = rhs),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, unnest([array_to_string(w[: size - 1], ' '), array_to_string(w[2 :], ' ')]) AS phrase, a
  FROM candidates WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN longer b ON b.lang = w.lang AND b.phrase = w.phrase
  WHERE b.a IS NULL OR 100 * b.a < 50 * w.a),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals t ON t.lang = ranked.lang WHERE rank <= 2000
"""
