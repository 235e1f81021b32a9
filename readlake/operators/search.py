"""Full-text search: query forms that compose, run over the postings.

A query is built from functions, not parsed from text::

    both(term("paper"), either(phrase("deep sea"), term("oce", prefix=True)))

However many terms it has, it costs one scan of the postings of those terms and
one shuffle by article id: the hits of every term of an article meet in one row,
and the query becomes a boolean and an arithmetic expression over that row.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize_words, tokens
from ..session import materialize, scratch_path
from .index import BUCKET_PREFIX, FIELDS, Index, block_of, bucket_of, field_start, may_hold, positions_in

# BM25 and NEAR as full-text indexes commonly define them.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
NEAR_DISTANCE = 10

# A search with a limit up to this looks its articles up by id.
LOOKED_UP = 1000

# Of a query with more blocks, this many are scored first to find out what the others must reach.
FIRST_BLOCKS = 32

# An archive of up to this many articles is one block: telling apart what to read would cost more.
ONE_BLOCK = 1_000_000

# Scores that agree to this many digits are a tie.
TIE_DIGITS = 9


# -- query forms -----------------------------------------------------------


class Query:
    """Base of all query forms."""


@dataclass(frozen=True)
class Phrase(Query):
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    fields: tuple[str, ...] = FIELDS


@dataclass(frozen=True)
class Near(Query):
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Both(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Either(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Without(Query):
    kept: Query
    dropped: Query


NOTHING = Phrase(())


def phrase(text: str, prefix: bool = False, first: bool = False) -> Query:
    """Consecutive tokens in one column; with ``prefix`` the last one may be longer,
    with ``first`` they must open the column."""
    return Phrase(tuple(tokenize_words(text)), prefix, first)


def term(text: str, prefix: bool = False, first: bool = False) -> Query:
    """One word; a word the tokenizer cuts apart is a phrase."""
    return phrase(text, prefix, first)


def near(*texts: str, distance: int = NEAR_DISTANCE) -> Query:
    """Phrases of one column with at most ``distance`` tokens between them."""
    if distance < 0:
        raise ValueError("the distance of near() cannot be negative")
    phrases = tuple(p for p in map(phrase, texts) if p.words)
    if not phrases:
        return NOTHING
    return phrases[0] if len(phrases) == 1 else Near(phrases, distance)


def _is_empty(query: Query) -> bool:
    return isinstance(query, Phrase) and not query.words


def _checked(parts: tuple[Query, ...]) -> list[Query]:
    for part in parts:
        if not isinstance(part, Query):
            raise ValueError(f"not a query: {part!r}")
    return list(parts)


def _joined(form: type, parts: list[Query]) -> Query:
    if not parts:
        return NOTHING
    return parts[0] if len(parts) == 1 else form(tuple(parts))


def both(*parts: Query) -> Query:
    """AND: with an empty operand nothing can match."""
    if any(_is_empty(part) for part in _checked(parts)):
        return NOTHING
    return _joined(Both, list(parts))


def adjacent(*parts: Query) -> Query:
    """The AND that writing operands side by side implies: empty ones are ignored."""
    return _joined(Both, [part for part in _checked(parts) if not _is_empty(part)])


def either(*parts: Query) -> Query:
    """OR."""
    return _joined(Either, [part for part in _checked(parts) if not _is_empty(part)])


def without(kept: Query, dropped: Query | None = None) -> Query:
    """NOT: it needs something to take away from."""
    if dropped is None:
        raise ValueError("NOT needs two operands")
    _checked((kept, dropped))
    return kept if _is_empty(kept) or _is_empty(dropped) else Without(kept, dropped)


def within(query: Query, *names: str, exclude: bool = False) -> Query:
    """Only hits in the named columns (or, with ``exclude``, in all others)."""
    unknown = sorted(set(names) - set(FIELDS))
    if unknown or not names:
        raise ValueError(f"unknown column {unknown}; there are {', '.join(FIELDS)}")
    allowed = {f for f in FIELDS if (f in names) != exclude}

    def narrow(node: Query) -> Query:
        if isinstance(node, Phrase):
            return replace(node, fields=tuple(f for f in node.fields if f in allowed))
        if isinstance(node, Near):
            return replace(node, phrases=tuple(narrow(p) for p in node.phrases))
        if isinstance(node, Without):
            return Without(narrow(node.kept), narrow(node.dropped))
        return replace(node, parts=tuple(narrow(p) for p in node.parts))

    return narrow(query)


# -- reading the postings ----------------------------------------------------


@dataclass(frozen=True)
class _Slot:
    """A word of the query, whole or as a prefix."""

    word: str
    prefix: bool

    def matches(self) -> Column:
        return F.col("term").startswith(self.word) if self.prefix else F.col("term") == self.word


def _phrases(query: Query) -> list[Phrase]:
    if isinstance(query, Phrase):
        return [query]
    if isinstance(query, Near):
        return list(query.phrases)
    if isinstance(query, Without):
        return _phrases(query.kept) + _phrases(query.dropped)
    return [p for part in query.parts for p in _phrases(part)]


def _slots(p: Phrase) -> list[_Slot]:
    last = len(p.words) - 1
    return [_Slot(word, p.prefix and k == last) for k, word in enumerate(p.words)]


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _whole_words(query: Query, known: dict[str, list[str] | None]) -> Query:
    """The query with every prefix that only one word has as that word, whose number of articles
    the index keeps and whose postings are one row per article."""
    if isinstance(query, Phrase):
        only = known.get(query.words[-1]) if query.prefix and query.words else None
        if only is None or len(only) != 1:
            return query
        return replace(query, words=(*query.words[:-1], only[0]), prefix=False)
    if isinstance(query, Near):
        return replace(query, phrases=tuple(_whole_words(p, known) for p in query.phrases))
    if isinstance(query, Without):
        return Without(_whole_words(query.kept, known), _whole_words(query.dropped, known))
    return replace(query, parts=tuple(_whole_words(p, known) for p in query.parts))


def postings_of(
    index: Index, slots: Iterable[tuple[str, bool]], known: dict[str, list[str] | None] | None = None
) -> DataFrame:
    """The postings of some words: partitions pruned by bucket, row groups by term.

    ``known`` lists the words of prefixes: then nothing but them is read, and nothing at all
    for a prefix without any.
    """
    slots = [_Slot(*slot) for slot in slots]
    wanted, buckets = [], []
    for slot in slots:
        words = (known or {}).get(slot.word) if slot.prefix else [slot.word]
        if words is None:
            wanted.append(slot.matches())
            buckets.append(may_hold(slot.word, True))
        elif words:
            wanted.append(F.col("term").isin(words))
            buckets += [may_hold(start, False) for start in sorted({w[:BUCKET_PREFIX] for w in words})]
    if not wanted:
        return index.postings.where(F.lit(False))
    return index.postings.where(_any(wanted)).where(_any(buckets))


# -- hits of a phrase in one article -------------------------------------------


# Up to this window what positions cover is listed; for a wider one they are swept in order.
LISTED_WINDOW = 64


def _covered(positions: Column, before: int, after: int) -> Column:
    return F.flatten(F.transform(positions, lambda p: F.sequence(p - before, p + after)))


def _follows_any(starts: Column, ends: Column, window: int) -> Column:
    """The ends that have a start at most ``window`` before them."""
    return F.array_intersect(ends, _covered(starts, 0, window))


def _precedes_any(starts: Column, ends: Column, window: int) -> Column:
    """The starts that have an end at most ``window`` after them."""
    return F.array_intersect(starts, _covered(ends, window, 0))


def _near_hits(members: list[Column], lengths: list[int], distance: int) -> list[Column]:
    """Of each member's positions, those that lie in a group within the distance.

    A group ends at some member's start e; every member must then start in
    [e - length - distance, e].
    """
    windows = [length + distance for length in lengths]
    ends = F.array_distinct(F.flatten(F.array(*members)))
    for starts, window in zip(members, windows, strict=True):
        ends = _follows_any(starts, ends, window)
    return [_precedes_any(starts, ends, window) for starts, window in zip(members, windows, strict=True)]


def _swept(found: DataFrame, first: int, group: Near) -> DataFrame:
    """(id, f..): the same counts for any distance, by two sweeps over an article's positions.

    Going up, the last start of each member is kept: a position ends a group if all of them are
    near enough. Going down, the last such end is kept: a start counts if that is near enough.
    A sweep is linear in the positions, and long articles are sorted outside memory.
    """
    numbers = range(first, first + len(group.phrases))
    windows = {n: len(p.words) + group.distance for n, p in zip(numbers, group.phrases)}
    all_there = reduce(lambda a, b: a & b, [F.size(f"p{n}") > 0 for n in numbers])

    def marked(n: int) -> Column:
        return F.transform(f"p{n}", lambda pos: F.struct(F.lit(n).alias("member"), pos.alias("pos")))

    starts = [marked(n) for n in numbers]
    rows = found.where(all_there).select("id", F.inline(F.concat(*starts)))
    # A frame by range takes in what stands at the same position.
    up, down = (
        Window.partitionBy("id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        for order in (F.asc("pos"), F.desc("pos"))
    )
    last = {n: F.max(F.when(F.col("member") == n, F.col("pos"))).over(up) for n in numbers}
    ends = reduce(lambda a, b: a & b, [F.coalesce(F.col("pos") - last[n] <= windows[n], F.lit(False)) for n in numbers])
    swept = rows.withColumn("end", F.when(ends, F.col("pos")))
    swept = swept.withColumn("next_end", F.min("end").over(down))
    near_enough = {n: (F.col("member") == n) & (F.col("next_end") - F.col("pos") <= windows[n]) for n in numbers}
    return swept.groupBy("id").agg(*[F.count_if(near_enough[n]).alias(f"swept{n}") for n in numbers])


def _phrase_positions(p: Phrase, at: dict[_Slot, Column]) -> Column:
    """Where the phrase starts, in its allowed columns."""
    slots = _slots(p)
    starts = at[slots[0]]
    for k, slot in enumerate(slots[1:], 1):
        starts = F.array_intersect(starts, _shifted(at[slot], k))
    return _allowed(p, starts)


def _allowed(p: Phrase, starts: Column) -> Column:
    starts = positions_in(starts, p.fields)
    if p.first:
        starts = F.array_intersect(starts, F.array(*[F.lit(field_start(f)) for f in FIELDS]))
    return starts


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda pos: pos - by)


def _article_hits(
    index: Index, query: Query, known: dict[str, list[str] | None] | None = None
) -> tuple[DataFrame, list[Phrase]]:
    """One row per article with any of the query's words.

    ``h<i>`` counts the hits of phrase i on its own, ``f<i>`` those that count for
    ranking (inside NEAR only the ones near enough). A word or prefix that stands alone is
    counted where its postings are read: only numbers are gathered, summed on the way.
    Positions are gathered for phrases and NEAR.
    """
    phrases = _phrases(query)
    close = {first + k for first, group in _near_groups(query) for k in range(len(group.phrases))}
    alone = {i: _slots(p)[0] for i, p in enumerate(phrases) if len(p.words) == 1 and i not in close}
    slots = list(dict.fromkeys(s for p in phrases for s in _slots(p)))
    rows = postings_of(index, [(s.word, s.prefix) for s in slots], known)
    placed = list(dict.fromkeys(s for i, p in enumerate(phrases) if i not in alone for s in _slots(p)))
    at = {slot: F.col(f"at{n}") for n, slot in enumerate(placed)}
    hits_here = {i: F.size(_allowed(phrases[i], F.col("at"))) for i in alone}
    if len(slots) == 1 and not slots[0].prefix:
        # One word: its postings already are one row per article.
        per_article = rows.select(
            "id", "dl", *[F.col("at").alias(f"at{n}") for n in range(len(placed))],
            *[hits.alias(f"c{i}") for i, hits in hits_here.items()],
        )
    else:
        per_article = rows.groupBy("id").agg(
            F.max("dl").alias("dl"),
            *[
                F.flatten(F.collect_list(F.when(slot.matches(), F.col("at")))).alias(f"at{n}")
                for n, slot in enumerate(placed)
            ],
            *[
                F.sum(F.when(slot.matches(), hits_here[i]).otherwise(0)).cast("int").alias(f"c{i}")
                for i, slot in alone.items()
            ],
        )
    found = per_article.select(
        "id", "dl", *[f"c{i}" for i in alone],
        *[_phrase_positions(p, at).alias(f"p{i}") for i, p in enumerate(phrases) if i not in alone],
    )
    own = {i: F.col(f"c{i}") if i in alone else F.size(f"p{i}") for i in range(len(phrases))}
    counted = dict(own)
    wide = []
    for first, group in _near_groups(query):
        members = [F.col(f"p{first + k}") for k in range(len(group.phrases))]
        lengths = [len(p.words) for p in group.phrases]
        if max(lengths) + group.distance > LISTED_WINDOW:
            wide.append((first, group))
            continue
        for k, hits in enumerate(_near_hits(members, lengths, group.distance)):
            counted[first + k] = F.size(hits)
    if wide:
        found = materialize(found, "positions")  # read once here and once per sweep
        joined = found
        for first, group in wide:
            joined = joined.join(_swept(found, first, group), "id", "left")
            for n in range(first, first + len(group.phrases)):
                counted[n] = F.coalesce(f"swept{n}", F.lit(0)).cast("int")
        found = joined
    return found.select(
        "id",
        "dl",
        *[hits.alias(f"h{i}") for i, hits in own.items()],
        *[hits.alias(f"f{i}") for i, hits in counted.items()],
    ), phrases


def _near_groups(query: Query, first: int = 0) -> list[tuple[int, Near]]:
    """Every NEAR of the query with the number of its first phrase."""
    if isinstance(query, Phrase):
        return []
    if isinstance(query, Near):
        return [(first, query)]
    parts = [query.kept, query.dropped] if isinstance(query, Without) else list(query.parts)
    groups = []
    for part in parts:
        groups += _near_groups(part, first)
        first += len(_phrases(part))
    return groups


# -- ranking -----------------------------------------------------------------


def inverse_frequency(n_docs: Column, n_hits: Column) -> Column:
    idf = F.log((n_docs - n_hits + 0.5) / (n_hits + 0.5))
    return F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)


def bm25(idf: Column, hits: Column, length: Column, average: Column) -> Column:
    """The (negative) weight of one phrase in one article: smaller is better."""
    return -(idf * (hits * (K1 + 1)) / (hits + K1 * (1 - B + B * length / average)))


def _evaluate(query: Query, first: int, weights: list[Column]) -> tuple[Column, Column]:
    """(matched, score): only operands that matched count."""
    if isinstance(query, Phrase):
        matched = F.col(f"f{first}") > 0
        return matched, F.when(matched, weights[first]).otherwise(0.0)
    if isinstance(query, Near):
        numbers = range(first, first + len(query.phrases))
        matched = reduce(lambda a, b: a & b, [F.col(f"f{n}") > 0 for n in numbers])
        score = reduce(lambda a, b: a + b, [weights[n] for n in numbers])
        return matched, F.when(matched, score).otherwise(0.0)
    if isinstance(query, Without):
        kept, score = _evaluate(query.kept, first, weights)
        dropped, _ = _evaluate(query.dropped, first + len(_phrases(query.kept)), weights)
        matched = kept & ~dropped
        return matched, F.when(matched, score).otherwise(0.0)
    results = []
    for part in query.parts:
        results.append(_evaluate(part, first, weights))
        first += len(_phrases(part))
    join = (lambda a, b: a & b) if isinstance(query, Both) else (lambda a, b: a | b)
    matched = reduce(join, [m for m, _ in results])
    score = reduce(lambda a, b: a + b, [s for _, s in results])
    return matched, F.when(matched, score).otherwise(0.0)


def _is_counted(p: Phrase) -> bool:
    """A whole word anywhere: the index keeps its number of articles."""
    return len(p.words) == 1 and not p.prefix and not p.first and set(p.fields) == set(FIELDS)


def matches(index: Index, query: Query) -> DataFrame:
    """(id, score) of the articles that match; the best score is the smallest."""
    if not isinstance(query, Query):
        raise ValueError(f"not a query: {query!r}")
    if _is_empty(query):
        return index.postings.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    # At most LISTED_WORDS words for each prefix of the query.
    known = {p.words[-1]: index.listed(p.words[-1]) for p in _phrases(query) if p.prefix and p.words}
    query = _whole_words(query, known)
    hits, phrases = _article_hits(index, query, known)
    numbers = range(len(phrases))
    # One row of statistics each, read as scalar subqueries; every further column is
    # a step of its own, so that a subquery is not repeated for each use.
    if all(_is_counted(p) for p in phrases):
        known = index.frequencies.where(F.col("term").isin(*{p.words[0] for p in phrases}))
        frequencies = known.agg(
            F.struct(
                *[
                    F.coalesce(F.sum(F.when(F.col("term") == p.words[0], F.col("df"))), F.lit(0)).alias(f"n{i}")
                    for i, p in enumerate(phrases)
                ]
            )
        )
    else:
        # Hits are needed twice, to count and to rank, but the postings are read once.
        hits = materialize(hits, "hits")
        frequencies = hits.agg(
            F.struct(*[F.count_if(F.col(f"h{i}") > 0).alias(f"n{i}") for i in numbers])
        )
    with_statistics = hits.withColumns(
        {
            "_frequency": frequencies.scalar(),
            "_corpus": index.corpus().select(F.struct("n_docs", "avgdl")).scalar(),
        }
    )
    with_weights = with_statistics.withColumns(
        {
            f"_idf{i}": inverse_frequency(F.col("_corpus.n_docs"), F.col(f"_frequency.n{i}"))
            for i in numbers
        }
    )
    weights = [
        bm25(F.col(f"_idf{i}"), F.col(f"f{i}"), F.col("dl"), F.col("_corpus.avgdl"))
        for i in numbers
    ]
    matched, score = _evaluate(query, 0, weights)
    return with_weights.where(matched).select("id", score.alias("score"))


def search(
    index: Index, articles: DataFrame, query: Query, limit: int | None = None
) -> DataFrame:
    """Matching articles, best first: id, url, title, author, added_at, score.

    With a small limit the best ids are found first and then looked up by a filter on the
    id, by which the articles are ordered: only row groups that hold one of them are read.
    """
    ranked = matches(index, query)
    columns = articles.select("id", "url", "title", "author", "added_at")
    if limit is not None:
        ranked = ranked.orderBy("score", "id").limit(limit)
        if limit <= LOOKED_UP:
            best = ranked.collect()  # at most LOOKED_UP pairs of numbers
            ranked = articles.sparkSession.createDataFrame(best, ranked.schema)
            columns = columns.where(F.col("id").isin([row["id"] for row in best]))
    return columns.join(ranked, "id").orderBy("score", "id")


# -- many queries at once ------------------------------------------------------


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table for the next steps; its columns are known, so no file is opened to learn them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class _Planned:
    """Queries over an index: ``worded`` as (query_id, words); the words that occur as (term, t,
    n_hits); and ``sets`` as (q, words, rare), for each set of words that all occur somewhere:
    their numbers t, rarest first.

    A set of words is a number q and a word a number t: what is moved per candidate does not grow
    with the length of its query.
    """

    index: Index
    worded: DataFrame
    terms: DataFrame
    sets: DataFrame

    def answers(self, found: DataFrame) -> DataFrame:
        """What was found for each q, for every query that has its words."""
        numbered = self.worded.join(self.sets.select("words", "q"), "words").select("query_id", "q")
        return numbered.join(found, "q").drop("q")


def _planned(index: Index, queries: DataFrame) -> _Planned:
    worded = queries.select(
        "query_id", F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("words")
    ).where(F.size("words") > 0)
    worded = _written(worded, "queries")
    words = worded.select("words").distinct().select(F.explode("words").alias("term"), "words")
    asked = words.select("term").distinct()
    counts = index.frequencies.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n_hits"))
    terms = _written(counts.withColumn("t", F.monotonically_increasing_id()), "terms")
    by_rarity = F.array_sort(F.collect_list(F.struct("n_hits", "term", "t")))
    sets = (
        words.join(terms, "term")
        .groupBy("words")
        .agg(by_rarity["t"].alias("rare"))
        .where(F.size("words") == F.size("rare"))
        .withColumn("q", F.monotonically_increasing_id())
    )
    return _Planned(index, worded, terms, _written(sets, "plans"))


class _Corpus:
    """The size of the corpus, which is one row, and what follows from it."""

    def __init__(self, index: Index, one_block: int) -> None:
        row = index.corpus().first()
        self.one_block = (row["n_docs"] or 0) <= one_block
        self.n_docs = F.lit(row["n_docs"]).cast("bigint")
        self.avgdl = F.lit(row["avgdl"]).cast("double")

    def weight(self, n_hits: Column, hits: Column, length: Column) -> Column:
        return bm25(inverse_frequency(self.n_docs, n_hits), hits, length, self.avgdl)

    def block(self, article_id: Column) -> Column:
        return F.lit(0).cast("bigint") if self.one_block else block_of(article_id)


def _bounds(planned: _Planned, corpus: _Corpus) -> DataFrame:
    """(q, block, bound): the blocks that have every word of a query, and what no article there can
    outdo. The rarest word names the blocks; the others are looked up there."""
    if corpus.one_block:
        return planned.sets.select("q", F.lit(0).cast("bigint").alias("block"), F.lit(0.0).alias("bound"))
    known = planned.terms.join(planned.sets.select(F.explode("rare").alias("t")), "t", "left_semi")
    kept = planned.index.blocks.join(known, "term").select("t", "block", "n_hits", "most", "shortest")
    named = planned.sets.select("q", F.col("rare")[0].alias("t")).join(kept.select("t", "block"), "t")
    named = _written(named.select("q", "block"), "named")
    asked = named.join(planned.sets.select("q", F.explode("rare").alias("t")), "q")
    # A block that two batches share has a row of each: the sum is then too high, but still a bound.
    found = asked.join(kept, ["t", "block"]).groupBy("q", "block").agg(
        F.size(F.collect_set("t")).alias("_found"),
        F.sum(corpus.weight(F.col("n_hits"), F.col("most"), F.col("shortest"))).alias("bound"),
    )
    sizes = planned.sets.select("q", F.size("rare").alias("_size"))
    found = found.join(sizes, "q").where(F.col("_found") == F.col("_size"))
    return _written(found.select("q", "block", "bound"), "bounds")


def _answered(planned: _Planned, blocks: DataFrame, corpus: _Corpus) -> DataFrame:
    """(q, id, score): the articles with all words of a query, in the blocks (q, block) given for it.

    Candidates come from the rarest word only; the others are then looked up by (word, article),
    a key no value of which is frequent, the second rarest first, so that few are left for the rest.
    """
    # The bucket is a partition column: joined on it, other buckets are not read.
    asked = blocks.join(planned.sets.select("q", "rare"), "q")
    needed = asked.select("block", F.explode("rare").alias("t")).distinct().join(planned.terms, "t")
    # What the postings meet is written first: of a written table Spark knows the size.
    needed = _written(needed.withColumn("term_bucket", bucket_of(F.col("term"))), "needed")
    rows = planned.index.terms().withColumn("block", corpus.block(F.col("id")))
    held = rows.join(needed, ["term_bucket", "term", "block"]).select(
        "t", "block", "id", "dl", F.size("at").alias("hits"), "n_hits"
    )
    held = _written(held, "held")  # looked at three times; without positions
    weight = corpus.weight(F.col("n_hits"), F.col("hits"), F.col("dl"))
    weighed = held.select("t", "block", "id", weight.alias("weight"))
    rarest = asked.select(
        "block", "q", F.size("rare").alias("n"), F.col("rare")[0].alias("t"), F.get("rare", F.lit(1)).alias("t2")
    )
    rarest = _written(rarest, "rarest")
    begun = weighed.join(rarest, ["t", "block"]).select("q", "id", "n", "t2", F.col("weight").alias("score"))
    begun = _written(begun, "candidates")
    second = begun.where("n > 1").withColumnRenamed("t2", "t")
    narrowed = second.join(weighed.drop("block"), ["t", "id"])
    narrowed = _written(narrowed.select("q", "id", "n", (F.col("score") + F.col("weight")).alias("score")), "narrowed")
    # Their other words, one row each.
    others = planned.sets.select("q", F.explode(F.slice("rare", 3, F.size("rare"))).alias("t"))
    rest = _written(narrowed.where("n > 2").join(others, "q"), "rest")
    found = (
        rest.join(weighed.drop("block"), ["t", "id"])
        .groupBy("q", "id")
        .agg(F.count(F.lit(1)).alias("n_found"), F.max("n").alias("n"), F.max("score").alias("score"), F.sum("weight").alias("more"))
        .where(F.col("n_found") == F.col("n") - 2)
        .select("q", "id", (F.col("score") + F.col("more")).alias("score"))
    )
    return (
        begun.where("n = 1")
        .select("q", "id", "score")
        .union(narrowed.where("n = 2").select("q", "id", "score"))
        .union(found)
    )


def _promising(planned: _Planned, bounds: DataFrame, corpus: _Corpus, k: int, n_first: int) -> DataFrame:
    """The blocks that can hold one of the best ``k`` of a query.

    The blocks of best bound are scored first. If they have ``k`` articles, blocks whose bound does
    not reach the last of these are passed over; none that could change the answer is.
    """
    if corpus.one_block:
        return bounds
    many = bounds.groupBy("q").count().where(F.col("count") > n_first).select("q")
    if not many.take(1):
        return bounds
    by_bound = Window.partitionBy("q").orderBy("bound", "block")
    first = bounds.join(many, "q", "left_semi").withColumn("_no", F.row_number().over(by_bound))
    first = _written(first.where(F.col("_no") <= n_first).drop("_no"), "first_blocks")
    by_score = Window.partitionBy("q").orderBy("score")
    last = _answered(planned, first, corpus).withColumn("_no", F.row_number().over(by_score))
    last = last.where(F.col("_no") == k).select("q", F.col("score").alias("_last"))
    # Scores that round to the same are ties, and the id decides.
    reaches = F.col("_last").isNull() | (F.col("bound") <= F.col("_last") + 10.0 ** (1 - TIE_DIGITS))
    return _written(bounds.join(last, "q", "left").where(reaches).drop("_last"), "promising")


def match_batch(index: Index, queries: DataFrame, one_block: int = ONE_BLOCK) -> DataFrame:
    """The articles that hold all words of each query: (query_id, id, score).

    ``queries`` is (query_id, text). Queries with the same words are answered once, and only in
    blocks of articles that have all their words; an archive of up to ``one_block`` articles is one.
    """
    planned = _planned(index, queries)
    corpus = _Corpus(index, one_block)
    answered = _answered(planned, _bounds(planned, corpus), corpus)
    return planned.answers(answered).select("query_id", "id", "score")


def search_batch(
    index: Index, queries: DataFrame, k: int = 10, one_block: int = ONE_BLOCK, first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """The best ``k`` articles of each query: (query_id, id, score, rank).

    Of queries with more than ``first_blocks`` blocks those that cannot reach the best ``k`` are not
    scored. The limit is applied before the rows of a query meet, so no more than ``k`` rows per
    task are sent.
    """
    planned = _planned(index, queries)
    corpus = _Corpus(index, one_block)
    blocks = _promising(planned, _bounds(planned, corpus), corpus, k, first_blocks)
    # The weights of a row are summed in no fixed order, so equal texts may differ in
    # the last bits; rounding lets the id decide between them, as it should.
    by_rank = Window.partitionBy("q").orderBy(F.round("score", TIE_DIGITS), "id")
    best = (
        _answered(planned, blocks, corpus)
        .withColumn("rank", F.row_number().over(by_rank).cast("bigint"))
        .where(F.col("rank") <= k)
    )
    return planned.answers(best).select("query_id", "id", "score", "rank")
