"""The inverted index: one posting per (term, article), with its positions.

A posting carries where its term occurs and the length of its article, so ranking
needs no join with a per-article table. A position is one number: its column's
offset plus the token's place in that column. The offsets are so far apart that
"the next token" and "within n tokens" never reach into another column.

The positions of a term are gathered inside the article's own row; the only
exchange of a build is the one that clusters the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .generations import Generations, State, Table

FIELDS = ("title", "author", "text")
FIELD_SPAN = 1 << 29
# Terms are bucketed by their first letter, and within it by their first two: a prefix of
# two letters prunes partitions as a whole term does, one of one letter to a GROUP of them.
GROUPS = 8
GROUP = 8
BUCKETS = GROUPS * GROUP
BUCKET_PREFIX = 2
# Tokens whose postings a task gathers at a time, about.
GATHERED = 1 << 18
# One row per article, in a bucket of its own, holds the article's length. The
# empty text is never a token.
ARTICLE_ROW = ""
ARTICLE_BUCKET = BUCKETS

POSTINGS_SCHEMA = "term string, id bigint, dl int, at array<int>, term_bucket int"
TOTALS_SCHEMA = "n_docs bigint, n_tokens bigint"
FREQUENCIES_SCHEMA = "term string, df bigint, hits bigint"
# Articles of neighbouring ids form a block. For each word and block the index keeps what no
# article of the block can exceed: the most hits, and the length of the shortest article.
BLOCK_BITS = 10
# So many words of a prefix are looked up one by one; of more, their range of terms is read.
LISTED_WORDS = 1000
BLOCKS_SCHEMA = "term string, block bigint, df bigint, hits bigint, most int, shortest int"


def _group_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(GROUPS)).cast("int")


def bucket_of(term: Column) -> Column:
    within = F.pmod(F.xxhash64(F.substring(term, 1, BUCKET_PREFIX)), F.lit(GROUP)).cast("int")
    return F.when(term == ARTICLE_ROW, F.lit(ARTICLE_BUCKET)).otherwise(_group_of(term) * GROUP + within)


def may_hold(word: str, prefix: bool) -> Column:
    """Whether a bucket can have the word, or words that begin with it. Constant but for the
    bucket, so the optimizer prunes partitions by it."""
    if prefix and len(word) < BUCKET_PREFIX:
        first = _group_of(F.lit(word)) * GROUP
        return F.col("term_bucket").between(first, first + (GROUP - 1))
    return F.col("term_bucket") == bucket_of(F.lit(word))


def field_start(name: str) -> int:
    return FIELDS.index(name) * FIELD_SPAN


def positions_in(at: Column, fields: tuple[str, ...]) -> Column:
    """The positions that lie in the given columns."""
    if set(fields) == set(FIELDS):
        return at
    return F.filter(
        at, lambda p: (p / FIELD_SPAN).cast("int").isin([FIELDS.index(name) for name in fields])
    )


def _gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of some articles (id, and the tokens of each field), and a row for each article."""
    lengths = [pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy() for name in FIELDS]
    n_docs, dl = batch.num_rows, sum(lengths).astype(np.int32)
    words = pa.concat_arrays([batch.column(name).flatten() for name in FIELDS]).dictionary_encode()
    # Terms by rank, so that rows come in order of terms: what is sorted later has long runs.
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.concatenate([np.repeat(np.arange(n_docs), n) for n in lengths])
    place = np.concatenate([
        np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + field_start(name)
        for name, n in zip(FIELDS, lengths, strict=True)
    ])
    key = rank[words.indices.to_numpy()] * n_docs + doc
    # Stable: places of a term in an article keep the order of the fields.
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    term, doc = np.divmod(key[starts], max(n_docs, 1))
    ends = np.concatenate([np.zeros(n_docs, np.int32), starts, [len(key)]]).astype(np.int32)
    own = np.concatenate([np.arange(n_docs), doc])
    terms = words.dictionary.take(pa.array(order[term]))
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array([ARTICLE_ROW] * n_docs, terms.type), terms]),
        batch.column("id").take(pa.array(own)),
        pa.array(dl[own]),
        pa.ListArray.from_arrays(ends, pa.array(place[by_key].astype(np.int32))),
    ], ["term", "id", "dl", "at"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of so many tokens at a time, however long the articles are."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy().astype(np.int64) for name in FIELDS)
        shares = np.flatnonzero(np.diff(np.cumsum(sizes) // GATHERED, prepend=-1))
        for first, end in pairwise([*shares, batch.num_rows]):
            yield _gathered(batch.slice(first, end - first))


def postings(articles: DataFrame) -> DataFrame:
    """(term, id, dl, at): the sorted positions of each term in each article."""
    worded = articles.select("id", *[tokens(F.col(name)).alias(name) for name in FIELDS])
    gathered = worded.mapInArrow(_gather, "term string, id bigint, dl int, at array<int>")
    return gathered.withColumn("term_bucket", bucket_of(F.col("term")))


def totals(rows: DataFrame) -> DataFrame:
    """One row: how many articles and how many tokens."""
    article_rows = rows.where((F.col("term_bucket") == ARTICLE_BUCKET) & (F.col("term") == ARTICLE_ROW))
    return article_rows.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, df, hits): one posting is one article."""
    terms = rows.where((F.col("term_bucket") != ARTICLE_BUCKET) & (F.col("term") != ARTICLE_ROW))
    return terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.size("at")).alias("hits")
    )


def block_of(article_id: Column) -> Column:
    return F.shiftright(article_id, BLOCK_BITS)


def blocks(rows: DataFrame) -> DataFrame:
    """(term, block, df, hits, most, shortest): what bounds a term's scores in a block of articles."""
    terms = rows.where((F.col("term_bucket") != ARTICLE_BUCKET) & (F.col("term") != ARTICLE_ROW))
    counted = terms.select("term", block_of(F.col("id")).alias("block"), F.size("at").alias("n"), "dl")
    return counted.groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("df"), F.sum("n").alias("hits"), F.max("n").alias("most"), F.min("dl").alias("shortest")
    )


@dataclass(frozen=True)
class Index:
    """The postings, the totals, the frequencies of single terms and their bounds by block of every
    indexed batch. If it is written, the frequencies are a dictionary: in order of terms."""

    postings: DataFrame
    totals: DataFrame
    frequencies: DataFrame
    blocks: DataFrame
    is_written: bool = False

    @staticmethod
    def of(articles: DataFrame) -> "Index":
        """An index that is not written: for one-off questions."""
        rows = postings(articles)
        return Index(rows, totals(rows), frequencies(rows), blocks(rows))

    @staticmethod
    def read(spark: SparkSession, root: str) -> "Index":
        return Index.committed(Generations(spark, root))

    @staticmethod
    def committed(batches: Generations, folder: str = "", state: State | None = None) -> "Index":
        state = batches.state() if state is None else state
        bounds = batches.read(f"{folder}blocks", BLOCKS_SCHEMA, state=state)
        # Batches written before there were blocks: theirs are made from the postings.
        older = {
            c.batch_id
            for c in state.valid.values()
            if f"{folder}postings" in c.tables and f"{folder}blocks" not in c.tables
        }
        if older:
            made = blocks(batches.read(f"{folder}postings", POSTINGS_SCHEMA, only=older, state=state))
            bounds = bounds.unionByName(made, allowMissingColumns=True)
        return Index(
            batches.read(f"{folder}postings", POSTINGS_SCHEMA, state=state),
            batches.read(f"{folder}totals", TOTALS_SCHEMA, state=state),
            batches.read(f"{folder}frequencies", FREQUENCIES_SCHEMA, state=state),
            bounds,
            is_written=True,
        )

    def words(self, prefix: str) -> DataFrame:
        """(term, df, hits) of the words that begin with the prefix: a range of the dictionary."""
        found = self.frequencies.where(F.col("term").startswith(prefix))
        return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))

    def listed(self, prefix: str) -> list[str] | None:
        """The words that begin with the prefix; none if there are more than LISTED_WORDS, or no
        dictionary to look them up in."""
        if not self.is_written:
            return None
        found = [r["term"] for r in self.words(prefix).select("term").limit(LISTED_WORDS + 1).collect()]
        return sorted(found) if len(found) <= LISTED_WORDS else None

    def terms(self) -> DataFrame:
        """The postings without the rows that describe articles."""
        return self.postings.where(
            (F.col("term_bucket") != ARTICLE_BUCKET) & (F.col("term") != ARTICLE_ROW)
        )

    def document_frequencies(self) -> DataFrame:
        """(term, df, hits) over all batches, from what each has counted."""
        return self.frequencies.groupBy("term").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))

    def corpus(self) -> DataFrame:
        """One row summed over the batches: n_docs, n_tokens, avgdl."""
        return self.totals.agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).withColumn("avgdl", F.col("n_tokens").cast("double") / F.col("n_docs"))


def write_index(articles: DataFrame, root: str, batch_id: int = 0) -> None:
    """Index one batch of articles below a folder of its own; writing the batch again, also
    with other articles or none, replaces it."""
    batches = Generations(articles.sparkSession, root)
    state = batches.state()
    generation = batches.new(batch_id, state)
    tables = write_postings(postings(articles.select("id", *FIELDS)), batches, batch_id, generation)
    batches.commit(generation, batch_id, tables, state)


def write_postings(
    rows: DataFrame, batches: Generations, batch_id: int, generation: str, folder: str = ""
) -> dict[str, Table]:
    """Write a batch's postings by bucket, and their counts; the tables written.

    Spark deals them out by bucket and by size: a bucket with a stop word that every
    article has is split over tasks, small ones share a task, and the number of files
    follows the data. Sorted by term, the files let Parquet skip row groups.
    """
    dealt = rows.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term", "id")
    tables = {f"{folder}postings": batches.write(dealt, f"{folder}postings", batch_id, generation, ("term_bucket",))}
    path = batches.path(f"{folder}postings", batch_id, generation)
    written = rows.sparkSession.read.schema(POSTINGS_SCHEMA).parquet(path)
    tables[f"{folder}totals"] = batches.write(totals(written).coalesce(1), f"{folder}totals", batch_id, generation)
    found = blocks(written).sortWithinPartitions("term", "block")  # dealt out evenly by the counting
    tables[f"{folder}blocks"] = batches.write(found, f"{folder}blocks", batch_id, generation)
    # Counted from the postings, where a term is in one place: of the blocks, every file has most terms.
    # A file is a range of terms, so that a word or a prefix is in few of them.
    found = frequencies(written).repartitionByRange("term").sortWithinPartitions("term")
    tables[f"{folder}frequencies"] = batches.write(found, f"{folder}frequencies", batch_id, generation)
    return tables
