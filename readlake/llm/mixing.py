"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents are put in order of size, each expects the same number of copies, and
the running sum of expected copies plus one offset per source is cut at the integers: a
document is emitted once per integer that its step crosses. In that order every stretch of
sizes is taken at the source's rate, so the words taken stay within about one document of
the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = "mixing"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """From (source, source_size), one row per source: its ``target``.

    Sources in order (null last) take the weights in turn and share ``share`` times all words.
    None gets more than ``limit`` times its own; what it would have got beyond goes to the
    others by weight, until none is above. That is a common level per weight unit, cut at each
    source's limit: the level is the largest that any number of cut sources gives, cut in
    order of limit per weight. A source without words has target 0.
    """
    if not 0 <= share <= limit:
        raise ValueError("the share must be between 0 and the limit")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*(F.lit(w) for w in weights))[(place % len(weights)).cast("int")]
    most = (limit * F.col("source_size")).alias("most")
    # Windows over one row per source.
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    sharers = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    return (
        sizes.select("source", "source_size", turn.alias("weight"), most)
        .withColumn("level", left / sharers)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def _offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the source's name."""
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / (1 << 32)


def plan_mixture(
    documents: DataFrame,
    keep: list[str] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = SEED,
) -> DataFrame:
    """Per row ``doc_id``, ``source``, ``size`` in words, ``source_size``, ``target`` of the
    source, ``copies``, and ``taken`` = copies x size.

    A null or empty text has size 0, a null source is a source of its own. Equal inputs give
    equal results, whatever the partitioning; of repeated rows, which are alike, any may be
    the one taken. ``keep`` names columns to carry along as one struct, ``row``; others are
    not read. A document of more than ``limit`` times its words cannot come out.
    """
    carried = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    sized = documents.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.monotonically_increasing_id().alias("_row"),  # only parts rows that are alike
        *carried,
    )
    if not carried:
        sized = materialize(sized, "sized")
    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "_row"]
    numbered = materialize(number_rows(sized, order, F.lit(0), "_no").drop("_row"), "mixture")
    totals = numbered.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_no").alias("_first"))
    totals = materialize(totals, "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(totals.select("source", "source_size"), weights, share, limit)
    plan = materialize(
        targets.join(totals.select(F.col("source").alias("_s"), "_first"), F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_source"), "source_size", "target", "_first")
        .withColumn("_rate", rate)
        .withColumn("_offset", _offset(F.col("_source"), seed)),
        "plan",
    )
    # The plan is a written table: Spark broadcasts it only if its size allows that.
    joined = numbered.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    step = F.col("_no") - F.col("_first")
    crossed = F.floor((step + 1) * F.col("_rate") + F.col("_offset")) - F.floor(
        step * F.col("_rate") + F.col("_offset")
    )
    copies = F.least(crossed, F.floor(F.lit(limit))).cast("bigint")
    return joined.withColumn("copies", copies).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *(["row"] if keep else []),
    )


def mix(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as it is taken, with all their columns."""
    planned = plan_mixture(documents, keep=documents.columns, **options).where("copies > 0")
    return planned.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


# The same in SQL. {documents} is the table or a subquery with the documents' columns.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM {documents}),
places AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS step FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS most
  FROM sizes),
levels AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target,
    ('0x' || substr(md5('mixing:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
mixture AS (
  SELECT p.doc_id, p.source, p.size, r.source_size, r.target,
    least(floor((p.step + 1) * r.rate + r.shift) - floor(p.step * r.rate + r.shift), 2)::BIGINT AS copies
  FROM places p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source)
"""
