"""Dense numbers in a given order, without a single-task window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import spread_join

# Row numbers inside a partition are the low bits of monotonically_increasing_id.
_ROW_BITS = (1 << 33) - 1


def number_rows(
    df: DataFrame,
    order_by: list[str | Column],
    start: Column,
    name: str = "id",
    write: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Number the rows start, start + 1, ... in the given order.

    The rows are range-partitioned, sorted and written (by ``write``) with their place in
    their partition; afterwards only one count per partition has to be summed up.
    """
    placed = write(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "numbered",
    )
    # One row per partition, so the window and the broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(
        name, (start + F.col("_before") + F.col("_place")).cast("bigint")
    ).drop("_part", "_place", "_before")


def number_within(
    df: DataFrame, group: str, order_by: list[str | Column], spread_by: str, name: str
) -> DataFrame:
    """Number the rows of each group from 1, also when one group is most of the rows.

    All rows are numbered in (group, order); a group's first number is then taken off.
    """
    numbered = number_rows(df, [group, *order_by], F.lit(0), "_no")
    firsts = numbered.groupBy(group).agg(F.min("_no").alias("_first"))
    joined = spread_join(numbered, firsts, group, spread_by, "inner")
    return joined.withColumn(name, F.col("_no") - F.col("_first") + 1).drop("_no", "_first")
