"""A join for keys of which one may hold a large part of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: str,
    spread_by: str,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join many rows per key with at most one: a hot key's rows go to several tasks.

    Rows of ``many`` are dealt out by ``spread_by``; ``one`` is repeated per salt. There are
    as many salts as the square root of the shuffle partitions, rounded up, unless told
    otherwise: a key of a third of the rows is then spread as the cluster grows, and
    repeating ``one`` stays cheap beside ``many``.

    The salts are a table that ``one`` is multiplied with: Spark multiplies their sizes too, while it
    takes exploded rows for as many as there were and would send all of them through the driver.
    """
    if salts is None:
        salts = math.isqrt(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1) + 1
    salted_many = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    numbers = many.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({k})' for k in range(salts))} AS salts(_salt)")
    salted_one = one.crossJoin(numbers)
    return salted_many.join(salted_one, [on, "_salt"], how).drop("_salt")
