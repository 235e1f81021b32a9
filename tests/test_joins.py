"""Salted joins: the same rows as a plain join, and nothing large through the driver."""

from pyspark.sql import functions as F

from readlake.operators.joins import spread_join
from readlake.session import scratch_path


def test_repeated_rows_are_not_taken_for_a_small_table(spark):
    """A table under the limit for broadcasts is over it once it is repeated per salt."""
    root = scratch_path(spark, "salted")
    key = F.concat(F.lit("https://e.org/"), F.sha2(F.col("id").cast("string"), 256)).alias("url")
    for name in ("many", "one"):
        spark.range(30_000).select(key, F.col("id").alias(name)).write.parquet(f"{root}/{name}")
    many, one = (spark.read.parquet(f"{root}/{name}") for name in ("many", "one"))
    size = int(str(one._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
    try:
        joined = spread_join(many.where("many % 3 > 0"), one.where("one % 2 = 0"), "url", "many", salts=16)
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        rows = [(r.many, r.one) for r in joined.select("many", "one").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(rows) == [(k, None if k % 2 else k) for k in range(30_000) if k % 3]


def test_rows_without_a_key_and_repeated_ones(spark):
    many = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", None)], "k string, n int")
    one = spark.createDataFrame([("a", "x"), (None, "y")], "k string, v string")
    got = {how: sorted(map(repr, map(tuple, spread_join(many, one, "k", "n", how, salts=3).collect()))) for how in ("left", "inner")}
    assert got["inner"] == sorted(map(repr, [("a", 1, "x"), ("a", 1, "x")]))
    assert got["left"] == sorted(map(repr, [("a", 1, "x"), ("a", 1, "x"), (None, 2, None), ("b", None, None)]))
