"""The mixture beside a plain version."""

import collections
import random

import data
import pytest
from pyspark.sql import functions as F

from readlake.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > limit * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def rows_of(n=600):
    rng = random.Random(8)
    names = ["a", "b", "c", "d", "é", "", None, "zero"]
    out = []
    for k in range(n):
        source = "a" if k % 3 == 0 else rng.choice(names)
        words = 0 if source == "zero" else rng.choice([0, 1, 5, 30, 200])
        out.append((k, "w " * words if words or k % 2 else None, source))
    return [*out, out[3], out[3], (None, "a b c", "b"), (None, None, None)]


@pytest.mark.parametrize("share, limit", [(1.5, 2.0), (0.7, 2.0), (2.0, 2.0), (0.0, 1.0)])
def test_mixture(spark, share, limit):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df = df.selectExpr("*", *(f"1 AS `{c}`" for c in data.CLASHING))
    found = mixing.plan_mixture(df, share=share, limit=limit).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    target = brute_targets(sizes, share=share, limit=limit)
    taken = collections.Counter()
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and r.copies <= limit
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * 200
    again = mixing.plan_mixture(df.repartition(2), share=share, limit=limit).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(map(tuple, again))


def test_mix_emits_copies(spark):
    df, _ = data.documents(spark, ["a b c d", "e f", None, "g", "h i j", "k l", "m", "n o p q r"])
    copies = collections.Counter()  # the last row comes twice
    for r in mixing.plan_mixture(df).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = collections.Counter(r.doc_id for r in out.where(F.col("doc_id") > 1).collect())
    assert got == {k: n for k, n in copies.items() if k and k > 1 and n}


def test_empty(spark):
    assert mixing.plan_mixture(data.empty(spark)).count() == 0
    assert mixing.mix(data.empty(spark)).count() == 0
