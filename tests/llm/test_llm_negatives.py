import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import negatives
from readlake.llm.negatives import cover_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tree string, id string, score double, block int, anchor long"


def table(spark, rows):
    """The rows with columns whose names are used inside."""
    return spark.createDataFrame([(*r, "x", "y", 1.0, 2, 3) for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, positives=5, count=10, low=30, high=90):
    ready = {
        (i, label, tuple(math.floor(256 * np.float32(x).astype(float)) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, label, v in ready:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ready if j != i)
        alike = [(s, j) for s, j, other in scored if other == label][:positives]
        for p, positive in alike:
            found = [(s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:count]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def result(df):
    assert [k for _, k in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dims, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    label = rng.integers(0, 4, n)
    return [(k, (centres[label[k]] + spread * rng.normal(size=dims)).tolist(), int(label[k])) for k in range(n)]


@pytest.mark.parametrize("tree_rows", [16, 100, 5000])
def test_equals_brute_force(spark, monkeypatch, tree_rows):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 20)
    rows = vectors(1, 400, 8)
    rows += [(1000 + k, rows[7][1], 2) for k in range(60)]  # one vector very often: ties
    rows += [(2000 + k, [0.5] * 3, k % 2) for k in range(20)]  # shorter ones
    rows += [(k, None, 1) for k in (5000, 5010)] + [(5020, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(5030, [1.0, None] * 4, 1), (5040, [math.inf] * 8, 1), (5050, [math.nan] * 8, 1), (5060, [], 1)]
    rows += rows[:30]  # repeated
    got = result(hard_negatives(table(spark, rows), F.col("id") % 10 == 0))
    wanted = brute(rows, lambda i: i % 10 == 0)
    assert len(wanted) > 300
    assert got == wanted


def test_one_label_few_rows_and_none(spark):
    alone = [(k, [float(k)], 1) for k in range(30)]
    assert result(hard_negatives(table(spark, alone), F.col("id") % 10 == 0)) == []
    assert result(hard_negatives(table(spark, []), F.col("id") % 10 == 0)) == []
    two = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.1], 2)]
    assert result(hard_negatives(table(spark, two), F.col("id") == 0)) == [(0, 1, 1, 2, 65536, 32768)]


def test_nodes_cover_their_rows():
    rng = np.random.default_rng(2)
    space = np.floor(rng.normal(size=(500, 5)) * 50)
    space[100:300] = space[0]
    order, ends, radii = cover_tree(space)
    assert sorted(order.tolist()) == list(range(500))
    squares = (space**2).sum(1)
    wide = np.c_[space, np.sqrt(squares.max() - squares)][order]
    nodes = 0
    for place, (own, radius) in enumerate(zip(ends, radii)):
        assert own == sorted(own, reverse=True)
        for end, reach in zip(own, radius):
            nodes += 1
            assert np.sqrt(((wide[place:end] - wide[place]) ** 2).sum(1)).max() <= reach + 1e-9
    assert nodes > 20


def test_bounds_skip_most_of_a_clustered_tree(monkeypatch):
    """Best-first descent verifies a part of the rows only."""
    import pyarrow as pa

    rng = random.Random(4)
    centres = [[rng.uniform(-900, 900) for _ in range(6)] for _ in range(40)]
    rows = [[math.floor(c + rng.uniform(-9, 9)) for c in centres[k % 40]] for k in range(1600)]
    n = len(rows)
    built = negatives._build(pa.table({
        "tree": pa.array([0] * n, pa.int64()), "id": pa.array(range(n), pa.int64()),
        "label": pa.array([k % 2 for k in range(n)], pa.int64()), "v": pa.array(rows, pa.list_(pa.float64())),
    }))
    seen = []
    exact = negatives.products
    monkeypatch.setattr(negatives, "products", lambda a, b: seen.append(a.shape[0] * b.shape[0]) or exact(a, b))
    asked = np.array(rows[:40], float)
    everything = (np.full((40, 1), -(2**62)), np.full((40, 1), 2**62))
    negatives.search(negatives._Tree(built), asked, np.arange(40), np.arange(40) % 2, *everything, 5, True)
    assert sum(seen) < 0.5 * 40 * n


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(ValueError, match="64 bits"):
        negatives.products(np.full((1, 1), 2.0**40), np.full((1, 1), 2.0**40))
