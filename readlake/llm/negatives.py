"""Hard negatives of anchors by inner product, found with cover trees.

The candidates are dealt out to trees of some thousand rows. In a tree all vectors get one more
component that brings them to the norm of its longest one, so that a large inner product with
an anchor is a small distance. A node covers the rows within its radius of its centre; radii
shrink by a fixed factor from level to level. The distance of an anchor to a centre and the
radius bound the inner products below a node from both sides.

Anchors meet a tree in blocks. Nodes are opened best bound first. A node is skipped by an anchor
if no window of it reaches into the node's bounds, if the best rows found so far are better, or
if all its rows have the wrong label. What is left is verified on whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TREE_ROWS = 2048  # candidates of a tree, on average
BLOCK_ANCHORS = 512  # anchors that meet a tree at once, on average
LEAF_ROWS = 16  # nodes of so few rows are not divided
BUNDLE_ROWS = 256  # small nodes are verified so many rows at a time
SHRINK = 1.3
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
_LEAST = np.iinfo(np.int64).min

POINT_SCHEMA = "tree bigint, place int, id bigint, label bigint, v array<double>, ends array<int>, radii array<double>"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which no inner product notices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(column), max(1, lengths.max(initial=0))))
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = column.flatten().to_numpy()
    return out


def _widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of vectors of whole numbers, exactly."""
    most = np.sqrt((a**2).sum(1).max(initial=0) * (b**2).sum(1).max(initial=0))
    if most < 2**52:
        return (a @ b.T).astype(np.int64)
    if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**53:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("inner products beyond 64 bits")


def cover_tree(vectors: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    """The rows in the order of the tree and, for each, the nodes that it is the centre of, from
    the widest: where a node ends (it begins at its centre) and its radius."""
    squares = (vectors**2).sum(1)
    extra = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    space = np.c_[vectors, extra]

    def distances(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((space[rows] - space[centre]) ** 2).sum(1))

    order: list[int] = []
    ends: dict[int, list[int]] = {}
    radii: dict[int, list[float]] = {}
    if not len(vectors):
        return np.zeros(0, np.int64), [], []
    rows = np.arange(len(vectors))
    # (rows with the centre first, their distances to it); children are put in reverse.
    todo = [(rows, distances(rows, 0))]
    while todo:
        rows, away = todo.pop()
        centre, radius = int(rows[0]), float(away.max())
        own = ends.setdefault(centre, [])
        begin = len(order) - (1 if own else 0)  # a centre is placed with its widest node
        own.append(begin + len(rows))
        radii.setdefault(centre, []).append(radius)
        if len(own) == 1:
            order.append(centre)
        if len(rows) <= LEAF_ROWS or radius == 0:
            order.extend(rows[1:].tolist())
            for row in rows[1:].tolist():
                ends.setdefault(row, [])
                radii.setdefault(row, [])
            continue
        near = away <= radius / SHRINK
        children = [(rows[near], away[near])]
        rest = rows[~near]
        while len(rest):
            to = distances(rest, int(rest[0]))
            taken = to <= radius / SHRINK
            children.append((rest[taken], to[taken]))
            rest = rest[~taken]
        todo.extend(reversed(children))
    order_array = np.array(order)
    return order_array, [ends[r] for r in order], [radii[r] for r in order]


def _build(table: pa.Table) -> pa.Table:
    vectors = _matrix(table.column("v"))
    order, ends, radii = cover_tree(vectors)
    rows = table.take(pa.array(order))
    return pa.table({
        "tree": rows.column("tree"),
        "place": pa.array(np.arange(len(order), dtype=np.int32)),
        "id": rows.column("id"),
        "label": rows.column("label"),
        "v": rows.column("v"),
        "ends": pa.array(ends, pa.list_(pa.int32())),
        "radii": pa.array(radii, pa.list_(pa.float64())),
    })


class _Tree:
    """A tree read back: its nodes with their children."""

    def __init__(self, points: pa.Table):
        points = points.sort_by("place")
        self.vectors = _matrix(points.column("v"))
        self.ids = points.column("id").to_numpy()
        self.labels = points.column("label").to_numpy()
        self.largest = (self.vectors**2).sum(1).max(initial=0)
        ends, radii = points.column("ends").to_pylist(), points.column("radii").to_pylist()
        begin, end, radius, first = [], [], [], []
        for place, (own, wide) in enumerate(zip(ends, radii)):
            first.append(len(begin))
            begin += [place] * len(own)
            end += own
            radius += wide
        first.append(len(begin))
        self.begin, self.end, self.radius = np.array(begin), np.array(end), np.array(radius)
        # The labels below a node, as the smallest and the largest.
        self.low = np.array([self.labels[b:e].min() for b, e in zip(begin, end)])
        self.high = np.array([self.labels[b:e].max() for b, e in zip(begin, end)])
        self.first = first

    def children(self, node: int) -> np.ndarray:
        """The nodes that a node is divided into; none if it is not."""
        place = int(self.begin[node])
        if node + 1 == self.first[place + 1]:
            return np.zeros(0, np.int64)
        found, at, end = [node + 1], int(self.end[node + 1]), int(self.end[node])
        while at < end:
            found.append(self.first[at])
            at = int(self.end[self.first[at]])
        return np.array(found)

    def divided(self, node: int) -> bool:
        return node + 1 < self.first[int(self.begin[node]) + 1]


def search(
    tree: _Tree,
    anchors: np.ndarray,
    ids: np.ndarray,
    labels: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    limit: int,
    same: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window the best rows of the tree: scores and ids (anchor x window x
    limit), the least number where there are fewer. A row's label is the anchor's if ``same``,
    else another; an anchor's own id is never found."""
    width = max(anchors.shape[1], tree.vectors.shape[1])
    anchors, vectors = _widened(anchors, width), _widened(tree.vectors, width)
    n, windows = low.shape
    scores = np.full((n, windows, limit), _LEAST)
    best = np.full((n, windows, limit), _LEAST)
    sizes = (anchors**2).sum(1) + tree.largest
    slack = 1e-9 * sizes + 1e-6

    def alive(who: np.ndarray, under: np.ndarray, over: np.ndarray) -> np.ndarray:
        """Which anchors may find something between the bounds; bounds are anchor x node."""
        out = np.zeros(over.shape, bool)
        for w in range(windows):
            floor = np.maximum(low[who, w], scores[who, w, -1])[:, None]
            out |= (over >= floor) & (under <= high[who, w][:, None])
        return out

    def bounds(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = anchors[who] @ vectors[tree.begin[nodes]].T
        size = sizes[who][:, None]
        away = np.sqrt(np.maximum(size - 2 * near, 0))
        radius = tree.radius[nodes]
        over = (size - np.maximum(away - radius, 0) ** 2) / 2 + slack[who][:, None]
        under = (size - (away + radius) ** 2) / 2 - slack[who][:, None]
        return under, over

    def fits(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        lowest, highest, own = tree.low[nodes], tree.high[nodes], labels[who][:, None]
        if same:
            return (lowest <= own) & (own <= highest)
        return (lowest != own) | (highest != own)

    def verify(who: np.ndarray, rows: np.ndarray) -> None:
        exact = products(anchors[who], vectors[rows])
        right = (tree.labels[rows] == labels[who][:, None]) == same
        right &= tree.ids[rows] != ids[who][:, None]
        for w in range(windows):
            floor = np.maximum(low[who, w], scores[who, w, -1])[:, None]
            wanted = right & (exact >= floor) & (exact <= high[who, w][:, None])
            some = np.flatnonzero(wanted.any(1))
            if not len(some):
                continue
            columns = np.flatnonzero(wanted[some].any(0))
            pick = np.ix_(some, columns)
            at = who[some]
            all_scores = np.concatenate([scores[at, w], np.where(wanted[pick], exact[pick], _LEAST)], 1)
            named = np.where(wanted[pick], tree.ids[rows][columns][None, :], _LEAST)
            all_ids = np.concatenate([best[at, w], named], 1)
            # Scores downwards (~x turns the order of whole numbers round), then ids upwards.
            first = np.lexsort((all_ids, ~all_scores), axis=1)[:, :limit]
            scores[at, w] = np.take_along_axis(all_scores, first, 1)
            best[at, w] = np.take_along_axis(all_ids, first, 1)

    heap: list[tuple] = []
    number = count()

    def push(who: np.ndarray, nodes: np.ndarray, open_it: bool) -> None:
        under, over = bounds(who, nodes)
        keep = alive(who, under, over) & fits(who, nodes)
        if open_it:
            for k, node in enumerate(nodes.tolist()):
                some = np.flatnonzero(keep[:, k])
                if len(some):
                    entry = (who[some], nodes[k : k + 1], under[some, k : k + 1], over[some, k : k + 1])
                    heapq.heappush(heap, (-over[some, k].max(), next(number), True, entry))
            return
        used = keep.any(0)
        nodes, under, over = nodes[used], under[:, used], np.where(keep, over, -np.inf)[:, used]
        if not len(nodes):
            return
        # Small nodes go in bundles, the best first.
        order = np.argsort(-over.max(0), kind="stable")
        total = np.cumsum((tree.end - tree.begin)[nodes[order]]) - 1
        for part in np.split(order, np.flatnonzero(np.diff(total // BUNDLE_ROWS)) + 1):
            entry = (who, nodes[part], under[:, part], over[:, part])
            heapq.heappush(heap, (-over[:, part].max(), next(number), False, entry))

    if len(tree.vectors) and n:
        root = np.zeros(1, np.int64)
        push(np.arange(n), root, tree.divided(0))
    while heap:
        _, _, open_it, (who, nodes, under, over) = heapq.heappop(heap)
        still = alive(who, under, over)
        some = np.flatnonzero(still.any(1))
        if not len(some):
            continue
        who = who[some]
        if open_it:
            children = tree.children(int(nodes[0]))
            inner = np.array([tree.divided(c) for c in children.tolist()])
            for kind in (True, False):
                if (inner == kind).any():
                    push(who, children[inner == kind], kind)
        else:
            nodes = nodes[still.any(0)]
            rows = np.concatenate([np.arange(tree.begin[k], tree.end[k]) for k in nodes])
            verify(who, rows)
    return scores, best


def prepared(
    embeddings: DataFrame, id_column: str, vector_column: str, label_column: str, scale: float
) -> DataFrame:
    """(id, label, v): the rows that take part, their components as floor(scale * x)."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(
        F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label_column}`").isNotNull() & F.coalesce(finite, F.lit(False))
    )
    whole = F.transform(vector, lambda x: F.floor(x * scale).cast("double"))
    return rows.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{label_column}`").cast("bigint").alias("label"),
        whole.alias("v"),
    ).distinct()


def _met(trees: DataFrame, anchors: DataFrame, n_trees: int, n_blocks: int, limit: int, same: bool) -> DataFrame:
    """(anchor, window, id, score): the best rows of every tree for every anchor and window."""

    def meet(points: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("anchor", pa.int64()), ("mark", pa.int64()), ("window", pa.int32()),
                            ("id", pa.int64()), ("score", pa.int64())])
        if not points.num_rows or not asked.num_rows:
            return schema.empty_table()
        windows = np.diff(asked.column("low").combine_chunks().offsets.to_numpy()).max(initial=0)

        def bound(name: str, without: int) -> np.ndarray:
            out = np.full((asked.num_rows, windows), without)
            for k, values in enumerate(asked.column(name).to_pylist()):
                out[k, : len(values)] = values
            return out

        # Where an anchor has fewer windows than another, nothing is both over and under.
        ids = asked.column("anchor").to_numpy()
        scores, best = search(
            _Tree(points), _matrix(asked.column("v")), ids, asked.column("label").to_numpy(),
            bound("low", np.iinfo(np.int64).max), bound("high", _LEAST), limit, same,
        )
        row, window, place = np.nonzero(best != _LEAST)
        return pa.table({
            "anchor": pa.array(ids[row]),
            "mark": asked.column("mark").take(pa.array(row)),
            "window": pa.array(window.astype(np.int32)),
            "id": pa.array(best[row, window, place]),
            "score": pa.array(scores[row, window, place]),
        }, schema)

    def over(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    keys = ["tree", "block"]
    points = trees.withColumn("block", over(n_blocks))
    asked = anchors.withColumn("block", F.pmod("mark", F.lit(n_blocks))).withColumn("tree", over(n_trees))
    return points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        meet, "anchor bigint, mark bigint, window int, id bigint, score bigint"
    )


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    scale: float = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. Scores are inner products of the vectors in whole
    numbers, floor(scale * x). A positive is one of the best rows of the anchor's label with
    another id; its negatives are the best rows of other labels that score from ``low_percent``
    to ``high_percent`` of it. Ties go to the smaller id. Rows without id, label or vector, or
    with a component that is null or not finite, take no part; a vector ends in zeros beside a
    longer one. Repeated rows count once; rows that share an id but differ all take part. An
    anchor without positives, or a positive without negatives, has no row, so an empty table
    gives none. Other columns are not read.
    """
    rows = prepared(embeddings, id_column, vector_column, label_column, scale)
    rows = materialize(rows, "vectors")
    marked = rows.where(is_anchor).select(
        F.col("id").alias("anchor"), F.xxhash64("id", "label", "v").alias("mark"), "label", "v"
    )
    n_rows, n_anchors = rows.count(), marked.count()
    n_trees, n_blocks = max(1, -(-n_rows // TREE_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("id", "label", "v"), F.lit(n_trees)))
    trees = materialize(dealt.groupBy("tree").applyInArrow(_build, POINT_SCHEMA), "trees")

    ends = (F.lit(-(2**62)), F.lit(2**62))
    everything = marked.withColumns({"low": F.array(ends[0]), "high": F.array(ends[1])})
    best = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id")
    alike = _met(trees, everything, n_trees, n_blocks, positives, True)
    alike = alike.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most ``positives`` rows of each anchor are gathered.
    per_anchor = alike.groupBy("anchor", "mark").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("alike")
    )
    per_anchor = materialize(per_anchor, "positives")
    windows = marked.join(per_anchor, ["anchor", "mark"]).withColumns({
        "low": F.transform("alike", lambda p: -F.floor(-p.positive_score * low_percent / F.lit(100).cast("decimal(3,0)")).cast("bigint")),
        "high": F.transform("alike", lambda p: F.floor(p.positive_score * high_percent / F.lit(100).cast("decimal(3,0)")).cast("bigint")),
    })
    found = _met(trees, windows.drop("alike"), n_trees, n_blocks, negatives, False)
    of = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).withColumn(
        "rank",
        F.row_number().over(Window.partitionBy("anchor", "mark", "window").orderBy(F.desc("negative_score"), "negative_id")),
    ).where(F.col("rank") <= negatives)
    positive = F.col("alike")[F.col("window")]
    return of.join(per_anchor, ["anchor", "mark"]).select(
        F.col("anchor").alias("anchor_id"),
        positive.positive_id.alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        positive.positive_score.alias("positive_score"),
        "negative_score",
    )


SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT vec_id AS anchor_id, label AS anchor_label, v AS anchor FROM given WHERE vec_id % 100 = 0),
parts AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM given),
asked AS (SELECT anchor_id, anchor_label, unnest(anchor) AS y, unnest(range(len(anchor))) AS i FROM anchors),
scored AS (
  SELECT anchor_id, anchor_label, vec_id, label, sum(x * y)::BIGINT AS score
  FROM asked JOIN parts ON parts.i = asked.i WHERE vec_id <> anchor_id GROUP BY ALL),
positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored
  WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
WHERE s.label <> p.anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
