"""Exact top-k inner products of many queries by a search of cover trees over the data.

Rows are assigned to the nearest of at most MAX_CELLS centres, a sample of
rows (those with the smallest hash of their row). A cell's rows are dealt by
hash into blocks. A query is searched in one block of its own cell first, which
gives it a worst k-th score; then it goes to every block of the cells whose
bound reaches that score, and to no other. Blocks' answers are merged by query.

A task holds one block of data and up to QUERY_ROWS queries, and builds cover
trees over up to TREE_ROWS rows of the block each. A node's centre is one of
its points. A node at level l covers its points within BASE ** l; its
children's centres are its own centre and others, at distances over BASE ** (l - 1)
from each other, such that each point is within BASE ** (l - 1) of one; levels
at which a node would have no child but itself are skipped. The centres of a
cover are taken in batches, whose distances are matrix products. Many queries
walk a tree together. By Cauchy-Schwarz the scores of a query and a node's
points are at most

    <q, d> + |q| r_d

for the centre d and the covering radius r_d. A pair is pruned if that is under
the query's worst k-th score. While most pairs stay, a level is one matrix
product; when few do, each node is met by its own queries only. Scores are
integers, computed exactly as long as they fit 64 bits; narrower floats are
used where they hold every sum.

Vectors without structure (equal distances) make a tree of few levels, and no
cell can be pruned: every query meets every block, as in any exact search, so
that the work grows with queries times rows; trees are built once for
QUERY_ROWS queries.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do rows without an id; vectors are compared with those of
equal length only; candidates of a query are all rows whose id isn't the
query's, each for itself where ids repeat; rows that repeat a query's id and
vector are one query, and the answers of different vectors of one query id are
ranked together; equal scores go to the smaller id; a query with no other
vectors has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import lookup, written

#: Rows of a block and queries of a task, about (of up to WIDTH components, fewer of wider ones): they bound a task's memory.
BLOCK_ROWS = 8_192
QUERY_ROWS = 32_768
WIDTH = 128
#: Rows of a tree, queries that walk it together, and centres that a cover takes at once, at first and at most.
TREE_ROWS = 2_048
WALK_ROWS = 1_024
FIRST_BATCH, BATCH = 8, 64
#: Rows of a cell, about, and cells at most: their centres travel to every task.
CELL_ROWS = 8_192
MAX_CELLS = 2_048
#: A child covers within its parent's distance divided by this (small, since distances concentrate in many dimensions).
BASE = 1.25
#: Of the pairs of queries and nodes, the share from which on they are met in one product.
DENSE = 0.25
#: Queries' candidates in one product, on average, from which on the k-th best is sought first.
MANY = 64
EXACT_FLOAT, EXACT_SINGLE = 2.0**52, 2.0**24


class Node:
    """Places of queries and of data in the block's arrays, the centre's place, and the radius that covers them.

    Children cover within BASE ** level, and their centres are farther apart; level is None where there are none.
    """

    __slots__ = ("children", "level", "members", "n_queries", "place", "points", "radius")

    def __init__(self, points: np.ndarray, members: np.ndarray, n_queries: int, place: int, radius: float) -> None:
        self.points, self.members, self.n_queries, self.place, self.radius, self.level = points, members, n_queries, place, radius, None
        self.children: list[Node] = []

    @property
    def centre(self) -> np.ndarray:
        return self.points[self.place]

    @property
    def queries(self) -> np.ndarray:
        return self.members[self.members < self.n_queries]

    @property
    def data(self) -> np.ndarray:
        return self.members[self.members >= self.n_queries]


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(axis=1), 0.0))


def squares(points: np.ndarray) -> np.ndarray:
    """The squared lengths, without another array as large as points."""
    return np.einsum("ij,ij->i", points, points)


def fitting(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Points in the narrowest float that holds every sum of squared distances and of scores exactly, and their greatest squared length."""
    most = float(squares(points).max(initial=0.0))
    return (points.astype(np.float32) if 4 * most < EXACT_SINGLE and np.array_equal(points, np.rint(points)) else points), most


def squared(some: np.ndarray, points: np.ndarray, lengths: np.ndarray | None, of_some: np.ndarray | None) -> np.ndarray:
    """Squared distances; without lengths (squared, of sums that are exact) by differences."""
    if lengths is None:
        return np.array([((points - x) ** 2).sum(axis=1) for x in some])
    made = some @ points.T
    made *= -2
    made += lengths
    made += of_some[:, None]
    return made


def build(points: np.ndarray, n_queries: int) -> Node:
    """The cover tree over points, of which the first n_queries are queries.

    A node's cover is greedy: of the members farthest from all centres so far,
    those that are also apart from each other become the next ones, until none
    is farther than the children's distance.
    """
    narrow, most = fitting(points)
    exact = 4 * most < EXACT_FLOAT and np.array_equal(points, np.rint(points))
    lengths = squares(narrow) if exact else None
    everything = np.arange(len(points))
    away = ((points - points[0]) ** 2).sum(axis=1)
    root = Node(points, everything, n_queries, 0, float(np.sqrt(away.max())))
    open_nodes = [(root, everything, away)]
    while open_nodes:
        node, members, nearest = open_nodes.pop()
        if node.radius == 0.0:
            continue
        node.level = floor(log(node.radius, BASE))
        while BASE**node.level >= node.radius:
            node.level -= 1
        apart = BASE**node.level
        own, own_lengths = narrow[members], lengths[members] if exact else None
        places = [node.place]
        belongs, batch = np.zeros(len(members), np.int64), FIRST_BATCH
        while len(far := np.flatnonzero(np.sqrt(nearest) > apart)):
            far = far[np.argsort(-nearest[far], kind="stable")[:batch]]
            d = squared(own[far], own, own_lengths, own_lengths[far] if exact else None)
            free = np.sqrt(d[:, far].astype(np.float64)) > apart
            taken, left = [], np.ones(len(far), bool)
            for i in range(len(far)):
                if left[i]:
                    taken.append(i)
                    left &= free[i]
            d = d[taken]
            first = d.argmin(axis=0)
            least = d[first, np.arange(len(members))].astype(np.float64)
            closer = least < nearest
            nearest[closer], belongs[closer] = least[closer], len(places) + first[closer]
            places.extend(members[far[taken]].tolist())
            batch = min(2 * batch, BATCH)
        order = np.argsort(belongs, kind="stable")
        begins = np.searchsorted(belongs[order], np.arange(len(places)))
        members, nearest = members[order], nearest[order]
        radii = np.sqrt(np.maximum.reduceat(nearest, begins))
        for place, radius, begin, end in zip(places, radii.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            child = Node(points, members[begin:end], n_queries, place, radius)
            node.children.append(child)
            if radius:
                open_nodes.append((child, members[begin:end], nearest[begin:end]))
    return root


class Children:
    """A node's children for walks: inner ones, and the data of the leaves (equal points); places are those of their centres."""

    __slots__ = ("inner", "leaf_data", "places", "radii")

    def __init__(self, node: Node, offset: int) -> None:
        inner = [x for x in node.children if x.radius]
        self.inner = [Children(x, offset) for x in inner]
        self.places, self.radii = np.array([x.place + offset for x in inner], np.int64), np.array([x.radius for x in inner])
        leaves = [x.members for x in node.children if not x.radius] or [node.members] * (not node.children)
        self.leaf_data = np.concatenate([*leaves, np.empty(0, np.int64)]).astype(np.int64) + offset


def search(points: np.ndarray, ids: np.ndarray, n_queries: int, k: int, known: np.ndarray | None = None, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best data points of each query, -1 where there are fewer; both of shape (n_queries, k).

    known are scores that a query's k-th best is known to reach; lower ones may
    be left out. seen gets the numbers of pairs of a query and a node that were
    met and pruned.
    """
    low = np.iinfo(np.int64).min
    scores = np.full((n_queries, k), low, np.int64)
    found = np.full((n_queries, k), -1, np.int64)
    narrow, most = fitting(points)
    whole = None if most < EXACT_FLOAT else points.astype(np.int64)
    kind = narrow.dtype.type
    norms = np.sqrt(squares(points))
    slack = kind((16 + points.shape[1]) * np.finfo(kind).eps * (1.0 + 4 * most))
    floor_of = np.full(n_queries, low, np.int64) if known is None else known.astype(np.int64)
    shared = np.isin(ids, ids[:n_queries])
    seen = {} if seen is None else seen
    seen |= {"met": 0, "pruned": 0}

    def worst(q: np.ndarray) -> np.ndarray:
        return np.maximum(scores[q, k - 1], floor_of[q])

    def update(q: np.ndarray, d: np.ndarray) -> None:
        """Meets queries q with data d."""
        product = narrow[q] @ narrow[d].T if whole is None else whole[q] @ whole[d].T
        none = -np.inf if whole is None else low
        own = np.flatnonzero(shared[d])
        if len(own):
            some = product[:, own]
            some[ids[q][:, None] == ids[d[own]][None, :]] = none
            product[:, own] = some
        hits = product >= worst(q).astype(product.dtype)[:, None]
        if whole is not None:
            hits &= product > low
        some = np.count_nonzero(hits)
        if not some:
            return
        if some > max(MANY, k) * len(q):
            many = np.flatnonzero(np.count_nonzero(hits, axis=1) > max(MANY, k))
            some = product[many]
            least = np.partition(some, len(d) - k, axis=1)[:, len(d) - k]
            hits[many] &= some >= least[:, None]
        rows, cols = np.divmod(np.flatnonzero(hits), len(d))
        touched = np.unique(rows)
        all_rows = np.r_[rows, np.repeat(touched, k)]
        all_scores = np.r_[product[rows, cols].astype(np.int64), scores[q[touched]].ravel()]
        all_ids = np.r_[ids[d[cols]], found[q[touched]].ravel()]
        order = np.lexsort((all_ids, ~all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[order], all_scores[order], all_ids[order]
        starts = np.searchsorted(all_rows, touched)
        for j in range(k):
            scores[q[touched], j] = all_scores[starts + j]
            found[q[touched], j] = all_ids[starts + j]

    def walk(root: Children, q: np.ndarray) -> None:
        # nodes whose children come next, queries, and the bounds of their pairs
        stack = [([root], q, np.full((len(q), 1), np.inf, kind))]
        while stack:
            nodes, q, bounds = stack.pop()
            near = bounds >= worst(q).astype(kind)[:, None]
            some, kept = near.any(axis=1), near.any(axis=0)
            if not some.any():
                continue
            q, nodes = q[some], [x for x, keep in zip(nodes, kept.tolist(), strict=True) if keep]
            leaves = np.concatenate([x.leaf_data for x in nodes])
            seen["met"] += len(q) * len(leaves)
            for begin in range(0, len(leaves), TREE_ROWS):
                update(q, leaves[begin : begin + TREE_ROWS])
            places, radii = np.concatenate([x.places for x in nodes]), np.concatenate([x.radii for x in nodes]).astype(kind)
            if not len(places):
                continue
            inner = [x for node in nodes for x in node.inner]
            bounds = narrow[q] @ narrow[places].T
            bounds += np.outer(norms[q].astype(kind), radii)
            bounds += slack
            near = bounds >= worst(q).astype(kind)[:, None]
            met = int(np.count_nonzero(near))
            seen["met"] += near.size
            seen["pruned"] += near.size - met
            if met >= DENSE * near.size:
                stack.append((inner, q, bounds))
                continue
            first = np.flatnonzero(near.any(axis=0))
            for j in first[np.argsort(bounds[:, first].max(axis=0), kind="stable")].tolist():  # the best is taken next
                rows = np.flatnonzero(near[:, j])
                stack.append(([inner[j]], q[rows], bounds[rows, j : j + 1]))

    for begin in range(n_queries, len(points), TREE_ROWS):
        root = Children(build(points[begin : begin + TREE_ROWS], 0), begin)
        for start in range(0, n_queries, WALK_ROWS):
            walk(root, np.arange(start, min(start + WALK_ROWS, n_queries)))
    return scores, found


def _points(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, len(column[0])).astype(np.float64)


def _block(k: int):
    """One block's data and some queries (is_query, with the score that their k-th best is known to reach) to their best."""

    def run(table: pa.Table) -> pa.Table:
        is_query = np.asarray(table.column("is_query").to_numpy(zero_copy_only=False), bool)
        order = np.argsort(~is_query, kind="stable")
        ids, rows = table.column("vec_id").to_numpy()[order], table.column("row").to_numpy()[order]
        known = table.column("known").to_numpy()[order]
        n = int(is_query.sum())
        if not n or n == len(ids):
            return pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        scores, found = search(_points(table)[order], ids, n, k, known[:n])
        some = scores > np.iinfo(np.int64).min
        return pa.table({"query_row": np.repeat(rows[:n], k)[some.ravel()], "query_id": np.repeat(ids[:n], k)[some.ravel()], "vec_id": found[some], "score": scores[some]})

    return run


def _centred(centres: np.ndarray):
    """Rows with v to cell (the nearest centre) and away (the distance to it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (centres**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch)
            cell = (own - 2 * points @ centres.T).argmin(axis=1) if points.shape[1] else np.zeros(len(points), np.int64)
            away = distances(points, centres[cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _reaching(centres: np.ndarray, radii: np.ndarray):
    """Queries (row, vec_id, v, known) to a row for each other cell that may hold better scores than known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.linalg.norm(centres, axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch)
            length = np.linalg.norm(points, axis=1)
            bounds = points @ centres.T + np.outer(length, radii)
            slack = 1e-9 * (1.0 + np.outer(length, norms + np.maximum(radii, 0.0)))
            rows, cells = np.nonzero(bounds + slack >= batch.column("known").to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in batch.schema.names), pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


LOWEST = -(2**63)
_FOUND = "query_row long, query_id long, vec_id long, score long"


def for_width(rows: int, width: int) -> int:
    """So many rows of up to WIDTH components, or fewer of wider ones, an eighth at least."""
    return max(1, rows // 8, rows * WIDTH // max(width, WIDTH))


def _searched(data: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    """The best of queries (row, vec_id, v, known, cell, block) in the blocks named, as (query_row, query_id, vec_id, score).

    Queries of a block are dealt into parts, for each of which the block's rows go to one task.
    """
    parts = queries.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / for_width(QUERY_ROWS, width)).cast("int").alias("parts"))
    parts = lookup(written(parts, "parts"))
    asked = queries.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    held = data.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["cell", "block", "part", "row", "vec_id", "v"]
    both = held.select(*columns, F.lit(False).alias("is_query"), F.lit(LOWEST).cast("long").alias("known")).union(asked.select(*columns, F.lit(True), "known"))
    return written(both.groupBy("cell", "block", "part").applyInArrow(_block(k), _FOUND), "found")


def _of_width(rows: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) for rows (row, vec_id, v, is_query) of one length."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(max(1, min(MAX_CELLS, n // CELL_ROWS))).collect()
    centres = np.array([r["v"] for r in sample], np.float64)
    schema = "row long, vec_id long, v array<long>, is_query boolean, cell int, away double"
    celled = written(rows.select("row", "vec_id", "v", "is_query").mapInArrow(_centred(centres), schema), "cells")
    sizes = celled.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / for_width(BLOCK_ROWS, centres.shape[1])).cast("int").alias("blocks"))
    sizes = written(sizes, "cell_sizes")  # at most MAX_CELLS rows
    radii = np.full(len(centres), -1e300)  # of cells without rows, which the join with sizes drops
    for r in sizes.collect():
        radii[r["cell"]] = r["radius"]
    data = written(celled.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "data")
    queries = data.where("is_query").groupBy("vec_id", "v").agg(F.min(F.struct("row", "cell", "block")).alias("first")).select("first.*", "vec_id", "v")
    queries = written(queries.withColumn("known", F.lit(LOWEST).cast("long")), "queries")
    first = _searched(data, queries, k, centres.shape[1])
    known = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    seeded = queries.withColumnsRenamed({"cell": "home", "block": "home_block"}).drop("known").join(known.withColumnRenamed("query_row", "row"), "row", "left")
    seeded = seeded.select("row", "vec_id", "v", "home", "home_block", F.coalesce("least", F.lit(LOWEST).cast("long")).alias("known"))
    wide = seeded.mapInArrow(_reaching(centres, radii), "row long, vec_id long, v array<long>, home int, home_block int, known long, cell int")
    spread = wide.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    second = spread.where((F.col("cell") != F.col("home")) | (F.col("block") != F.col("home_block"))).select("row", "vec_id", "v", "known", "cell", "block")
    return first.union(_searched(data, written(second, "reaching"), k, centres.shape[1]))


def top_k(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all other rows.

    vectors' components become floor(scale * x). is_query marks the queries
    by the columns of vectors.
    """
    # when() keeps non-finite components away from floor(), which would not fit a long
    whole = F.when(usable(F.col(vector)), F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double"))))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null")
    rows = written(kept.withColumn("width", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    widths = [r["width"] for r in rows.where("is_query").select("width").distinct().orderBy("width").collect()]
    found = [_of_width(rows.where(F.col("width") == w), k) for w in widths]
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
