"""Sharding by a k-d tree over the metadata of documents.

A node whose documents hold more than the target bytes is split at the weighted median, by
bytes, of the dimension in which the node is widest (its range as a share of that of all
documents). The top of the tree grows on the driver until a node's rows fit in a task: all
nodes of one depth are split by the same jobs, the extent of each node, then histograms of
bytes that close in on the medians. What reaches the driver is a few numbers for each of at
most about TOP nodes, never a document. Each node of the top then grows its own subtree in a
task, from its points, by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .columns import col, fresh

#: Bytes of text that a shard holds at most, but for documents that no dimension tells apart.
TARGET_BYTES = 32 << 20
#: Cells of all histograms of one round together; a node has 16 to 4096 bins of them.
CELLS = 1 << 18
#: Rows that a task grows a subtree from: ROWS, or more where the top had more than TOP nodes.
ROWS = 1 << 16
TOP = 1 << 14
#: Distinct values of a text dimension whose ranks are broadcast at most; more are joined by shuffling.
BROADCAST = 1_000_000
LOW = -(1 << 62)
DIMENSIONS = ("n_chars", "lang", "source", "doc_id")
DIMS = ("d0", "d1", "d2", "d3")


@dataclass
class Split:
    """A node of the tree: value <= at goes left; a leaf has a number instead."""

    dimension: int = -1
    at: int = 0
    left: int = -1
    right: int = -1
    shard: int = -1


def ranked(documents: DataFrame, name: str, rank: str) -> DataFrame:
    """documents with a column rank: the place of a text column's value among all its distinct
    values, in the order of their bytes; null for null.

    Two passes, as for global offsets: the values, sorted into ranges, are numbered within
    each, and the sizes of the ranges before it give the rest.
    """
    value, range_, place = fresh(documents, "value", "range", "place")
    own = documents.select(col(name).cast("string").alias(value)).where(F.col(value).isNotNull()).distinct()
    own = own.repartitionByRange(F.col(value)).sortWithinPartitions(value).select(value, F.spark_partition_id().alias(range_), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(place))
    own = written(own, "values")
    sizes = {r[0]: r[1] for r in own.groupBy(range_).count().collect()}
    before = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)])])
    offset = F.element_at(F.array(*[F.lit(int(n)) for n in before]), F.col(range_) + 1)
    table = own.select(value, (offset + F.col(place)).cast("long").alias(rank))
    table = F.broadcast(table) if before[-1] <= BROADCAST else table
    return documents.join(table, col(name).cast("string") == F.col(value), "left").drop(value)


def pointed(documents: DataFrame, text_col: str, id_col: str, names: list[str]) -> DataFrame:
    """documents with the metadata that the tree splits on, each as long, null as the lowest
    value, and the bytes of the text, under the given names: length in characters, ranks of
    language and source, id. A column that isn't there is null everywhere."""
    made = []
    for name, out in zip((*DIMENSIONS[:3], id_col), names):
        if name not in documents.columns:
            made.append(F.lit(LOW).cast("long"))
        elif name in DIMENSIONS[1:3]:
            (rank,) = fresh(documents, f"rank_{name}")
            documents = ranked(documents, name, rank)
            made.append(F.coalesce(F.col(rank), F.lit(LOW)))
        else:
            made.append(F.coalesce(col(name).cast("long"), F.lit(LOW)))
    size = F.coalesce(F.octet_length(col(text_col).cast("string")), F.lit(0)).cast("long")
    return documents.select("*", *[c.alias(n) for c, n in zip(made, names)], size.alias(names[4]))


def _walker(tree: list[Split]):
    """Row-wise descent of the tree: the number of the node that a point falls in."""
    dim, at = np.array([s.dimension for s in tree]), np.array([s.at for s in tree], np.int64)
    left, right = np.array([s.left for s in tree]), np.array([s.right for s in tree])

    @F.arrow_udf(T.LongType())
    def number(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return pa.array(_descend(np.stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)]), dim, at, left, right))

    return number


def _descend(points: np.ndarray, dim: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    node = np.zeros(points.shape[1], np.int64)
    while True:
        inner = np.flatnonzero(left[node] >= 0)
        if not len(inner):
            return node
        here = node[inner]
        node[inner] = np.where(points[dim[here], inner] <= at[here], left[here], right[here])


def _picker(tree: list[Split], lows: dict[int, int], highs: dict[int, int], count: int):
    """For a node and its point, the bin, of count, of the node's dimension between its bounds;
    null for what isn't being split, -1 below the bounds and count above."""

    @F.arrow_udf(T.IntegerType())
    def bins(node: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        n = node.to_numpy()
        points = np.stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)])
        top = max(int(n.max(initial=0)), max(lows, default=0)) + 1
        dim, low, high = np.full(top, -1), np.zeros(top, np.int64), np.zeros(top, np.int64)
        for k in lows:
            dim[k], low[k], high[k] = tree[k].dimension, lows[k], highs[k]
        open_ = dim[n] >= 0
        x, lo, hi = points[np.maximum(dim[n], 0), np.arange(len(n))], low[n], high[n]
        width = _width(lo, hi, count)
        found = np.where(x < lo, -1, np.where(x > hi, count, (np.clip(x, lo, hi).astype(np.uint64) - lo.astype(np.uint64)) // width))
        return pa.array(found.astype(np.int32), pa.int32(), mask=~open_)

    return bins


def _width(lo, hi, count: int):
    """Values in a bin, so that count bins cover lo to hi; exact for the whole range of long."""
    span = np.asarray(hi, np.int64).astype(np.uint64) - np.asarray(lo, np.int64).astype(np.uint64)
    return span // np.uint64(count) + np.uint64(1)


def _widest(lows: list[int], highs: list[int], inner: list[int | None], spread: list[int] | None) -> tuple[int, int, list[int]]:
    """The dimension in which a node is widest, its extent there, and the spread of all (that of
    the first node). inner: the least values but for null's."""
    # a null counts as next below the least value, whatever its own number is
    extent = [0 if h == LOW else h - (i - 1 if l == LOW else l) for l, h, i in zip(lows, highs, inner)]
    spread = spread or [max(e, 1) for e in extent]
    k = max(range(4), key=lambda k: (extent[k] / spread[k], -k))
    return k, extent[k], spread


def grow_top(points: DataFrame, target: int, rows: int) -> tuple[list[Split], set[int], list[int] | None]:
    """The top of the tree for points (d0..d3 long, bytes long), the leaves of it that are still
    to grow, of at most that many rows each, and the spread of all points."""
    tree, open_, spread = [Split()], set(), None
    frontier = [0]
    while frontier:
        node = _walker(tree)(*DIMS)
        stats = points.select(node.alias("node"), *DIMS, "bytes").groupBy("node").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(DIMS)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(DIMS)], *[F.min(F.when(F.col(c) > LOW, F.col(c))).alias(f"in{i}") for i, c in enumerate(DIMS)])
        of_interest = set(frontier)
        found = {r["node"]: r for r in stats.collect() if r["node"] in of_interest}
        lows, highs, half = {}, {}, {}
        for k in frontier:
            r = found.get(k)
            if r is None or (r["bytes"] or 0) <= target:
                continue
            i, extent, spread = _widest([r[f"lo{i}"] for i in range(4)], [r[f"hi{i}"] for i in range(4)], [r[f"in{i}"] for i in range(4)], spread)
            if not extent:
                continue  # nothing tells its documents apart
            if r["rows"] <= rows:
                open_.add(k)
                continue
            tree[k].dimension = i
            lows[k] = r[f"in{i}"] - 1 if r[f"lo{i}"] == LOW else r[f"lo{i}"]
            highs[k], half[k] = r[f"hi{i}"] - 1, r["bytes"] / 2
        for k, at in _medians(points.withColumn("node", node), tree, lows, highs, half).items():
            tree[k].at, tree[k].left, tree[k].right = at, len(tree), len(tree) + 1
            tree += [Split(), Split()]
        frontier = [x for k in lows for x in (tree[k].left, tree[k].right)]
    return tree, open_, spread


def _medians(points: DataFrame, tree: list[Split], lows: dict, highs: dict, half: dict) -> dict[int, int]:
    """For each node being split, the least value with half of the node's bytes at or below it,
    but below the node's largest value so that both sides hold documents."""
    lows, highs, out = dict(lows), dict(highs), {}
    while lows:
        for k in [k for k in lows if lows[k] >= highs[k]]:
            out[k] = lows.pop(k)
            highs.pop(k)
        if not lows:
            break
        count = min(4096, max(16, CELLS // len(lows)))
        bins = _picker(tree, lows, highs, count)("node", *DIMS)
        rows = points.select("node", bins.alias("bin"), "bytes").where("bin is not null").groupBy("node", "bin").agg(F.sum("bytes").alias("bytes")).collect()
        weights = {k: np.zeros(count + 2) for k in lows}
        for k, b, w in rows:
            weights[k][b + 1] += w
        for k, w in weights.items():
            below = np.cumsum(w)[: count + 1]
            b = int(np.argmax(below >= half[k])) if (below >= half[k]).any() else count
            b = min(max(b, 1), count) - 1
            width = int(_width(lows[k], highs[k], count))
            lows[k], highs[k] = min(lows[k] + b * width, highs[k]), min(lows[k] + (b + 1) * width - 1, highs[k])
    return out


def grow_arrays(points: np.ndarray, weights: np.ndarray, target: int, spread: list[int]) -> np.ndarray:
    """The subtree of (4 x n) points as rows (dimension, at, left, right, leaf number from 0), the root first."""
    tree, leaves = [[-1, 0, -1, -1, -1]], 0
    stack = [(0, np.arange(points.shape[1]))]
    while stack:
        k, rows = stack.pop()
        own, total, widest = points[:, rows], int(weights[rows].sum()), (0, 0)
        if total > target:
            real = np.where(own > LOW, own, np.iinfo(np.int64).max).min(1)
            widest = _widest([int(x) for x in own.min(1)], [int(x) for x in own.max(1)], [int(x) for x in real], spread)
        if not widest[1]:
            tree[k][4], leaves = leaves, leaves + 1
            continue
        x = own[widest[0]]
        order = np.argsort(x, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(x[order]) != 0, True))
        below = np.cumsum(weights[rows][order])[ends]
        b = min(int(np.argmax(below >= total / 2)), len(ends) - 2)
        at = int(x[order[ends[b]]])
        tree[k][:4] = [widest[0], int(real[widest[0]]) - 1 if at == LOW else at, len(tree), len(tree) + 1]
        tree += [[-1, 0, -1, -1, -1], [-1, 0, -1, -1, -1]]
        left = x <= at
        stack += [(len(tree) - 1, rows[~left]), (len(tree) - 2, rows[left])]
    return np.array(tree, np.int64)


def _grower(target: int, spread: list[int]):
    """Points sorted by node to (node, tree, leaves)."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(node: int, held: list[np.ndarray]) -> pa.RecordBatch:
            own = np.concatenate(held, 1)
            tree = grow_arrays(own[:4], own[4], target, spread)
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([tree.tobytes()], pa.binary()), pa.array([int(tree[:, 4].max()) + 1])], ["node", "tree", "leaves"])

        held, current = [], None
        for batch in batches:
            nodes, own = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in range(1, 6)]) if batch.num_rows else None
            for lo, hi in _spans(nodes):
                if current is not None and nodes[lo] != current:
                    yield emit(current, held)
                    held = []
                current = int(nodes[lo])
                held.append(own[:, lo:hi].copy())
        if held:
            yield emit(current, held)

    return grow


def _spans(nodes: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1])) if len(nodes) else []
    return zip(cut, [*cut[1:], len(nodes)])


def sharded(documents: DataFrame, target: int, text_col: str, id_col: str, keep: list[str], shard: str, size: str) -> DataFrame:
    """The columns keep of documents, with the number of each row's shard and the bytes of its text."""
    names = fresh([*documents.columns, shard, size], *DIMS, "bytes", "node", "tree", "kind")
    made = pointed(documents, text_col, id_col, names[:5])
    points = written(made.select(*[F.col(n).alias(o) for n, o in zip(names, (*DIMS, "bytes"))]), "points")
    rows = max(ROWS, -(-points.count() // TOP))
    top, open_, spread = grow_top(points, target, rows)
    node, tree, kind = names[5:]
    number = _walker(top)
    growing = lambda c: F.col(c).isin(sorted(open_)) if len(open_) < 500 else _among(open_)(c)
    grown = written(points.withColumn("node", number(*DIMS)).where(growing("node")).repartition("node").sortWithinPartitions("node").select("node", *DIMS, "bytes").mapInArrow(_grower(target, spread), "node long, tree binary, leaves long"), "subtrees") if open_ else None
    count = {r[0]: r[1] for r in grown.select("node", "leaves").collect()} if open_ else {}
    first, n, stack = np.zeros(len(top), np.int64), 0, [0]
    while stack:
        k = stack.pop()
        if top[k].left < 0:
            first[k], n = n, n + count.get(k, 1)
        else:
            stack += [top[k].right, top[k].left]

    @F.arrow_udf(T.LongType())
    def number_of(nodes: pa.Array) -> pa.Array:
        return pa.array(first[nodes.to_numpy()])

    placed = made.withColumn(node, number(*names[:4]))
    columns = [col(c) for c in keep]
    closed = placed.where(~growing(node)) if open_ else placed
    out = closed.select(*columns, number_of(F.col(node)).alias(shard), F.col(names[4]).alias(size))
    if not open_:
        return out
    inner = placed.where(growing(node))
    # each node's subtree comes before its rows, which are walked down it as they pass
    body = inner.select(F.col(node), F.lit(1).alias(kind), F.lit(None).cast("binary").alias(tree), *[F.col(c) for c in names[:5]], *columns)
    head = grown.select(F.col("node").alias(node), F.lit(0).alias(kind), F.col("tree").alias(tree), *[F.lit(0).cast("long").alias(c) for c in names[:5]], *[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in keep])
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for c in keep for f in [documents.schema[c]]], T.StructField(shard, T.LongType()), T.StructField(size, T.LongType())])
    spread_ = head.union(body).repartition(node).sortWithinPartitions(node, kind)
    return out.union(spread_.mapInArrow(_placer(first, [*keep, shard, size]), kinds))


def _among(nodes: set[int]):
    own = np.zeros(max(nodes) + 1, bool)
    own[list(nodes)] = True

    @F.arrow_udf(T.BooleanType())
    def among(n: pa.Array) -> pa.Array:
        n = n.to_numpy()
        return pa.array((n < len(own)) & own[np.minimum(n, len(own) - 1)])

    return among


def _placer(first: np.ndarray, names: list[str]):
    """Rows (node, kind, tree, d0..d3, bytes, others) sorted by node, its subtree first, to (others, shard, bytes)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for lo, hi in _spans(nodes):
                if batch.column(1)[lo].as_py() == 0:
                    tree = np.frombuffer(batch.column(2)[lo].as_py(), np.int64).reshape(-1, 5)
                    lo += 1
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                at = _descend(np.stack([part.column(i).to_numpy() for i in range(3, 7)]), *tree.T[:4])
                yield pa.RecordBatch.from_arrays([*part.columns[8:], pa.array(first[nodes[lo]] + tree[at, 4]), part.column(7)], names)

    return place


def assign_shards(documents: DataFrame, target: int = TARGET_BYTES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, bytes) for every row of documents; shards are numbered from 0 in the order of the tree.

    bytes are those of the text in UTF-8, 0 for a null or empty text. A null in a metadata
    column counts as lower than every value; a missing column as null everywhere. Rows with
    equal metadata, repeated rows too, share a shard, which may then exceed target, and so does
    a document that is longer by itself. A null doc_id stays null; an empty table gives an empty
    result. Other columns are left aside, whatever their names.
    """
    own = documents.select(col(id_col).alias("doc_id"), *[col(c) for c in dict.fromkeys((*DIMENSIONS[:3], text_col)) if c in documents.columns and c != id_col])
    text = text_col if text_col != id_col else "doc_id"
    return sharded(own, target, text, "doc_id", ["doc_id"], "shard", "bytes")


def write_shards(documents: DataFrame, path: str, target: int = TARGET_BYTES, text_col: str = "text", id_col: str = "doc_id") -> str:
    """documents written to path in one folder per shard, with all their rows and columns; gives
    the name of the folders' column: shard, with underscores before it where documents have such
    a column already.

    Shards are those of assign_shards(), which says what nulls, ties and repeated rows do; an
    empty table writes no folder.
    """
    shard, size = fresh(documents, "shard", "bytes")
    sharded(documents, target, text_col, id_col, documents.columns, shard, size).drop(size).repartition(shard).write.partitionBy(shard).parquet(path)
    return shard
