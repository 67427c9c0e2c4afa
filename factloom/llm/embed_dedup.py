"""Embedding near-duplicates: an exact metric range join, and the classes that its pairs make.

On unit vectors a cosine of COSINE or more is a distance of at most a radius r. A sample of
pivots parts the space: each vector lies in the cell of its nearest pivot. For x in cell i and
y in cell j at a distance of at most r, the triangle inequality gives
d(x, pj) <= d(x, pi) + 2r and d(x, pj) <= (radius of cell j) + r; and since y lies on the other
side of the plane halfway between pi and pj, x is at most r away from that plane. So x goes to
its own cell and, as a guest, to the cells j > i that meet all three; every pair then meets in
exactly one cell, and the cells join on their own. A cell of more rows than a task should hold is
joined in squares of blocks, and what a task has is split once more in the way of the cells.
Candidates are found in single precision with a margin and decided in double.

classes() needs no table of pairs: a cell gives for each of its vectors the number of its links
there, and edges that connect what its pairs connect. Equal vectors of a cell are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .minhash import connected
from .vectors import dimension_of, lists_of, matrix, sampled, unit, usable

#: Cosine from which two vectors are near-duplicates.
COSINE = 0.95
#: Vectors that a cell holds on average, while the pivots, which every task gets, have no more
#: than PIVOT_BYTES; beyond, cells grow.
CELL = 4096
PIVOT_BYTES = 32 << 20
#: Rows of a block; larger cells are joined block by block.
ROWS = 1 << 16
#: Rows compared at once.
BLOCK = 1024
MARGIN = 1e-4
#: Pivots nearer than this have no plane between them that would part anything.
NEAR = 1e-3


def _reaches(x: np.ndarray, pivots: np.ndarray, own: np.ndarray, radius: float, extent: np.ndarray) -> np.ndarray:
    """(rows x pivots): whether a vector in the pivot's cell may lie within radius of the row.

    Unit vectors in double: in single precision the distance of near pivots is lost in rounding.
    """
    cosine = x @ pivots.T
    d = np.sqrt(np.maximum(2 - 2 * cosine, 0))
    mine = np.take_along_axis(d, own[:, None], 1)
    between = np.sqrt(np.maximum(2 - 2 * pivots[own] @ pivots.T, 1e-12))
    plane = (np.take_along_axis(cosine, own[:, None], 1) - cosine) / between
    return (d <= mine + 2 * radius + MARGIN) & (d <= extent + radius + MARGIN) & ((plane <= radius + MARGIN) | (between < NEAR))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cosine = x @ pivots.T
    own = cosine.argmax(1)
    return own, np.sqrt(np.maximum(2 - 2 * np.take_along_axis(cosine, own[:, None], 1)[:, 0], 0))


def _apart(pivots: np.ndarray) -> np.ndarray:
    """The pivots less those nearer than NEAR to an earlier one."""
    near = np.triu(2 - 2 * pivots @ pivots.T < NEAR * NEAR, 1)
    return pivots[~near.any(0)]


def _block_pairs(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(0, len(a), BLOCK):
        for j in range(i if same else 0, len(b), BLOCK):
            found = a[i : i + BLOCK] @ b[j : j + BLOCK].T
            x, y = np.nonzero(found >= cosine - MARGIN)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + i, y + j, found[x, y] >= cosine + MARGIN


def cell_pairs(own: np.ndarray, guests: np.ndarray, cosine: float, depth: int = 0, inner: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs of rows of own with each other, if inner, and with guests (whose numbers go
    on after own's), and whether they are sure: a block of rows with a block at a time."""
    n = len(own)
    if n > 4 * BLOCK and depth < 8:
        all_ = np.concatenate([own, guests])
        radius = np.sqrt(2 - 2 * cosine)
        pivots = _apart(unit(own[:: max(1, n // 16)][:16]))
        blocks = [slice(i, i + BLOCK) for i in range(0, len(all_), BLOCK)]
        cell, d = (np.concatenate(x) for x in zip(*(_nearest(unit(all_[b]), pivots) for b in blocks)))
        extent = np.array([d[:n][cell[:n] == j].max(initial=0) for j in range(len(pivots))])
        reach = np.concatenate([_reaches(unit(all_[b]), pivots, cell[b], radius, extent) for b in blocks])
        members = np.bincount(cell[:n], minlength=len(pivots))
        # worth it only if the cells' work is clearly less than the whole's
        if members @ reach.sum(0) < 0.7 * n * len(all_):
            for j in range(len(pivots)):
                mine = np.flatnonzero(cell[:n] == j)
                other = np.flatnonzero(reach[:, j] & np.where(np.arange(len(all_)) < n, inner & (cell < j), True))
                if len(mine):
                    where = np.concatenate([mine, other])
                    for x, y, sure in cell_pairs(own[mine], all_[other], cosine, depth + 1, inner):
                        yield where[x], where[y], sure
            return
    if inner:
        yield from _block_pairs(own, own, cosine, True)
    for x, y, sure in _block_pairs(own, guests, cosine, False):
        yield x, y + n, sure


def join_cell(own: np.ndarray, guests: np.ndarray, cosine: float, depth: int = 0, inner: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of cell_pairs(), all at once."""
    found = [(x, y) for x, y, _ in cell_pairs(own, guests, cosine, depth, inner)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _assigner(pivots: np.ndarray, radius: float, extent: np.ndarray | None):
    """Vectors (id, v, twice) to (cell, guest, id, twice, v); without extents, only to their own cell's distance."""

    step = max(16, min(BLOCK, (1 << 20) // max(1, len(pivots))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids, v = batch.column(0).slice(at, step), matrix(batch.column(1).slice(at, step))
                x = unit(v)
                own, d = _nearest(x, pivots)
                if extent is None:
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(d)], ["cell", "d"])
                    continue
                row, cell = np.nonzero(_reaches(x, pivots, own, radius, extent) & (np.arange(len(pivots)) > own[:, None]))
                row, cell = np.concatenate([np.arange(len(x)), row]), np.concatenate([own, cell])
                guest = np.arange(len(row)) >= len(x)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(guest.astype(np.int32)), ids.take(pa.array(row)), batch.column(2).slice(at, step).take(pa.array(row)), lists_of(v[row])], ["cell", "guest", "id", "twice", "v"])

    return assign


def _squared(placed: DataFrame, most: int) -> DataFrame:
    """(cell, guest, id, twice, v) to (cell, i, j, guest, id, twice, v): a cell of more than ROWS rows becomes a
    square of blocks, by a hash of the id. Cell (i, j) joins the members of block i with all rows of
    block j: a member goes to its row of the square, and as a guest to what lies above it in its
    column; a guest to the whole of its column. Two blocks of members so meet once. No cell has
    more than most rows."""
    sizes = placed.groupBy("cell").count().where(F.col("count") > ROWS)
    large = {r["cell"]: -(-r["count"] // ROWS) for r in sizes.collect()} if most > ROWS else {}  # a row a cell at most
    zero = F.lit(0)
    if not large:
        return placed.select("cell", zero.alias("i"), zero.alias("j"), "guest", "id", "twice", "v")
    blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("cell")], F.lit(1))
    own = placed.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = own.where("guest = 0").select("cell", F.col("b").alias("i"), F.col("k").alias("j"), "guest", "id", "twice", "v")
    columns = own.where("guest = 1 or k < b").select("cell", F.col("k").alias("i"), F.col("b").alias("j"), F.lit(1).alias("guest"), "id", "twice", "v")
    return rows.unionByName(columns)


def _by_cell(handle):
    """Rows sorted by cell and square, members first, to what handle makes of each cell's
    (guest, id, twice, v) and of whether its members meet each other there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            cells = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cut = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(1))) if len(cells) else []
            for lo, hi in zip(cut, [*cut[1:], len(cells)]):
                here = tuple(cells[lo])
                if current is not None and here != current:
                    yield from handle(*(np.concatenate(x) for x in zip(*held)), current[1] == current[2])
                    held = []
                current = here
                part = batch.slice(lo, hi - lo)
                held.append((*(part.column(k).to_numpy().copy() for k in (3, 4, 5)), matrix(part.column(6)).copy()))
        if held:
            yield from handle(*(np.concatenate(x) for x in zip(*held)), current[1] == current[2])

    return run


def _decided(x: np.ndarray, n: int, cosine: float, inner: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors, the first n of which are members, whose cosine is at least cosine."""
    single = x.astype(np.float32)
    for a, b, sure in cell_pairs(single[:n], single[n:], cosine, 0, inner):
        open_ = np.flatnonzero(~sure)
        for i in range(0, len(open_), 65536):
            o = open_[i : i + 65536]
            sure[o] = (x[a[o]] * x[b[o]]).sum(1) >= cosine
        yield a[sure], b[sure]


def _joiner(cosine: float):
    """Cells to pairs of ids."""

    def pairs(guest: np.ndarray, ids: np.ndarray, twice: np.ndarray, v: np.ndarray, inner: bool) -> Iterator[pa.RecordBatch]:
        for a, b in _decided(unit(v), int((guest == 0).sum()), cosine, inner):
            low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(low[low < high]), pa.array(high[low < high])], ["vec_a", "vec_b"])

    return _by_cell(pairs)


def _unite(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of each a and b; least has for each number the least of its group."""
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while ((further := least[least]) != least).any():
            least[:] = further


def _linker(cosine: float):
    """Cells to (kind, a, b, n): edges (0) that connect what the cell's pairs connect; the number n
    of links of a to ids that have one vector (1); links of ids that have several (2), one by one."""

    def emit(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 1 << 18):
            own = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[own]), kind, np.int32)), *(pa.array(x[own].astype(np.int64)) for x in (a, b, n))], ["kind", "a", "b", "n"])

    def links(guest: np.ndarray, ids: np.ndarray, twice: np.ndarray, v: np.ndarray, inner: bool) -> Iterator[pa.RecordBatch]:
        # repeated rows go, and equal vectors are compared once, members and guests apart
        v = v + np.float32(0)  # no negative zeros
        raw = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize)))[:, 0]
        _, kind = np.unique(raw, return_inverse=True)
        rows = np.unique(np.stack([guest, kind, ids], 1), axis=0, return_index=True)[1]
        guest, ids, twice, v, kind = (x[rows] for x in (guest, ids, twice, v, kind))
        _, first, group = np.unique(np.stack([guest, kind], 1), axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        n, once = int((guest[first] == 0).sum()), twice == 0
        weight = np.bincount(group[once], minlength=len(first))
        several = np.bincount(group[~once], minlength=len(first)) > 0
        number, least = np.zeros(len(first), np.int64), np.arange(len(first))
        of = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=len(first)))[:-1]) if several.any() else []

        def spelled(p: int, q: int) -> Iterator[pa.RecordBatch]:
            a, b = of[p].repeat(len(of[q])), np.tile(of[q], len(of[p]))
            fine = (ids[a] != ids[b]) & ~(once[a] & once[b])
            yield from emit(2, ids[a[fine]], ids[b[fine]], ids[b[fine]])

        for a, b in _decided(unit(v[first]), n, cosine, inner):
            number += np.bincount(a, weight[b], len(first)).astype(np.int64) + np.bincount(b, weight[a], len(first)).astype(np.int64)
            _unite(least, a, b)
            for p, q in zip(*(x[several[a] | several[b]].tolist() for x in (a, b))):
                yield from spelled(p, q)
        # what is equal to a member is linked to it, where members meet each other
        mine = (guest == 0) & inner
        for p in np.flatnonzero(several[:n]) if inner else ():
            yield from spelled(p, p)
        found = number[group] + np.where(mine, weight[group] - 1, 0)
        told = once & (found > 0)
        yield from emit(1, ids[told], ids[told], found[told])
        speaker, tied = ids[first], np.bincount(least, minlength=len(first)) > 1
        # equal guests that no member is linked to are left to their own cell
        edge = (speaker[least[group]] != ids) & (mine | tied[least[group]])
        yield from emit(0, ids[edge], speaker[least[group]][edge], ids[edge])

    return _by_cell(links)


def range_join(vectors: DataFrame, cosine: float = COSINE, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: all pairs of vectors whose cosine is at least cosine, once each.

    Vectors that are null, of another length than most, zero, or hold a null, NaN or infinite
    number have no pairs, nor have rows without id. Repeated rows of one id count as one; an
    empty table gives an empty result. Other columns are left aside.
    """
    spark = vectors.sparkSession
    dimension = dimension_of(vectors, vector_col)
    if not dimension:
        return spark.createDataFrame([], "vec_a long, vec_b long")
    own = usable(vectors, vector_col, id_col, dimension).withColumn("twice", F.lit(0))
    if (squares := _cells(own, dimension, cosine)) is None:
        return spark.createDataFrame([], "vec_a long, vec_b long")
    return squares.mapInArrow(_joiner(cosine), "vec_a long, vec_b long").distinct()


def _cells(own: DataFrame, dimension: int, cosine: float) -> DataFrame | None:
    """(cell, i, j, guest, id, twice, v) of vectors (id, v, twice), each cell sorted in one task,
    members first; None without vectors."""
    count = own.count()
    pivots = sampled(own, min(max(1, PIVOT_BYTES // (8 * dimension)), -(-count // CELL)))
    if not len(pivots):
        return None
    radius = float(np.sqrt(2 - 2 * cosine))
    extent = np.zeros(len(pivots))
    for cell, d in own.mapInArrow(_assigner(pivots, radius, None), "cell int, d double").groupBy("cell").agg(F.max("d")).collect():
        extent[cell] = d
    placed = own.mapInArrow(_assigner(pivots, radius, extent), "cell int, guest int, id long, twice int, v array<float>")
    return _squared(placed, count).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "guest")


def classes(vectors: DataFrame, cosine: float = COSINE, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, class_id, links) for every id: links is the number of other ids that have a vector
    with a cosine of at least cosine to one of its own, class_id the least id of all that such links
    connect, its own if it has none.

    Vectors that are null, of another length than most, zero, or hold a null, NaN or infinite number
    have no links; rows without id are left aside. Repeated rows of one id count as one; an empty
    table gives an empty result. Other columns are left aside, whatever their names.
    """
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    alone = ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    dimension = dimension_of(vectors, vector_col)
    if not dimension:
        return alone
    own = usable(vectors, vector_col, id_col, dimension)
    twice = own.groupBy("id").agg(F.min(F.xxhash64("v")).alias("x"), F.max(F.xxhash64("v")).alias("y")).where("x <> y").select("id", F.lit(1).alias("twice"))
    own = own.withColumn("twice", F.lit(0)) if twice.isEmpty() else own.join(twice, "id", "left").select("id", "v", F.coalesce("twice", F.lit(0)).alias("twice"))
    if (squares := _cells(own, dimension, cosine)) is None:
        return alone
    linked = written(squares.mapInArrow(_linker(cosine), "kind int, a long, b long, n long"), "links")
    roots = connected(linked.where("kind = 0").select("a", "b"))
    spelled = linked.where("kind = 2").select("a", "b")
    spelled = spelled.unionByName(spelled.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("a").alias("vec_id"), F.lit(1).cast("long").alias("n"))
    links = linked.where("kind = 1").select(F.col("a").alias("vec_id"), "n").unionByName(spelled).groupBy("vec_id").agg(F.sum("n").alias("links"))
    out = ids.join(links, "vec_id", "left").join(roots.select(F.col("id").alias("vec_id"), "root"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, kept_vec_id) for every vector with a lower id among its near-duplicates: the lowest of them.

    Pairs are those of range_join(), which says which vectors have none: these don't occur, nor
    does a vector without a lower one. Repeated rows of one id count as one; an empty table gives
    an empty result. Other columns are left aside, whatever their names.
    """
    pairs = written(range_join(vectors, cosine, vector_col, id_col), "pairs")
    return pairs.groupBy(F.col("vec_b").alias("vec_id")).agg(F.min("vec_a").alias("kept_vec_id"))
