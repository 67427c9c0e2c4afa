"""Approximate nearest neighbours among all rows: lists by k-means, scanned with adaptive dimensions.

Vectors are rotated at random, so that any block of columns is a fair sample of a distance.
Within a probed list the candidates of a query are scanned block by block of columns; after
each block a hypothesis test on the partial distance abandons those that would hardly come
nearer than the query's k-th neighbour so far. How many lists a query probes is measured: the
least number for which the true neighbours of a sample of queries, found over all vectors, lie
in the probed lists as often as TARGET.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import U64, mix
from .vectors import dimension_of, lists_of, matrix, sampled, unit, usable

NEIGHBOURS = 10
#: Lists are the root of the number of vectors over this.
LISTS_DIVISOR = 8
ROUNDS = 4
#: Queries whose true neighbours set the number of probes, and the share of these to be reached.
SAMPLE = 256
TARGET = 0.97
#: Columns of a block, and how many deviations a partial distance must be beyond the bound.
BLOCK = 16
EPSILON = 1.5
#: Queries scanned together.
QUERIES = 256
#: Queries of a list that a task takes, or as many as the list has members if these are more.
PART = 4096
#: Share of candidates alive below which a scan goes on with these alone.
SPARSE = 0.15


def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def scan(members: np.ndarray, squares: np.ndarray, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, members nearer than its bound (squared distances), the k nearest and of
    equally near ones those of the least ids: query number, member number, squared distance.

    squares has the squared lengths of the members' blocks of columns, (blocks x members). Equal
    vectors have equal distances to the last bit.
    """
    dimension, n = members.shape[1], len(members)
    bound = bound.astype(np.float32).copy()
    partial = np.zeros((len(queries), n), np.float32)
    q, c, d = None, None, None
    for b, lo in enumerate(range(0, dimension, BLOCK)):
        hi = min(lo + BLOCK, dimension)
        own = queries[:, lo:hi]
        if q is None:
            partial += squares[b] + (own * own).sum(1)[:, None] - 2 * (own @ members[:, lo:hi].T)
        else:
            d += ((own[q] - members[c, lo:hi]) ** 2).sum(1)
        if hi == dimension:
            break
        if b == 0 and n > k:
            # the members that look nearest so far give a first bound of their own
            few = np.argpartition(partial, k - 1, axis=1)[:, :k]
            whole = ((members[few] - queries[:, None, :]) ** 2).sum(2)
            bound = np.minimum(bound, whole.max(1) * 1.00001 + 1e-6)
        most = bound * (hi / dimension) * (1 + EPSILON * np.sqrt((1 - hi / dimension) / hi)) ** 2
        if q is None:
            alive = partial <= most[:, None]
            if np.count_nonzero(alive) < SPARSE * alive.size:
                q, c = np.nonzero(alive)
                d = partial[q, c]
        else:
            alive = d <= most[q]
            q, c, d = q[alive], c[alive], d[alive]
    if q is None:
        q, c = np.nonzero(partial <= bound[:, None] * np.float32(1.00001) + np.float32(1e-5))
        d = partial[q, c]
    near = d <= bound[q] * np.float32(1.00001) + np.float32(1e-5)
    q, c = q[near], c[near]
    d = np.concatenate([np.zeros(0), *[((members[c[i : i + 65536]].astype(np.float64) - queries[q[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(q), 65536)]])
    order = np.lexsort((ids[c], d, q))
    q, c, d = q[order], c[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], c[keep], d[keep]


def _block_squares(members: np.ndarray) -> np.ndarray:
    return np.stack([(members[:, lo : lo + BLOCK] ** 2).sum(1) for lo in range(0, members.shape[1], BLOCK)])


def _summer(centres: np.ndarray):
    """One row per list: the sum of a partition's vectors in it, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = unit(matrix(batch.column(1).slice(at, 2048)))
                own = (x @ centres.T).argmax(1)
                np.add.at(sums, own, x)
                n += np.bincount(own, minlength=len(n))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(list(sums[has]), pa.list_(pa.float64())), pa.array(n[has])], ["list", "sums", "n"])

    return run


def _centres(own: DataFrame, lists: int, dimension: int) -> np.ndarray:
    """Unit centres by ROUNDS rounds of k-means over all vectors; a centre that loses all stays."""
    centres = sampled(own, lists)
    for _ in range(ROUNDS):
        summed = own.mapInArrow(_summer(centres), "list int, sums array<double>, n long").groupBy("list").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dimension)])
        for row in summed.collect():
            s = np.array(row[1:])
            if (length := np.sqrt(s @ s)) > 1e-9:
                centres[row[0]] = s / length
    return centres


def _truth(queries: np.ndarray, own_ids: np.ndarray, centres: np.ndarray, k: int):
    """A partition's best k for each sample query, with the list they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k), -2.0)
        where = np.full((len(queries), k), -1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, x = batch.column(0).slice(at, 2048).to_numpy(), unit(matrix(batch.column(1).slice(at, 2048)))
                lists = (x @ centres.T).argmax(1)
                c = queries @ x.T
                c[own_ids[:, None] == ids[None]] = -2
                both, place = np.concatenate([best, c], 1), np.concatenate([where, np.broadcast_to(lists, c.shape)], 1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best, where = np.take_along_axis(both, top, 1), np.take_along_axis(place, top, 1)
        q = np.repeat(np.arange(len(queries)), k)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(where.ravel()), pa.array(best.ravel())], ["q", "list", "c"])

    return run


def _probes(own: DataFrame, asked: DataFrame, centres: np.ndarray, k: int, sample: int, target: float) -> int:
    """The least number of lists, by nearness of their centres, that holds the share target of the
    true neighbours of a sample of the queries asked, found over all vectors."""
    rows = asked.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    ids, queries = rows["id"].to_numpy(), unit(matrix(rows["v"].combine_chunks()))
    found = own.mapInArrow(_truth(queries, ids, centres, k), "q int, list long, c double").where("list >= 0")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "list"))).where(F.col("n") <= k).select("q", "list").toArrow()
    place = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    needed = np.sort(place[ranked["q"].to_numpy(), ranked["list"].to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1


def _sizes(own: DataFrame, centres: np.ndarray) -> np.ndarray:
    """How many vectors are in each list."""
    sizes = np.zeros(len(centres), np.int64)
    for k, n in own.mapInArrow(_summer(centres), "list int, sums array<double>, n long").groupBy("list").agg(F.sum("n")).collect():
        sizes[k] = n
    return sizes


def _spreader(centres: np.ndarray, turn: np.ndarray, parts: np.ndarray, first: int, probes: int, with_members: bool, with_queries: bool):
    """Vectors to (list, part, query, id, bound, v): members of their list, copied to each of its
    parts, and queries of the probes from first on, each in one part of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                own = batch.slice(at, 2048)
                ids, x = own.column(0), unit(matrix(own.column(1)))
                bound = own.column(2).to_numpy() if own.num_columns > 2 else np.full(len(x), 5.0)
                c = x @ centres.T
                # in double first: equal vectors stay equal, whatever their place in the batch
                turned = (x @ turn).astype(np.float32)
                lists, part, rows, kinds = [], [], [], []
                if with_members:
                    home = c.argmax(1)
                    copies = parts[home]
                    rows.append(np.repeat(np.arange(len(x)), copies))
                    lists.append(np.repeat(home, copies))
                    part.append(np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
                    kinds.append(np.zeros(len(rows[-1]), np.int32))
                if with_queries and probes > first:
                    order = np.argsort(-c, axis=1, kind="stable")[:, first:probes]
                    rows.append(np.repeat(np.arange(len(x)), order.shape[1]))
                    lists.append(order.ravel())
                    part.append((mix(ids.to_numpy()[rows[-1]].view(U64)) % parts[lists[-1]].astype(U64)).astype(np.int64))
                    kinds.append(np.ones(order.size, np.int32))
                if lists:
                    row = np.concatenate(rows)
                    for lo in range(0, len(row), 8192):
                        r = slice(lo, lo + 8192)
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)[r].astype(np.int32)), pa.array(np.concatenate(part)[r].astype(np.int32)), pa.array(np.concatenate(kinds)[r]), ids.take(pa.array(row[r])), pa.array(bound[row[r]].astype(np.float64)), lists_of(turned[row[r]])], ["list", "part", "query", "id", "bound", "v"])

    return run


_ROW = "list int, part int, query int, id long, bound double, v array<float>"


def _scanner(k: int):
    """Rows sorted by list and part, members first, to neighbours (id, neighbour, d)."""

    def answer(members: list[tuple], queries: list[tuple]) -> pa.RecordBatch | None:
        if not members or not queries:
            return None
        ids, x, squares = members[0]
        q_ids, bound, q = (np.concatenate(y) for y in zip(*queries))
        out = []
        width = max(1, min(QUERIES, (1 << 22) // len(x)))
        for at in range(0, len(q), width):
            own = slice(at, at + width)
            # one more than k, for the query itself, and again one for each repeat of its row
            a, b, d = scan(x, squares, ids, q[own], bound[own], (k + 1) * (1 + _repeats(ids)))
            fine = q_ids[own][a] != ids[b]
            # of equal distances the rows of one id stand together; the first of them counts
            fine[1:] &= (a[1:] != a[:-1]) | (ids[b[1:]] != ids[b[:-1]]) | (d[1:] != d[:-1])
            a, b, d = a[fine], b[fine], d[fine]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            out.append((q_ids[own][a[place < k]], ids[b[place < k]], d[place < k]))
        a, b, d = (np.concatenate(y) for y in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["id", "neighbour", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, queries = None, [], []
        for batch in batches:
            lists, kinds = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy(), batch.column(2).to_numpy()
            key = lists * 2 + kinds
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else []
            for lo, hi in zip(cut, [*cut[1:], len(key)]):
                if lists[lo] != current:
                    if (got := answer(_packed(members), queries)) is not None:
                        yield got
                    current, members, queries = lists[lo], [], []
                part = batch.slice(lo, hi - lo)
                ids, bound, v = part.column(3).to_numpy().copy(), part.column(4).to_numpy().copy(), matrix(part.column(5)).copy()
                if kinds[lo] == 0:
                    members.append((ids, v))
                else:
                    members = _packed(members)
                    queries.append((ids, bound, v))
                    if sum(len(x[0]) for x in queries) >= 4096:
                        if (got := answer(members, queries)) is not None:
                            yield got
                        queries = []
        if (got := answer(_packed(members), queries)) is not None:
            yield got

    return run


def _packed(members: list[tuple]) -> list[tuple]:
    """The members of a list as one entry (ids, rows, squares of blocks)."""
    if members and len(members[0]) == 2:
        ids, x = (np.concatenate(y) for y in zip(*members))
        return [(ids, x, _block_squares(x))]
    return members


def _repeats(ids: np.ndarray) -> int:
    """How often the commonest id stands in a list, beyond once."""
    return int(np.unique(ids, return_counts=True)[1].max()) - 1


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, vector_col: str = "embedding", id_col: str = "vec_id", sample: int = SAMPLE, target: float = TARGET, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): for every vector whose id is divisible by every its k
    nearest others among all vectors, rank from 1.

    By cosine; of equal vectors those of the least ids come first. Vectors that are null, of another length than most, zero, or hold a
    null, NaN or infinite number are neither queries nor neighbours, nor are rows without id.
    Repeated rows of one id count as one; fewer others than k give fewer rows; an empty table
    gives an empty result. Other columns are left aside.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, rank int, neighbour_id long, cosine double"
    dimension = dimension_of(vectors, vector_col)
    if not dimension:
        return spark.createDataFrame([], schema)
    own = usable(vectors, vector_col, id_col, dimension)
    count = own.count()
    if not count:
        return spark.createDataFrame([], schema)
    asked = own if every == 1 else own.where(F.col("id") % every == 0)
    if every > 1 and asked.isEmpty():
        return spark.createDataFrame([], schema)
    centres = _centres(own, max(1, round(np.sqrt(count) / LISTS_DIVISOR)), dimension)
    probes = _probes(own, asked, centres, k, sample, target)
    turn = rotation(dimension)
    sizes = _sizes(own, centres)
    queried = sizes if every == 1 else _sizes(asked, centres)
    parts = lambda probed: np.maximum(1, -(-queried * probed // np.maximum(PART, sizes)))
    scanned = lambda rows: rows.repartition("list", "part").sortWithinPartitions("list", "part", "query").mapInArrow(_scanner(k), "id long, neighbour long, d double")
    # every query first in its own list, which bounds how far its neighbours can be
    home = own.mapInArrow(_spreader(centres, turn, parts(1), 0, 1, True, every == 1), _ROW)
    if every > 1:
        home = home.unionByName(asked.mapInArrow(_spreader(centres, turn, parts(1), 0, 1, False, True), _ROW))
    found = written(scanned(home), "home")
    if probes > 1:
        bounds = found.groupBy("id").agg(F.max("d").alias("far"), F.countDistinct("neighbour").alias("n"))
        bounded = asked.join(bounds, "id", "left").select("id", "v", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(5.0)).alias("bound"))
        members = own.mapInArrow(_spreader(centres, turn, parts(probes - 1), 0, 1, True, False), _ROW)
        queries = bounded.mapInArrow(_spreader(centres, turn, parts(probes - 1), 1, probes, False, True), _ROW)
        found = found.unionByName(scanned(members.unionByName(queries)))
    best = found.groupBy("id", "neighbour").agg(F.min("d").alias("d"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_id"), (1 - F.col("d") / 2).alias("cosine"))
