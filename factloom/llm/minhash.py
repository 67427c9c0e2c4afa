"""MinHash near-duplicates by chosen-path set similarity join.

A document is the set of its word 3-grams, embedded as SIZE minwise values. Documents that
agree exactly are one from the start. In each of several independent trees a node chooses some
coordinates at random (a hash of the node) and sends each of its documents to one child per
coordinate, named by the document's value there: similar documents meet in some child, others
part. With more than 1 / threshold coordinates a node, two documents of that similarity meet
with a probability that has a lower bound however deep a tree grows, which gives the number of
trees for a recall of TARGET. A node of at most SMALL documents is compared exhaustively. A
larger node compares those documents with all its others that are on average so similar to the
node that branching wouldn't thin them out, and branches with the rest. A node of more than
BLOCK documents is compared in blocks, each pair of blocks on its own. All nodes of one depth
are worked on in one job, and a depth works only on nodes with two documents or more.

The values only propose pairs. Those far above the threshold connect at once; those in a band
around it that this leaves apart are decided by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop, written
from .batches import small_batches
from .columns import col, fresh
from .text import U64, mix, mix_int, slices, word_hashes

#: Minwise values of a document, each kept as 16 bits of a hash of it: two documents agree by
#: chance in one value of 65,536. The first nodes, which part all documents, are named by values
#: of 64 bits.
SIZE = 128
#: Words in a shingle.
SHINGLE = 3
#: Jaccard similarity from which two documents are near-duplicates.
THRESHOLD = 0.5
#: Estimates by SIZE values, of deviation 0.044 at 0.5, that far below the threshold leave a pair
#: apart, and that far above it connect it; the exact similarity decides between.
BELOW, ABOVE = 0.15, 0.2
#: Documents of a bucket; pairs of two buckets are decided together.
BUCKET = 256
#: Digests of texts to decide on that are broadcast at most; more are joined by shuffling.
BROADCAST = 1_000_000
#: Share of the pairs at the threshold that the trees are to find.
TARGET = 0.97
#: Documents up to which a node is compared exhaustively.
SMALL = 48
#: Documents of a block; a larger node is worked on in pairs of blocks.
BLOCK = 32_768
#: Pairs that a task holds before it passes them on; a crowd of n documents has some n * n / 2.
PAIRS = 1 << 19
#: Documents of a node of several blocks that a document's average similarity is measured on.
SAMPLE = 4096
SEED = 0x5EED

_A = (mix(np.arange(1, SIZE + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1, SIZE + 1, dtype=U64) * U64(0xAF251AF3B0F025B5)).astype(np.uint32)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word 3-grams of each text, and n + 1 offsets; a shorter text is one shingle."""
    h, off = word_hashes(texts)
    n = np.diff(off)
    if not len(h):
        return np.zeros(0, U64), off
    s = h * U64(0x9E3779B97F4A7C15)
    for k in range(1, SHINGLE):
        m = mix(h + U64(k))
        s[:-k] += m[k:]
    s = mix(s)
    position = np.arange(len(h)) - np.repeat(off[:-1], n)
    whole = position <= np.repeat(np.maximum(n - SHINGLE, 0), n)
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        # only this text's own words
        s[off[i]] = mix_int(sum(int(x) * (2 * k + 3) for k, x in enumerate(h[off[i] : off[i + 1]])) + int(n[i]))
        whole[off[i] + 1 : off[i + 1]] = False
    counts = np.concatenate([[0], np.cumsum(whole)])[off]
    return s[whole], counts


def _least(values: Iterable[np.ndarray], off: np.ndarray, out: np.ndarray, lo: int, hi: int) -> None:
    """Lowers out (rows x functions) to the least of each function's values from lo to hi of each row."""
    starts = off[:-1]
    first = int(np.searchsorted(off, lo, side="right")) - 1
    rows = np.arange(first, int(np.searchsorted(starts, hi, side="left")))
    rows = rows[np.diff(off)[rows] > 0]
    cuts = np.maximum(starts[rows], lo) - lo
    for k, own in enumerate(values):
        out[rows, k] = np.minimum(out[rows, k], np.minimum.reduceat(own, cuts))


def signatures(shingles: np.ndarray, off: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
    """(rows x SIZE) minwise values, hashed to 16 bits; a row without shingles has the same one everywhere."""
    out = np.full((len(off) - 1, SIZE), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(shingles), piece):
        hi = min(lo + piece, len(shingles))
        own = (shingles[lo:hi] >> U64(32)).astype(np.uint32)
        _least((own * a + b for a, b in zip(_A, _B)), off, out, lo, hi)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def root_nodes(shingles: np.ndarray, off: np.ndarray, count: int, piece: int = 1 << 15) -> np.ndarray:
    """(rows x count) names of the first nodes of each text, each by a minwise value of its own."""
    out = np.full((len(off) - 1, count), 0xFFFFFFFFFFFFFFFF, U64)
    for lo in range(0, len(shingles), piece):
        hi = min(lo + piece, len(shingles))
        own = shingles[lo:hi]
        _least((own * U64(mix_int(2 * k + 1) | 1) + U64(mix_int(SEED + k)) for k in range(count)), off, out, lo, hi)
    return np.stack([mix(out[:, k] + U64(mix_int(SEED - k))) for k in range(count)], 1)


def branches(threshold: float) -> int:
    """Children that a node sends a document to."""
    return max(2, int(np.ceil(1.5 / threshold)))


def trees(threshold: float, target: float = TARGET) -> int:
    """Trees in which a pair at the threshold meets with probability target, however deep they are."""
    met, k = 1.0, branches(threshold)
    for _ in range(1000):
        # a pair meets below a node if in some of its children both arrive and meet
        met = 1 - (1 - threshold * met) ** k
    return max(1, int(np.ceil(np.log(1 - target) / np.log(max(1 - met, 1e-12)))))


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1, dtype=np.float32)


def _children(nodes: np.ndarray, sig: np.ndarray, count: int) -> np.ndarray:
    """(rows x count) names of the children that each row goes to."""
    draw = mix(nodes ^ U64(0xC0FFEE))
    first, step = draw % U64(SIZE), (draw >> U64(32)) % U64(SIZE // 2) * U64(2) + U64(1)
    rows = np.arange(len(nodes))
    # an odd step leads through all coordinates before one comes again
    return np.stack([mix(mix(nodes + U64(k * SIZE) + c + U64(1)) ^ sig[rows, c.astype(np.int64)].astype(U64)) for k in range(count) for c in [(first + U64(k) * step) % U64(SIZE)]], 1)


def _gathered(pieces: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces, joined until each has some PAIRS rows."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _components_of(sig: np.ndarray, sources: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that have an end in sources, and whether they are sure, one row's partners at
    a time: first those that connect what is connected by pairs of an estimate of threshold + ABOVE
    (rows found already aren't compared again: they'd change no group), then all pairs from
    threshold - BELOW that this leaves apart, with sides only those of two sides."""
    open_ = np.ones(len(sig), bool)
    source = np.zeros(len(sig), bool)
    source[sources] = True
    group = np.arange(len(sig))
    for start in sources:
        if not open_[start]:
            continue
        open_[start] = False
        queue = [int(start)]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(open_ if source[x] else open_ & source)
            if not len(rest):
                continue
            near = rest[_similar_to(sig, rest, x) >= threshold + ABOVE]
            open_[near] = False
            group[near] = start
            yield np.stack([np.full(len(near), x), near], 1), np.ones(len(near), bool)
            queue.extend(near.tolist())
    for g in np.unique(group[sources]):
        outside = np.flatnonzero(group != g)
        if not len(outside):
            break
        for x in np.flatnonzero(source & (group == g)):
            # of two sources the first one finds the pair
            rest = outside[~source[outside] | (outside > x)]
            rest = rest if side is None else rest[side[rest] != side[x]]
            near = rest[_similar_to(sig, rest, x) >= threshold - BELOW]
            yield np.stack([np.full(len(near), x), near], 1), np.zeros(len(near), bool)


def _similar_to(sig: np.ndarray, rows: np.ndarray, x: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.float32), *[_similarity(sig[rows[i : i + 8192]], sig[x]) for i in range(0, len(rows), 8192)]])


def _average_similarity(sig: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Each row's mean similarity to the other rows, or to those of among, from the frequency of its values."""
    m = len(sig)
    total = np.zeros(m)
    for k in range(SIZE):
        if among is None:
            _, inverse, counts = np.unique(sig[:, k], return_inverse=True, return_counts=True)
            total += counts[inverse] - 1
        else:
            own = np.sort(among[:, k])
            total += np.searchsorted(own, sig[:, k], "right") - np.searchsorted(own, sig[:, k], "left")
    return total / (SIZE * (m - 1 if among is None else len(among)))


def _proposed(nodes: np.ndarray, sig: np.ndarray, threshold: float, cells: tuple, onward: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of split_nodes() as row numbers, and whether each is sure, piece by piece; marks
    in onward the rows that branch."""
    count = branches(threshold)
    blocks, i, j, side = cells
    new = np.append(True, (nodes[1:] != nodes[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) if len(nodes) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    sizes = np.diff(np.append(cut, len(nodes)))
    small = (sizes <= SMALL) & (blocks[cut] == 1)
    for m in range(2, SMALL + 1):
        starts = cut[small & (sizes == m)]
        a, b = np.triu_indices(m, 1)
        step = max(1, 65536 // len(a))
        for k in range(0, len(starts), step):
            own = starts[k : k + step, None]
            x, y = (own + a).ravel(), (own + b).ravel()
            near = np.concatenate([_similarity(sig[x[j : j + 8192]], sig[y[j : j + 8192]]) for j in range(0, len(x), 8192)])
            good = near >= threshold - BELOW
            yield np.stack([x[good], y[good]], 1), near[good] >= threshold + ABOVE
    for s, m in zip(cut[~small], sizes[~small]):
        whole = blocks[s] == 1
        rows = s + np.flatnonzero(side[s : s + m] < 2)
        average = _average_similarity(sig[rows], None if whole else sig[s : s + m][side[s : s + m] == 2])
        # a document of average similarity a has about a times as many others in each of count children
        dense = average >= 0.9 / count
        for found, sure in _components_of(sig[rows], np.flatnonzero(dense), threshold, None if i[s] == j[s] else side[rows]):
            yield rows[found], sure
        if i[s] == j[s] and (not whole or (~dense).sum() > 1):
            onward[rows] = ~dense


def _one_cell_each(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(len(nodes), np.int32)
    return none + 1, none, none, none


def split_nodes(nodes: np.ndarray, ids: np.ndarray, sig: np.ndarray, threshold: float, cells: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by cell: the ids of the pairs proposed (a, b), whether each pair is sure,
    then the names of their children for the rows that branch, and these rows' numbers.

    cells: for each row blocks (of its node), i and j (of the cell's pair), and side: 0 in block
    i, 1 in block j, 2 for a row of the sample. Without it every node is one cell.
    """
    onward = np.zeros(len(nodes), bool)
    none = (np.zeros((0, 2), np.int64), np.zeros(0, bool))
    p, sure = (np.concatenate(x) for x in zip(none, *_proposed(nodes, sig, threshold, cells or _one_cell_each(nodes), onward)))
    return ids[p[:, 0]], ids[p[:, 1]], sure, *_branching(nodes, sig, threshold, onward)


def _branching(nodes: np.ndarray, sig: np.ndarray, threshold: float, onward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of the rows marked in onward, and these rows' numbers."""
    at, count = np.flatnonzero(onward), branches(threshold)
    return _children(nodes[at], sig[at], count) if len(at) else np.zeros((0, count), U64), at


def _matrix(column: pa.Array) -> np.ndarray:
    data, off = np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return data[off[0] : off[-1]].view(np.uint16).reshape(-1, SIZE)


def _binary(sig: np.ndarray) -> pa.Array:
    off = np.arange(len(sig) + 1, dtype=np.int32) * (2 * SIZE)
    return pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(sig))])


def _lists(names: np.ndarray) -> pa.Array:
    """Names (rows x any) as lists."""
    return pa.FixedSizeListArray.from_arrays(pa.array(names.ravel().view(np.int64)), names.shape[1]).cast(pa.list_(pa.int64()))


def _signer(threshold: float):
    """(digest, text) to (digest, nodes, signature), the latter two null where a text has no words."""
    count = trees(threshold) * branches(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, texts = batch.column(0), batch.column(1)
            for at, n in slices(texts):
                shingles, off = shingle_hashes(texts.slice(at, n))
                has = np.diff(off) > 0
                where = np.full(n, -1, np.int64)
                where[has] = np.arange(int(has.sum()))
                own = pa.array(where, mask=~has)
                nodes, sig = _lists(root_nodes(shingles, off, count)[has]), _binary(signatures(shingles, off)[has])
                yield pa.RecordBatch.from_arrays([digest.slice(at, n), nodes.take(own), sig.take(own)], ["digest", "nodes", "sig"])

    return sign


def _splitter(threshold: float):
    """Rows (node, blocks, i, j, side, rid, sig) sorted by cell to (kind, x, y, nodes, sig): sure
    pairs (0), pairs to decide (2), and documents x that branch, with their children (1)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            nodes, blocks, i, j, side, ids, sig = (np.concatenate(x) for x in zip(*rows))
            nodes, onward = nodes.view(U64), np.zeros(len(ids), bool)
            for p, sure in _gathered(_proposed(nodes, sig, threshold, (blocks, i, j, side), onward)):
                kind = np.where(sure, 0, 2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ids[p[:, 0]]), pa.array(ids[p[:, 1]]), pa.nulls(len(p), pa.list_(pa.int64())), pa.nulls(len(p), pa.binary())], ["kind", "x", "y", "nodes", "sig"])
            children, at = _branching(nodes, sig, threshold, onward)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(ids[at]), pa.array(ids[at]), _lists(children), _binary(sig[at])], ["kind", "x", "y", "nodes", "sig"])

        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = (*(batch.column(k).to_numpy() for k in range(6)), _matrix(batch.column(6)))
            # the last cell of a batch may go on in the next one
            other = np.flatnonzero((own[0] != own[0][-1]) | (own[2] != own[2][-1]) | (own[3] != own[3][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from emit([*held, tuple(x[:last] for x in own)])
                held = []
            elif held and any(held[-1][k][-1] != own[k][-1] for k in (0, 2, 3)):
                yield from emit(held)
                held = []
            held.append(tuple(x[last:].copy() for x in own))
        if held:
            yield from emit(held)

    return split


def _celled(laden: DataFrame) -> DataFrame:
    """(node, n, rid, sig) to (node, blocks, i, j, side, rid, sig): a node of at most BLOCK
    documents is one cell; of a larger one, every document goes to the cells of its block with
    every block, and those of the sample to all cells."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = laden.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    zero = F.lit(0)
    one = own.where("blocks = 1").select("node", "blocks", zero.alias("i"), zero.alias("j"), zero.alias("side"), "rid", "sig")
    large = own.where("blocks > 1").withColumn("k", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    members = large.select("node", "blocks", F.least("k", "block").alias("i"), F.greatest("k", "block").alias("j"), (F.col("block") > F.col("k")).cast("int").alias("side"), "rid", "sig")
    sampled = large.where(F.pmod(F.xxhash64("node", "rid"), F.col("n")) < SAMPLE)
    sample = sampled.withColumn("j", F.explode(F.sequence("k", F.col("blocks") - 1))).select("node", "blocks", F.col("k").alias("i"), "j", F.lit(2).alias("side"), "rid", "sig")
    return one.unionByName(members).unionByName(sample)


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of edges (a, b): root is the least id of its connected component.

    Rounds of large-star and small-star, which need a number of rounds logarithmic in the ids,
    each written to the shared folder.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        star = large.select("a", "b", m.alias("m"))
        small = star.select("a", F.col("m").alias("b")).unionByName(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        then = written(small, "edges")
        # at the end every id has one edge, and no root has one
        again = then.groupBy("a").agg(F.count("*").alias("n")).join(then.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(1)), "a", "left").where("n > 1 or root = 1").limit(1).count()
        drop(now)
        now = then
        if not again:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))



def near_edges(documents: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct texts (rid, digest, sig), and edges (a, b) of rids that connect the groups."""
    small_batches(documents.sparkSession)
    texts = documents.select(F.unhex(F.md5(col(text_col).cast("string"))).alias("digest"), col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    signed = texts.mapInArrow(_signer(threshold), "digest binary, nodes array<long>, sig binary").groupBy("digest").agg(F.first("nodes").alias("nodes"), F.first("sig").alias("sig"))
    # the number is drawn before the table is written, so it stays
    reps = written(signed.where("sig is not null").select(F.monotonically_increasing_id().alias("rid"), "digest", "nodes", "sig"), "signatures")
    # every depth has its own table of documents that branch, with their values
    open_ = reps.select(F.col("rid").alias("row"), "rid", "sig")
    nodes = reps.select(F.col("rid").alias("row"), F.explode("nodes").alias("node"))
    done: list[DataFrame] = []
    while True:
        crowded = nodes.withColumn("n", F.count("*").over(Window.partitionBy("node"))).where("n > 1")
        cells = _celled(crowded.join(open_, "row").select("node", "n", "rid", "sig"))
        split = cells.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(_splitter(threshold), "kind int, x long, y long, nodes array<long>, sig binary")
        done.append(written(split.withColumn("row", F.monotonically_increasing_id()), "nodes"))
        rows = done[-1].where("kind = 1")
        if rows.isEmpty():
            break
        open_, nodes = rows.select("row", F.col("x").alias("rid"), "sig"), rows.select("row", F.explode("nodes").alias("node"))
    edges = reduce(DataFrame.unionByName, [d.where("kind <> 1").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "kind") for d in done])
    roots = connected(edges.where("kind = 0").select("a", "b"))
    ends = [roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    apart = edges.where("kind = 2").select("a", "b").distinct().join(ends[0], "a", "left").join(ends[1], "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    apart = written(apart.where("root_a <> root_b"), "apart")
    for table in done:
        drop(table)
    exact = _decided(texts, reps, apart, threshold)
    return reps, roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(exact)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, cells, text) to (root, i, j, a, shingles), a row for each cell: the distinct hashes in
    order. Of the copies of a text that a task meets, the first one speaks for all."""
    seen: set[int] = set()
    for batch in batches:
        rids = batch.column(0).to_numpy()
        new = np.zeros(len(rids), bool)
        new[np.unique(rids, return_index=True)[1]] = True
        new &= ~np.isin(rids, np.fromiter(seen, np.int64, len(seen))) if seen else True
        seen.update(rids[new].tolist())
        own = batch.filter(pa.array(new))
        for at, n in slices(own.column(2)):
            hashes, off = shingle_hashes(own.column(2).slice(at, n))
            sets = pa.array([np.unique(hashes[off[i] : off[i + 1]]).tobytes() for i in range(n)], pa.binary())
            cells = own.column(1).slice(at, n)
            row = pa.array(np.repeat(np.arange(n), cells.value_lengths().to_numpy()))
            root, i, j = cells.flatten().flatten()
            yield pa.RecordBatch.from_arrays([root, i, j, own.column(0).slice(at, n).take(row), sets.take(row)], ["root", "i", "j", "a", "shingles"])


def _decider(threshold: float):
    """Rows (root, i, j, a, shingles, b, root_a, root_b) sorted by cell, shingles first, to pairs
    that connect what those of a similarity of threshold or more connect: a pair whose ends
    others connect already needs no look."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets, group = None, {}, {}

        def root_of(x: int) -> int:
            while group.get(x, x) != x:
                group[x] = x = group.get(group[x], group[x])
            return x

        for batch in batches:
            good = []
            cells = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for cell, a, own, b, ra, rb in zip(cells, batch.column(3).to_pylist(), batch.column(4), *(batch.column(k).to_pylist() for k in range(5, 8))):
                if cell != current:
                    current, sets, group = cell, {}, {}
                if own.is_valid:
                    sets[a] = np.frombuffer(own.as_buffer(), U64)
                    continue
                ra, rb = root_of(ra), root_of(rb)
                if ra == rb:
                    continue
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= threshold * max(len(x), len(y)) else 0
                if both and both >= threshold * (len(x) + len(y) - both):
                    good.append((a, b))
                    group[ra] = rb
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    return decide


def _decided(texts: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b, root_a, root_b), enough of those whose texts have a Jaccard similarity of
    threshold or more to connect what they all connect.

    Texts that pairs connect directly or by others are decided together: a set of shingles goes
    once to their cell, or, where more than BUCKET make a square of cells, once to each cell of
    its bucket that asks for it.
    """
    joined = connected(pairs.select("a", "b"))
    roots = written(joined.unionByName(joined.select(F.col("root").alias("id"), "root").distinct()), "pieces")
    drop(joined)
    # a row per text of a pair; what is counted lies in one place already
    sized = roots.withColumn("buckets", F.ceil(F.count("*").over(Window.partitionBy("root")) / BUCKET))
    places = sized.select("id", "root", F.pmod(F.xxhash64("id"), "buckets").cast("int").alias("bucket"))
    ends = [places.select(F.col("id").alias(c), F.col("root").alias("root"), F.col("bucket").alias(f"bucket_{c}")) for c in "ab"]
    celled = pairs.join(ends[0], "a").join(ends[1].drop("root"), "b").select("root", F.least("bucket_a", "bucket_b").alias("i"), F.greatest("bucket_a", "bucket_b").alias("j"), "a", "b", "root_a", "root_b")
    celled = written(celled, "cells")
    drop(roots)
    drop(pairs)
    cell = F.struct("root", "i", "j")
    asked = celled.select(F.col("a").alias("rid"), cell.alias("cell")).unionByName(celled.select(F.col("b").alias("rid"), cell.alias("cell"))).groupBy("rid").agg(F.collect_set("cell").alias("cells"))
    named = written(reps.select("rid", "digest").join(asked, "rid").select("rid", "digest", "cells"), "asked")
    # the texts stay where they are unless too many are asked for
    named = F.broadcast(named) if named.count() <= BROADCAST else named
    sent = texts.join(named, "digest").select("rid", "cells", "text").mapInArrow(_sets, "root long, i int, j int, a long, shingles binary")
    none = lambda c: F.lit(None).cast("long").alias(c)
    rows = sent.select("*", none("b"), none("root_a"), none("root_b")).unionByName(celled.withColumn("shingles", F.lit(None).cast("binary")))
    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", F.col("b").isNotNull()).mapInArrow(_decider(threshold), "a long, b long")


def _groups(documents: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """(digest, root): the group of every distinct text that has a near copy, named by a digest."""
    reps, edges = near_edges(documents, threshold, text_col)
    roots = connected(edges)
    named = reps.select("rid", "digest")
    full = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    groups = written(full.join(named, full.id == named.rid).select("root", "digest"), "groups")
    drop(roots)
    return groups


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, kept_doc_id): each document with an exact or near copy, but the one that stays,
    beside the one that stays: that with the least doc_id of the group.

    Two documents are near copies if the Jaccard similarity of their sets of word 3-grams (words
    in lower case, signs ignored) is threshold or more; groups are the connected components. Texts of less than three words
    are one shingle; texts without words, empty ones too, have exact copies only; null texts
    have none. Documents without doc_id are left aside. Repeated rows of one doc_id and text
    count once; an empty table gives an empty result. Other columns are left aside.
    """
    groups = _groups(documents, threshold, text_col)
    ids = documents.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("doc_id"), F.unhex(F.md5(col(text_col).cast("string"))).alias("digest")).distinct()
    named = ids.join(groups, "digest", "left").select("doc_id", F.coalesce(F.hex("root"), F.hex("digest")).alias("g"))
    w = Window.partitionBy("g")
    return named.withColumn("kept_doc_id", F.min("doc_id").over(w)).where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def keep_one_of_each(documents: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of documents, with all their columns, less all but one of each group of copies.

    Groups are those of near_duplicates(); of a group stays the row with the least doc_id, a
    null doc_id being the largest, and of groups of texts with one doc_id that of the least
    digest. Of rows repeated in doc_id and text one stays, the first in the order of the other
    columns. Rows with a null text all stay; empty texts are copies of each other. Whole texts
    count, however long; an empty table gives an empty result. Columns may have any names.
    """
    groups = _groups(documents, threshold, text_col)
    own, digest, own_m, digest_m, number, kind, place = fresh(documents, "id", "digest", "marked_id", "marked_digest", "number", "kind", "place")
    text_digest = F.unhex(F.md5(col(text_col).cast("string")))
    keys = documents.where(col(text_col).isNotNull()).groupBy(col(id_col).alias(own), text_digest.alias(digest)).agg(F.count("*").alias(number))
    least = keys.groupBy(digest).agg(F.min(own).alias("least"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("least").asc_nulls_last(), digest))
    lost = least.join(groups.withColumnRenamed("digest", digest), digest).withColumn("rank", rank).select(digest, (F.col("rank") > 1).alias("lost"))
    # 0: the rows go; 1: rows that stay, but repeat each other
    what = F.when(F.coalesce(F.col("lost"), F.lit(False)) | ~F.col(own).eqNullSafe(F.col("least")), 0).when(F.col(number) > 1, 1)
    marked = written(keys.join(least, digest).join(lost, digest, "left").select(own, digest, what.alias(kind)).where(f"`{kind}` is not null"), "marked")
    # their texts stay where they are unless too many rows are marked
    sent = F.broadcast(marked) if marked.count() <= BROADCAST else marked
    sent = sent.withColumnRenamed(own, own_m).withColumnRenamed(digest, digest_m)
    told = documents.withColumn(own, col(id_col)).withColumn(digest, text_digest)
    told = told.join(sent, (F.col(digest) == F.col(digest_m)) & F.col(own).eqNullSafe(F.col(own_m)), "left")
    columns = [col(c) for c in documents.columns]
    order = [col(f.name) for f in documents.schema if isinstance(f.dataType, T.AtomicType)]
    again = told.where(F.col(kind) == 1).withColumn(place, F.row_number().over(Window.partitionBy(digest, own).orderBy(*order))).where(F.col(place) == 1)
    return told.where(F.col(kind).isNull()).select(*columns).union(again.select(*columns))
