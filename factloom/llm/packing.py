"""Packing: the documents' tokens, concatenated in the order of doc_id, cut into windows of one length.

Documents are encoded once, by byte-level BPE, and their tokens written. Then two passes. The
first counts the tokens of each range of documents; the prefix sums of these totals are the
global offsets at which the ranges begin. The second moves each range to one partition, in
order, and cuts it: a window that lies inside a range comes out whole, one that spans ranges as
a boundary record of each, and only these records are grouped. Which range a document belongs
to depends on its doc_id and tokens alone, so a lost task can be run again anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .batches import small_batches
from .bpe import PIECE, VOCABULARY, Encoder, Vocabulary, broadcast_vocabulary
from .columns import col
from .text import slices

#: Tokens of a window.
LENGTH = 2048
WINDOW = "window_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, lengths array<int>, tokens array<int>"
#: What a null doc_id counts as when documents are ordered.
NULL_ID = -(1 << 63)


def tokenised(documents: DataFrame, path: str, text_col: str, id_col: str) -> tuple[DataFrame, np.dtype]:
    """(doc_id, place, tokens, n): the tokens of each document that has any, with the token that
    ends a document behind them, the first number free; and their kind: 16 bits each if all
    numbers fit, else 32. place, a hash of the tokens, orders documents of one doc_id."""
    shared = broadcast_vocabulary(documents.sparkSession, path)
    end = len(shared.value[0])
    kind = np.dtype("<u2" if end < 1 << 16 else "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        for batch in batches:
            for at, n in slices(batch.column(1), PIECE):
                tokens, off = encoder(batch.column(1).slice(at, n))
                size = np.diff(off)
                has = size > 0
                size = size + has
                out = np.full(int(size.sum()), end, kind)
                row = np.repeat(np.arange(n), np.diff(off))
                out[np.arange(len(tokens)) + np.cumsum(has)[row] - 1] = tokens
                cut = np.concatenate([[0], np.cumsum(size[has])]) * kind.itemsize
                own = pa.Array.from_buffers(pa.binary(), int(has.sum()), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).filter(pa.array(has)), own, pa.array(size[has])], ["doc_id", "tokens", "n"])

    docs = documents.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    encoded = docs.mapInArrow(run, "doc_id long, tokens binary, n long")
    return encoded.select("doc_id", F.shiftrightunsigned(F.xxhash64("tokens"), 1).alias("place"), "tokens", "n"), kind


def range_number(ids: np.ndarray, places: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The range of each document: the number of cuts at or before it. A doc_id that is a cut
    several times holds that many ranges, by place."""
    edges, times = np.unique(cuts, return_counts=True)
    if not len(edges):
        return np.zeros(len(ids), np.int32)
    before = np.concatenate([[0], np.cumsum(times)])
    at = np.searchsorted(edges, ids)
    here = np.minimum(at, len(edges) - 1)
    n = np.where(edges[here] == ids, times[here], 0)
    return (before[at] + np.where(n > 0, 1 + np.minimum((places / 2.0**63 * n).astype(np.int64), n - 1), 0)).astype(np.int32)


def _cutter(offsets: np.ndarray, length: int, kind: np.dtype, boundary: bool):
    """(pid, doc_id, tokens), sorted, to the windows inside a range, or else to the boundary records."""
    total = int(offsets[-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, here = -1, 0
        # what is left of the window begun: tokens, and of its pieces doc_id (null), start in the document, length
        rest, ids, null, starts, sizes = np.zeros(0, kind), *(np.zeros(0, k) for k in (np.int64, bool, np.int64, np.int64))

        def emit(final: bool) -> pa.RecordBatch | None:
            """The windows that end among the tokens held; at the end of a range all of them."""
            nonlocal rest, ids, null, starts, sizes
            low, high = int(offsets[pid]), int(offsets[pid + 1])
            first = here - len(rest)
            last = here if final else here // length * length
            if last <= first:
                return None
            bounds = np.unique(np.concatenate([[first], np.arange(first // length + 1, -(-last // length)) * length, [last]]))
            windows = bounds[:-1] // length
            whole = (windows * length >= low) & (np.minimum((windows + 1) * length, total) <= high)
            ends = first + np.cumsum(sizes)
            points = np.unique(np.concatenate([bounds, ends[(ends > first) & (ends < last)]]))
            doc = np.searchsorted(ends, points[:-1], side="right")
            begin = starts[doc] + points[:-1] - (ends[doc] - sizes[doc])
            of = np.searchsorted(bounds, points[:-1], side="right") - 1
            chosen = whole != boundary
            keep = chosen[of]
            n = np.bincount(of, minlength=len(windows))[chosen]
            piece = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            width = np.diff(bounds)
            inside = np.repeat(chosen, width)
            lists = lambda x, kind, mask=None: pa.ListArray.from_arrays(pa.array(piece), pa.array(x[keep], kind, mask=None if mask is None else mask[keep]))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(windows[chosen]), pa.array(width[chosen].astype(np.int32)), lists(ids[doc], pa.int64(), null[doc]), lists(begin, pa.int64()), lists(np.diff(points).astype(np.int32), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width[chosen])]).astype(np.int32)), pa.array(rest[: last - first][inside].astype(np.int32))), pa.array((bounds[:-1][chosen] % length).astype(np.int32)),
                ],
                ["window_id", "n_tokens", "doc_ids", "doc_starts", "lengths", "tokens", "place"],
            )
            # the document that goes on keeps what is beyond
            k = int(np.searchsorted(ends, last, side="right"))
            if k < len(sizes):
                used = last - (int(ends[k]) - int(sizes[k]))
                starts[k] += used
                sizes[k] -= used
            rest, ids, null, starts, sizes = rest[last - first :], ids[k:], null[k:], starts[k:], sizes[k:]
            return out

        for batch in batches:
            pids = batch.column(0).to_numpy()
            change = np.flatnonzero(np.append(True, pids[1:] != pids[:-1])) if len(pids) else []
            for lo, hi in zip(change, [*change[1:], len(pids)]):
                if pids[lo] != pid:
                    if pid >= 0 and (out := emit(True)) is not None and out.num_rows:
                        yield out
                    pid = int(pids[lo])
                    here = int(offsets[pid])
                own, docs = batch.column(2).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                off = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
                flat = np.frombuffer(own.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind)
                rest = np.concatenate([rest, flat])
                ids, null = np.concatenate([ids, docs.fill_null(0).to_numpy()]), np.concatenate([null, docs.is_null().to_numpy(zero_copy_only=False)])
                starts, sizes = np.concatenate([starts, np.zeros(len(own), np.int64)]), np.concatenate([sizes, np.diff(off) // kind.itemsize])
                here += len(flat)
                if (out := emit(False)) is not None and out.num_rows:
                    yield out
        if pid >= 0 and (out := emit(True)) is not None and out.num_rows:
            yield out

    return cut


def pack(documents: DataFrame, length: int = LENGTH, path: str = VOCABULARY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per window: window_id from 0, n_tokens (length, but for the last window), for each
    piece of a document in it, in order, doc_ids, doc_starts (tokens of the document before the
    piece) and lengths (in tokens), and the window's tokens.

    Every document ends with one more token, the first that the vocabulary has not. Documents
    come in the order of doc_id, null first; of one doc_id in the order of a hash of their
    tokens; rows repeated in full are packed each. Null and empty texts add nothing; an empty
    table gives an empty result. Whole texts are packed, however long. Other columns are left
    aside, whatever their names.
    """
    spark = documents.sparkSession
    small_batches(spark)
    encoded, kind = tokenised(documents, path, text_col, id_col)
    docs = written(encoded, "tokens")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce("doc_id", F.lit(NULL_ID))
    quantiles = [i / ranges for i in range(1, ranges)]
    cuts = np.array((docs.agg(F.percentile_approx(order, quantiles, 20 * ranges)).first()[0] if quantiles else None) or [], np.int64)

    @F.arrow_udf(T.IntegerType())
    def range_of(ids: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array(range_number(ids.to_numpy(), places.to_numpy(), cuts))

    ranged = docs.withColumn("pid", range_of(order, F.col("place")))
    totals = np.zeros(len(cuts) + 2, np.int64)
    # one row per range, however many documents
    for pid, n in ranged.groupBy("pid").agg(F.sum("n")).collect():
        totals[pid + 1] = n
    moved = ranged.select("pid", "doc_id", "place", "tokens").repartition("pid").sortWithinPartitions("pid", "doc_id", "place").select("pid", "doc_id", "tokens")
    offsets, record = np.cumsum(totals), f"{WINDOW}, place int"
    inner = moved.mapInArrow(_cutter(offsets, length, kind, False), record).drop("place")
    # the same exchange feeds both; at most two records for each range are left to group
    lists = ("doc_ids", "doc_starts", "lengths", "tokens")
    ordered = F.array_sort(F.collect_list(F.struct("place", "n_tokens", *lists)))
    edge = moved.mapInArrow(_cutter(offsets, length, kind, True), record).groupBy("window_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), ordered.alias("r"))
    return inner.unionByName(edge.select("window_id", "n_tokens", *[F.flatten(f"r.{c}").alias(c) for c in lists]))
