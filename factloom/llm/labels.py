"""The labelled documents that a classifier of this package is fitted on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import drop, written
from .batches import small_batches
from .columns import col

#: Bytes of numbers that the driver gets at a time.
PART_BYTES = 32 << 20


@contextmanager
def on_disk(sample: DataFrame, numbers: str) -> Iterator[tuple[list[Row], np.ndarray, np.ndarray]]:
    """The rows of a sample without its binary column of 32-bit numbers, then where the numbers of
    each row begin and end (n + 1), and the numbers, which lie in a file of the driver's.

    A sample is bounded by its rows, not by how long its texts are: the driver gets PART_BYTES and
    one row more at a time, and holds none of it.
    """
    table = written(sample, "sample")
    try:
        size = table.agg(F.sum(F.length(numbers))).first()[0] or 0
        rows, lengths, others = [], [0], [c for c in table.columns if c != numbers]
        with tempfile.TemporaryFile() as file:
            for r in table.repartition(1 + size // PART_BYTES).toLocalIterator():
                rows.append(Row(*others)(*[r[c] for c in others]))
                lengths.append(len(r[numbers]) // 4)
                file.write(r[numbers])
            file.flush()
            yield rows, np.cumsum(lengths), np.asarray(np.memmap(file, np.int32, "r")) if any(lengths) else np.zeros(0, np.int32)
    finally:
        drop(table)


def pieces(numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """The numbers of rows that lie anywhere, copied side by side, with n + 1 offsets and the rows'
    place: as many rows at a time as have most numbers, one at least."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - lengths[lo] + most, side="right")))
        own = lengths[lo:hi]
        off = np.concatenate([[0], np.cumsum(own)])
        yield numbers[np.repeat(starts[lo:hi] - off[:-1], own) + np.arange(off[-1])], off, slice(lo, hi)
        lo = hi


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, limit: int, text_col: str = "text") -> DataFrame:
    """Up to limit labelled documents, at most half of limit from each class, as (doc_id, y, lang, text).

    The labels of documents that exist are taken in the order of a hash of doc_id, so the sample
    is the same in every run. Labels whose doc_id or target is null are skipped; of
    contradicting labels for one doc_id the larger counts. A doc_id that several documents have
    comes once, with the least of their texts; null texts are skipped. Without a column lang it
    is null.
    """
    small_batches(documents.sparkSession)
    own = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    there = own.join(documents.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    picked = [there.where(F.col("y") == y).orderBy(order, "doc_id").limit(limit // 2) for y in (0, 1)]
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(F.col("doc_id"), lang.alias("lang"), col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    # limit bounds what is broadcast: two numbers for each sampled document
    rows = docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    # a row for each doc_id, so that limit bounds what the driver gets too
    return rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "y", "d.lang", "d.text")
