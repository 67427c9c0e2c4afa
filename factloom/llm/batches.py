"""The memory that Python takes: the size of the batches of text that it gets, and what a fit leaves."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to BATCH_BYTES if they may be larger: a batch of long
    texts is then no larger in memory than one of short ones. Results are lazy, so the setting
    stays for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("kmgb") or "0"
    unit = now[len(digits) :]
    size = int(digits) * units[unit[:1] or "b"]
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Gives memory that a fit on the driver has used and freed back to the system; the driver goes
    on to other work, and the allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
