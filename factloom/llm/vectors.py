"""Tables of vectors as unit vectors in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension_of(vectors: DataFrame, vector_col: str) -> int:
    """The commonest length of the vectors, the larger one of equals; 0 for an empty table."""
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count()
    first = sizes.where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def usable(vectors: DataFrame, vector_col: str, id_col: str, dimension: int) -> DataFrame:
    """(id, v) of the vectors that have an id, the given length, only finite numbers and a length other than 0."""
    v = F.col(vector_col).cast("array<float>")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(1e18))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dimension) & fine)


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, as float64."""
    own = rows.astype(np.float64)
    own /= np.abs(own).max(1, keepdims=True)
    return own / np.sqrt((own * own).sum(1, keepdims=True))


def lists_of(rows: np.ndarray) -> pa.Array:
    """The inverse of matrix(), as float."""
    off = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))


def sampled(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of count rows of usable(), by a hash of their ids: the same in every run."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(count).select("v").toArrow()["v"].combine_chunks()
    return unit(matrix(rows)) if len(rows) else np.zeros((0, 0))
