"""Tables that cut lineage: written to the shared folder of spark.checkpoint.dir, so that a lost
executor costs a reread and never the work before it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of this machine's, for local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again.

    The table outlives the call, since lazy results read it; sweep() or the end of the
    driver removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table of written() that nothing will read again."""
    files = df.inputFiles()
    for spark, path in list(_written):
        if any(path in f for f in files):
            _remove(spark, path)
            _written.remove((spark, path))


def sweep() -> None:
    """Removes all tables of written(); results that still read them can't be computed afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may have ended before
            return


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
