"""A stream of fragment versions, kept as the latest fragment of each project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame) -> DataFrame:
    """Rows of each project's newest version only, the later generation before the higher version."""
    newest = F.rank().over(Window.partitionBy("project").orderBy(F.desc("generation"), F.desc("version")))
    return rows.withColumn("__r", newest).where("__r = 1").drop("__r")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Replaces the projects of each batch (with project, generation, version) in a table parted by
    project; then(changed projects, batch) follows. A batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch)
        try:
            old = spark.read.parquet(path)
            now = new.groupBy("project").agg(F.max(F.struct("generation", "version")).alias("n"))
            have = old.groupBy("project").agg(F.max(F.struct("generation", "version")).alias("o"))
            stale = now.join(have, "project").where("n < o").select("project")
            new = new.join(stale, "project", "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)
        if then:
            then(new.select("project").distinct(), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
