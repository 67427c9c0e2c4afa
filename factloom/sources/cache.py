"""Extracted facts kept between runs: which projects must be extracted again, and putting them in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import content_keys, dirty, merkle_keys
from ..session import written
from .tables import exists, remove, write_fragments


@dataclass
class Verdict:
    """kind: hit (nothing to do), partial (some projects to extract again) or miss (all of them);
    again (project): those to extract; gone (project): those that are there no more; keys
    (project, key): what the facts will be stored under."""

    kind: str
    again: DataFrame
    gone: DataFrame
    keys: DataFrame


def look_up(spark: SparkSession, path: str, files: DataFrame, projects: DataFrame, fingerprint: str) -> Verdict:
    """What the facts under path are worth for files (project, path, sha) and projects (name,
    project_references), extracted in the way that fingerprint stands for.

    A project's key stands for its files and for all that it references, so a change reaches the
    projects that depend on it. Another fingerprint, or nothing under path, is a miss.
    """
    keys = written(merkle_keys(content_keys(files), projects), "keys")
    stored = None
    if exists(spark, f"{path}/keys"):
        stored = spark.read.parquet(f"{path}/keys")
        if stored.where(F.col("fingerprint") != fingerprint).isEmpty():
            changed = written(dirty(keys, stored), "changed")
            again = changed.join(keys.select("project"), "project", "left_semi")
            gone = changed.join(keys.select("project"), "project", "left_anti")
            clean = changed.isEmpty()
            return Verdict("hit" if clean else "partial", again, gone, keys)
    none = spark.createDataFrame([], "project string")
    return Verdict("miss", keys.select("project"), none if stored is None else stored.join(keys, "project", "left_anti").select("project"), keys)


def store(verdict: Verdict, path: str, fragments: DataFrame, fingerprint: str) -> None:
    """Puts the fragments (with project) of verdict.again under path: other projects' stay, those
    that are gone go, and the keys are written last, so that a run cut short costs a new extraction."""
    spark = fragments.sparkSession
    keys = written(verdict.keys, "keys")
    again = verdict.again.withColumnRenamed("project", "__p")
    bare = verdict.again.join(fragments.select("project"), "project", "left_anti")
    gone = [r[0] for r in verdict.gone.union(bare).collect()]
    remove(spark, f"{path}/keys")
    if verdict.kind == "miss":
        remove(spark, f"{path}/fragments")
    write_fragments(fragments.join(again, F.col("project") == F.col("__p"), "left_semi"), f"{path}/fragments")
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in gone:
        remove(spark, f"{path}/fragments/project={escape(name)}")
    keys.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(f"{path}/keys")


def fragments_of(spark: SparkSession, path: str) -> DataFrame:
    """All fragments under path."""
    return spark.read.option("basePath", f"{path}/fragments").parquet(f"{path}/fragments")
