"""Facts as Parquet: written by project so that one project's facts can be replaced, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES, Facts, check_schema


def write_facts(facts: Facts, path: str, mode: str = "overwrite") -> None:
    """All tables under path; edges are parted by family, so a rule reads only its own."""
    for name in TABLES:
        df = check_schema(getattr(facts, name), TABLES[name])
        writer = df.write.mode(mode)
        (writer.partitionBy("family") if name == "edges" else writer).parquet(f"{path}/{name}")


def read_facts(spark: SparkSession, path: str) -> Facts:
    """What write_facts() wrote; a missing column or one of another type is an error."""
    return Facts(**{n: check_schema(spark.read.parquet(f"{path}/{n}"), s) for n, s in TABLES.items()})


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    system, at = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    system, at = _at(spark, path)
    system.delete(at, True)


def write_diagnostics(diagnostics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(message): what the extraction of the facts under path complained of."""
    diagnostics.select(F.col("message").cast("string").alias("message")).write.mode(mode).parquet(f"{path}/diagnostics")


def read_diagnostics(spark: SparkSession, path: str) -> list[str]:
    """The messages of write_diagnostics(), each once, in order; none where it wasn't called."""
    if not exists(spark, f"{path}/diagnostics"):
        return []
    return [r[0] for r in spark.read.parquet(f"{path}/diagnostics").where("message is not null").distinct().orderBy("message").collect()]


def read_json_facts(spark: SparkSession, path: str) -> Facts:
    """The same tables as lines of JSON, with the schemas given rather than guessed."""
    return Facts(**{n: spark.read.schema(T.StructType.fromDDL(s)).json(f"{path}/{n}") for n, s in TABLES.items()})


def write_fragments(table: DataFrame, path: str) -> None:
    """A table of fragments (with project) by project: projects in it are replaced, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def source_files(spark: SparkSession, path: str, pattern: str = "*.cs", skip: tuple[str, ...] = ("bin", "obj")) -> DataFrame:
    """(path, sha) of source files below path, without those of build output."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    own = found.select(F.regexp_replace("path", r"\Afile:/*", "/").alias("path"), F.sha2("content", 256).alias("sha"))
    parts = F.split(F.col("path"), "/")
    return own.where(~F.exists(parts, lambda p: p.isin(list(skip))))


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """(path): files that differ or are new, each once."""
    return tracked.select("path").union(untracked.select("path")).where("path is not null and path <> ''").distinct()


def snapshot_valid(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): why a captured snapshot (path, sha) doesn't fit the files there are now."""
    a, b = manifest.select("path", F.col("sha").alias("then")), files.select("path", F.col("sha").alias("now"))
    reason = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("then") != F.col("now"), "changed")
    return a.join(b, "path", "full").select("path", reason.alias("reason")).where("reason is not null")
