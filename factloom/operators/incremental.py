"""What must be extracted again after a change: content keys, keys over dependencies, and the closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, written

#: Tables of levels that a plan unites before they are written as one.
LEVELS = 16


def content_keys(files: DataFrame) -> DataFrame:
    """(project, key): a hash of the paths and contents (sha) of a project's files; a file without
    content counts as missing."""
    line = F.concat(F.translate("path", "\\", "/"), F.lit("\0"), F.coalesce("sha", F.lit("MISSING")))
    return files.groupBy("project").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("key"))


def dependency_edges(projects: DataFrame) -> DataFrame:
    """(project, reference) of references to known projects."""
    refs = projects.select(F.col("name").alias("project"), F.explode("project_references").alias("reference"))
    return refs.join(projects.select(F.col("name").alias("reference")).hint("merge"), "reference", "left_semi").select("project", "reference").distinct()


def merkle_keys(keys: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, key): a hash of a project's own key and the keys of what it references, level by
    level from the projects that reference nothing. Projects on a cycle, and those that depend on
    one, get a hash of their own key and of the settled ones.

    Each round goes from the projects that the one before settled along the references to them; a
    project waits, with the keys it has, until it has all. Joins merge what is shuffled: levels
    may be any size and number, and none of them is passed on by the driver.
    """
    keys = written(keys.select("project", "key"), "content")
    known = dependency_edges(projects.join(keys.hint("merge"), projects.name == keys.project, "left_semi"))
    counted = known.withColumn("n", F.count("*").over(Window.partitionBy("project")))
    edges = written(counted.join(keys.hint("merge"), "project"), "references")
    settled = written(keys.join(edges.select("project").hint("merge"), "project", "left_anti").select("project", F.sha2("key", 256).alias("key")), "keys")
    done, tables, waiting = settled, [settled], None
    while not settled.isEmpty():
        news = settled.select(F.col("project").alias("reference"), F.col("key").alias("k")).hint("merge")
        arrived = edges.join(news, "reference").select("project", "key", "n", F.array(F.struct("reference", "k")).alias("below"))
        arrived = arrived if waiting is None else arrived.unionByName(waiting)
        level = arrived.groupBy("project", "key", "n").agg(F.flatten(F.collect_list("below")).alias("below"))
        whole = F.size("below") == F.col("n")
        # what has settled keeps its key only
        found = written(level.select("project", F.when(whole, _hash_over("below")).otherwise(F.col("key")).alias("key"), F.when(~whole, F.col("n")).alias("n"), F.when(~whole, F.col("below")).alias("below")), "level")
        tables.append(found)
        waiting, settled = found.where("n is not null"), found.where("n is null").select("project", "key")
        done = done.unionByName(settled)
        if len(tables) > LEVELS:
            done, waiting, settled = (written(df, "level") for df in (done, waiting, settled))
            for t in tables:
                drop(t)
            tables = [done, waiting, settled]
    # what waits still is on a cycle or behind one
    rest = keys.join(done.select("project").hint("merge"), "project", "left_anti").join(edges.select("project", "reference").hint("merge"), "project")
    mine = rest.join(done.select(F.col("project").alias("reference"), F.col("key").alias("k")).hint("merge"), "reference", "left")
    last = mine.groupBy("project", "key").agg(F.collect_list(F.struct("reference", "k")).alias("below")).select("project", _hash_over("below").alias("key"))
    out = written(done.unionByName(last), "keys")
    for t in (*tables, edges, keys):
        drop(t)
    return out


def _hash_over(below: str) -> Column:
    """A hash of the column key and of the keys (k) of below in the order of its references."""
    part = F.array_join(F.transform(F.array_sort(below), lambda x: F.coalesce(x.k, F.lit(""))), "\0")
    return F.sha2(F.concat("key", F.lit("\0"), part), 256)


def dirty(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(project): those whose key differs from the stored one, or that are in one table only."""
    return now.select("project", F.col("key").alias("a")).join(stored.select("project", F.col("key").alias("b")), "project", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("project")


def with_dependents(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(project): changed ones and all that reference them, directly or not.

    A frontier goes from level to level; each is written, so the plan doesn't grow with the depth.
    Joins merge what is shuffled, as in merkle_keys().
    """
    reached = written(changed.select("project").distinct(), "reached")
    frontier = reached
    back = written(edges.select(F.col("reference").alias("r"), F.col("project").alias("p")), "references")
    while True:
        step = frontier.join(back.hint("merge"), F.col("project") == F.col("r")).select(F.col("p").alias("project")).distinct().join(reached.hint("merge"), "project", "left_anti")
        before, frontier = frontier, written(step, "frontier")
        if before is not reached:
            drop(before)
        if frontier.isEmpty():
            drop(back)
            return reached
        before, reached = reached, written(reached.unionByName(frontier), "reached")
        drop(before)


def refreshed(old: DataFrame, new: DataFrame, again: DataFrame, column: str = "project") -> DataFrame:
    """Facts by project: new ones for the projects extracted again, old ones for the others."""
    return old.join(again.select(F.col("project").alias(column)), column, "left_anti").unionByName(new.join(again.select(F.col("project").alias(column)), column, "left_semi"))
