"""Fragments of a graph, each extracted on its own, merged to one.

A type that several fragments declare keeps the facts of the first by fragment_ord; sites of a
type, and of an edge between the same two, are united. Outside types are those that some edge
or base names and no fragment declares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LIFETIMES
from .select import rank_within


def united(column: str) -> F.Column:
    """An aggregate: the distinct entries of arrays, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column)


def first_declared(types: DataFrame) -> DataFrame:
    """One row per full_name: the facts of the first declarer, the sites of all."""
    won = types.withColumn("__n", rank_within(["full_name"], [F.col("fragment_ord"), F.col("project_name")])).where("__n = 1").drop("__n", "declaration_sites", "file_paths")
    sites = types.groupBy(F.col("full_name").alias("__f")).agg(united("declaration_sites"), united("file_paths"))
    return won.join(sites, F.col("full_name") == F.col("__f")).drop("__f")


def conflations(types: DataFrame) -> DataFrame:
    """(note): types that projects of different names declare, once for each name that lost."""
    won = types.withColumn("__n", rank_within(["full_name"], [F.col("fragment_ord"), F.col("project_name")])).where("__n = 1").select(F.col("full_name").alias("__f"), F.col("project_name").alias("__p"))
    lost = types.join(won, (F.col("full_name") == F.col("__f")) & (F.col("project_name") != F.col("__p"))).select("full_name", "__p", "project_name").distinct()
    return lost.select(F.concat(F.col("full_name"), F.lit(" is declared by "), F.col("__p"), F.lit(" and again by "), F.col("project_name")).alias("note"))


def merged_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges united over fragments by their keys; none leads from a type to itself."""
    keys = keys or tuple(k for k in ("family", "source", "target") if k in edges.columns)
    own = edges.where("source <> target") if "target" in edges.columns else edges.where("source <> containing_type")
    return own.groupBy(*keys).agg(united("sites"))


def merged_member_edges(edges: DataFrame) -> DataFrame:
    """Uses of members, united over fragments by user and member."""
    return merged_edges(edges, "source", "containing_type", "member_name", "member_symbol_id", "member_kind")


def merged_registrations(registrations: DataFrame) -> DataFrame:
    """Registrations united over fragments; no implementation is one too."""
    return registrations.groupBy("lifetime", "service", "implementation").agg(united("sites"))


def ordered_registrations(registrations: DataFrame) -> DataFrame:
    """Registrations by the rank of their lifetime, not by its name."""
    rank = F.array_position(F.array(*map(F.lit, LIFETIMES)), F.col("lifetime"))
    return registrations.orderBy(rank, "service", F.coalesce("implementation", F.lit("")))


def winners_members(members: DataFrame, types: DataFrame) -> DataFrame:
    """Members (with fragment_ord) of each type's first declarer only."""
    won = types.withColumn("__n", rank_within(["full_name"], [F.col("fragment_ord"), F.col("project_name")])).where("__n = 1").select(F.col("full_name").alias("__f"), F.col("fragment_ord").alias("__o"))
    return members.join(won, (F.col("declaring_type") == F.col("__f")) & (F.col("fragment_ord") == F.col("__o")), "left_semi").drop("fragment_ord")


def external_types(mentions: DataFrame, declared: DataFrame, referenced: DataFrame) -> DataFrame:
    """Outside types from mentions (fragment_ord and type columns): the first mention of each,
    unless declared (full_name) somewhere, and only if referenced (full_name)."""
    first = mentions.withColumn("__n", rank_within(["full_name"], [F.col("fragment_ord")])).where("__n = 1").drop("__n", "fragment_ord")
    return first.join(declared.select("full_name"), "full_name", "left_anti").join(referenced.select("full_name").distinct(), "full_name", "left_semi")


def referenced_names(types: DataFrame, edges: DataFrame, member_edges: DataFrame | None = None) -> DataFrame:
    """(full_name): every type that an edge, a base, an interface or an attribute names."""
    out = edges.select(F.col("target").alias("full_name")).union(edges.select("source"))
    if member_edges is not None:
        out = out.union(member_edges.select("containing_type"))
    for c in ("all_interfaces", "base_type_chain", "attribute_constructions"):
        out = out.union(types.select(F.explode(F.transform(c, lambda x: x.definition))))
    return out.where("full_name is not null").distinct()


def merged_projects(projects: DataFrame) -> DataFrame:
    """Projects by name with all their references."""
    refs = projects.select("name", F.explode_outer("project_references").alias("r"))
    return refs.groupBy("name").agg(F.array_sort(F.collect_set("r")).alias("project_references"))


def retained(facts: DataFrame, project: str, column: str = "project_name") -> DataFrame:
    """Fragment rows without those of one project."""
    return facts.where(F.col(column) != F.lit(project))
