"""Surveys of a graph: what depends on what, by project and by namespace, and where things are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import namespace_root
from ..schema import Facts
from ..spec import Model
from .select import select_types


def _placed(facts: Facts) -> DataFrame:
    """Reference edges with project, namespace and outside flag of both ends."""
    node = lambda p: facts.types.select(F.col("full_name").alias(p), F.col("project_name").alias(f"{p}_project"), F.col("namespace").alias(f"{p}_namespace"), F.col("is_external").alias(f"{p}_external"))
    own = facts.edges.where("family = 'reference'").select("source", "target")
    return own.join(node("source"), "source").join(node("target"), "target").where("not source_external")


def project_edges(facts: Facts) -> DataFrame:
    """(source_project, target_project, pairs): pairs of types that cross from project to project."""
    own = _placed(facts).where("not target_external and source_project <> target_project")
    return own.groupBy("source_project", "target_project").agg(F.count("*").alias("pairs"))


def external_edges(facts: Facts) -> DataFrame:
    """(source_project, root, pairs): pairs of types that lead out of the graph, by root of the namespace."""
    own = _placed(facts).where("target_external")
    return own.groupBy("source_project", namespace_root(F.col("target_namespace")).alias("root")).agg(F.count("*").alias("pairs"))


def namespaces(facts: Facts) -> DataFrame:
    """(project, namespace, types): a project without types has one row with null and 0."""
    counted = facts.types.where("not is_external").groupBy(F.col("project_name").alias("project"), "namespace").agg(F.count("*").alias("types"))
    return facts.projects.select(F.col("name").alias("project")).join(counted, "project", "left").select("project", "namespace", F.coalesce("types", F.lit(0)).cast("long").alias("types"))


def unused_references(facts: Facts) -> DataFrame:
    """(project, reference): declared references between projects that no edge bears out."""
    declared = facts.projects.select(F.col("name").alias("project"), F.explode("project_references").alias("reference"))
    seen = project_edges(facts).select(F.col("source_project").alias("project"), F.col("target_project").alias("reference"))
    return declared.join(seen, ["project", "reference"], "left_anti")


def directory_segments(path: Column) -> Column:
    """The segments of a path, with either slash, less the file's name."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def ancestors(path: Column) -> Column:
    """All directories that a path lies in, from the top."""
    parts = directory_segments(path)
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def deepest_common_directory(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, directory): for each group of files (file), the deepest directory that holds them all.

    It is the last segment place up to which the group agrees: the least and the greatest path, in
    order of their segments, agree just as far as all do, so two values for each group suffice.
    """
    parts = directory_segments(F.col("file"))
    ends = files.select(*keys, parts.alias("p")).groupBy(*keys).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda acc, eq: F.struct((acc.on & eq).alias("on"), F.when(acc.on & eq, acc.n + 1).otherwise(acc.n).alias("n")), lambda acc: acc.n)
    return ends.select(*keys, F.array_join(F.slice("a", 1, same), "/").alias("directory"))


def _files(facts: Facts, selection) -> DataFrame:
    return select_types(facts, selection).select(F.explode("declaration_sites").alias("s")).select(F.col("s.file").alias("file")).distinct()


def frozen_places(facts: Facts, model: Model) -> list[tuple[str, DataFrame]]:
    """For each frozen area, where its types are."""
    return [(r.id.removesuffix("/containment"), deepest_common_directory(_files(facts, r.frozen))) for r in model.rules if r.role == "containment"]


def layer_places(facts: Facts, model: Model) -> list[tuple[str, list[str], DataFrame]]:
    """For each layer that is the subject of an enforced or migrating rule, these rules and where its types are."""
    from ..spec import Selection

    out = []
    for name, noun in model.layers.items():
        rules = [r.id for r in model.rules if r.posture in ("enforce", "migrate") and r.constraint and r.constraint.types.noun == noun]
        if rules:
            out.append((name, rules, deepest_common_directory(_files(facts, Selection(0, noun)))))
    return out


def covering(places: DataFrame, path: str) -> DataFrame:
    """Places (directory) that are path or lie above it, segment by segment."""
    own = path.replace("\\", "/").rstrip("/")
    d = F.rtrim(F.translate("directory", "\\", "/"), F.lit("/"))
    return places.where((F.lit(own) == d) | F.lit(own).startswith(F.concat(d, F.lit("/"))))


def explain(model: Model, rule_id: str):
    """The rule of this id; if there is none, the ids in order."""
    found = [r for r in model.rules if r.id == rule_id]
    return found[0] if found else sorted(r.id for r in model.rules)
