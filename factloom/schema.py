"""The tables of a fact graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITES = "array<struct<file:string,line:int>>"
_BUILT = "array<struct<definition:string,full_name:string>>"
TYPES = f"""full_name string, symbol_id string, name string, namespace string, kind string, accessibility string,
 is_sealed boolean, is_static boolean, is_abstract boolean, is_record boolean, project_name string, is_external boolean,
 base_type string, interfaces array<string>, attributes array<string>, all_interfaces {_BUILT}, base_type_chain {_BUILT},
 attribute_constructions {_BUILT}, declaration_sites {SITES}, file_paths array<string>"""
MEMBERS = f"""declaring_type string, symbol_id string, name string, kind string, accessibility string, is_static boolean,
 is_abstract boolean, is_virtual boolean, is_async boolean, return_type string, member_type string,
 parameters array<struct<name:string,type_full_name:string>>, declaration_sites {SITES}, file_paths array<string>"""
EDGES = f"family string, source string, target string, sites {SITES}"
MEMBER_EDGES = f"source string, containing_type string, member_name string, member_symbol_id string, member_kind string, sites {SITES}"
REGISTRATIONS = f"lifetime string, service string, implementation string, sites {SITES}"
PROJECTS = "name string, project_references array<string>"
BASELINE = "rule_id string, source string, target string, subject string, because string"
VIOLATIONS = f"""rule_id string, kind string, source string, target string, subject string, member_symbol_id string,
 member_display string, sites {SITES}, detail string, id_source string, id_target string, id_subject string"""

FAMILIES = ("reference", "construct", "inject", "catch", "throw", "expose")
LIFETIMES = ("Singleton", "Scoped", "Transient")
KINDS = ("Class", "Interface", "Struct", "Enum", "Delegate")
ACCESS = ("Public", "Internal", "Protected", "ProtectedInternal", "PrivateProtected", "Private")
MEMBER_KINDS = ("Method", "Property", "Field", "Event")


class Facts:
    """A fact graph: the tables types, edges, members, member_edges, registrations and projects.

    A table may be given as a function without arguments, which is called when first needed.
    narrowed holds functions that make the table edges or member_edges of a few types only, for
    sources that can leave others out before they group: a join that follows won't move below it.
    """

    types: DataFrame
    edges: DataFrame
    members: DataFrame
    member_edges: DataFrame
    registrations: DataFrame
    projects: DataFrame

    def __init__(self, narrowed: dict[str, Callable[..., DataFrame]] | None = None, /, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        self._tables = tables
        self._narrowed = narrowed or {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        made = self._tables[name]
        if not isinstance(made, DataFrame):
            made = self._tables[name] = made()
        return made

    def with_(self, **tables: DataFrame | Callable[[], DataFrame]) -> Facts:
        """The same graph with some tables replaced."""
        return Facts({n: f for n, f in self._narrowed.items() if n not in tables}, **(self._tables | tables))

    def edges_among(self, family: str, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """(source, target, sites) of a family, of the sources and targets named (tables of one
        column), or of all."""
        if "edges" in self._narrowed:
            return self._narrowed["edges"](family, sources, targets).select("source", "target", "sites")
        own = self.edges.where(F.col("family") == family).select("source", "target", "sites")
        for end, names in (("source", sources), ("target", targets)):
            own = own if names is None else own.join(names.toDF("__among"), F.col(end) == F.col("__among"), "left_semi")
        return own

    def uses_among(self, sources: DataFrame, members: DataFrame) -> DataFrame:
        """The member_edges of the sources named, to members (containing type, name)."""
        if "member_edges" in self._narrowed:
            return self._narrowed["member_edges"](sources, members)
        same = (F.col("containing_type") == F.col("__type")) & (F.col("member_name") == F.col("__name"))
        return self.member_edges.join(sources.toDF("__among"), F.col("source") == F.col("__among"), "left_semi").join(members.toDF("__type", "__name"), same, "left_semi")


#: Names and schemas of the tables of Facts.
TABLES = {"types": TYPES, "edges": EDGES, "members": MEMBERS, "member_edges": MEMBER_EDGES, "registrations": REGISTRATIONS, "projects": PROJECTS}


def empty_facts(spark: SparkSession, **tables: DataFrame) -> Facts:
    """A graph of the given tables; the others are empty."""
    return Facts(**{n: tables.get(n) if n in tables else spark.createDataFrame([], s) for n, s in TABLES.items()})


def check_schema(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of schema, in its order; a missing column or another type is an error."""
    want = T.StructType.fromDDL(schema)
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in want if f.name not in have]
    wrong = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want if f.name in have and have[f.name].simpleString() != f.dataType.simpleString()]
    if missing or wrong:
        raise ValueError("; ".join([*(f"{m} is missing" for m in missing), *wrong]))
    return df.select(*want.names)
