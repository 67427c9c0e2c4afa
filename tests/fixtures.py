"""Small graphs, written by hand."""

from factloom.schema import EDGES, MEMBER_EDGES, MEMBERS, PROJECTS, REGISTRATIONS, TYPES, empty_facts


def site(file, *lines):
    return [{"file": file, "line": n} for n in lines]


def type_row(full_name, project="App", **other):
    namespace, _, name = full_name.rpartition(".")
    row = {
        "full_name": full_name, "symbol_id": f"T:{full_name}", "name": name, "namespace": namespace, "kind": "Class", "accessibility": "Public", "is_sealed": False, "is_static": False, "is_abstract": False, "is_record": False, "project_name": project, "is_external": False,
        "base_type": None, "interfaces": [], "attributes": [], "all_interfaces": [], "base_type_chain": [], "attribute_constructions": [], "declaration_sites": site(f"{namespace.replace('.', '/')}/{name}.x", 1), "file_paths": [],
    }
    return row | other


def built(*pairs):
    return [{"definition": d, "full_name": f} for d, f in pairs]


def member_row(owner, name, kind="Method", **other):
    row = {"declaring_type": owner, "symbol_id": f"{kind[0]}:{owner}.{name}", "name": name, "kind": kind, "accessibility": "Public", "is_static": False, "is_abstract": False, "is_virtual": False, "is_async": False, "return_type": "System.Void" if kind == "Method" else None, "member_type": None if kind == "Method" else "System.Int32", "parameters": [], "declaration_sites": site("m", 1), "file_paths": []}
    return row | other


def graph(spark, types, edges=(), members=(), uses=(), registrations=(), projects=()):
    made = {
        "types": spark.createDataFrame(list(types), TYPES), "edges": spark.createDataFrame([{"family": f, "source": s, "target": t, "sites": site("e", 1, 2)} for f, s, t in edges], EDGES),
        "members": spark.createDataFrame(list(members), MEMBERS), "member_edges": spark.createDataFrame([{"source": s, "containing_type": t, "member_name": n, "member_symbol_id": i, "member_kind": k, "sites": site("u", 3)} for s, t, n, i, k in uses], MEMBER_EDGES),
        "registrations": spark.createDataFrame([(a, b, c, []) for a, b, c in registrations], REGISTRATIONS), "projects": spark.createDataFrame(list(projects), PROJECTS),
    }
    return empty_facts(spark, **made)


def layered(spark):
    """A service that depends on the web layer, which it shouldn't, and on an outside type."""
    names = ["App.Web.Page", "App.Web.Helper", "App.Core.Service", "App.Core.Model", "App.Core.Apple", "App.Core.Zebra"]
    types = [type_row(n) for n in names] + [type_row("Lib.Text.Builder", "Lib", is_external=True, declaration_sites=[])]
    pairs = [("App.Core.Service", t) for t in ("App.Web.Page", "App.Web.Helper", "App.Core.Model", "Lib.Text.Builder")] + [("App.Core.Apple", "App.Web.Page"), ("App.Core.Zebra", "App.Web.Page")]
    return graph(spark, types, [("reference", s, t) for s, t in pairs])


def hierarchy(spark):
    """Interfaces, bases and attributes, open and constructed."""
    handler = ("App.IHandler<T>", "App.IHandler<App.Order>")
    types = [
        type_row("App.Widget", all_interfaces=built(("App.IThing", "App.IThing")), base_type_chain=built(("App.Base", "App.Base"), ("System.Object", "System.Object"))),
        type_row("App.OrderHandler", all_interfaces=built(handler)), type_row("App.TextHandler", all_interfaces=built(("App.IHandler<T>", "App.IHandler<System.String>"))),
        type_row("App.Tagged", attribute_constructions=built(("App.MarkAttribute", "App.MarkAttribute"))), type_row("App.Plain"), type_row("Lib.Outside", "Lib", is_external=True),
    ]
    return graph(spark, types, [("construct", "App.Plain", "App.OrderHandler"), ("construct", "App.Plain", "Lib.Outside")])
