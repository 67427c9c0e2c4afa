"""A fact graph made of the star-schema tables: customers, parts, suppliers and nations are types,
orders are members, and line items give the edges. Names keep the tables' values as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FAMILIES, TYPES, Facts


_read: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whose files are listed once for each application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _read:
        _read[key] = spark.read.parquet(key[1])
    return _read[key]


def customer_name(segment: Column, key: Column) -> Column:
    """The full name of a customer."""
    return F.concat(F.lit("Star.Sales."), segment, F.lit(".Customer"), key.cast("string"))


def part_name(kind: Column, key: Column) -> Column:
    """The full name of a part."""
    return F.concat(F.lit("Star.Catalog."), kind, F.lit(".Part"), key.cast("string"))


def supplier_name(nation: Column, key: Column) -> Column:
    """The full name of a supplier."""
    return F.concat(F.lit("Star.Supply.N"), nation.cast("string"), F.lit(".Supplier"), key.cast("string"))


def nation_name(region: Column, key: Column) -> Column:
    """The full name of a nation."""
    return F.concat(F.lit("Geo.R"), region.cast("string"), F.lit(".Nation"), key.cast("string"))


def _site(file: Column, line: Column) -> Column:
    return F.struct(file.alias("file"), line.cast("int").alias("line"))


def _types(frame: DataFrame, **columns: Column) -> DataFrame:
    false, none = F.lit(False), F.lit(None)
    built = F.array().cast("array<struct<definition:string,full_name:string>>")
    base = {
        "full_name": none, "symbol_id": F.concat(F.lit("T:"), columns["full_name"]), "name": none, "namespace": none, "kind": F.lit("Class"), "accessibility": F.lit("Public"), "is_sealed": false, "is_static": false, "is_abstract": false, "is_record": false, "project_name": none, "is_external": false,
        "base_type": none.cast("string"), "interfaces": F.array().cast("array<string>"), "attributes": F.array().cast("array<string>"), "all_interfaces": built, "base_type_chain": built, "attribute_constructions": built, "declaration_sites": F.array().cast("array<struct<file:string,line:int>>"), "file_paths": F.array().cast("array<string>"),
    } | columns
    return frame.select(*[c.alias(n) for n, c in base.items()])


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types."""
    col, text = F.col, lambda c: F.col(c).cast("string")
    customers = _types(
        table(spark, sf_dir, "customer"),
        full_name=customer_name(col("c_mktsegment"), col("c_custkey")), name=F.concat(F.lit("Customer"), text("c_custkey")), namespace=F.concat(F.lit("Star.Sales."), col("c_mktsegment")), accessibility=F.when(col("c_acctbal") >= 0, "Public").otherwise("Internal"), is_sealed=col("c_custkey") % 2 == 0, project_name=F.lit("Sales"),
        declaration_sites=F.array(_site(F.concat(F.lit("customer/N"), text("c_nationkey")), col("c_custkey"))), file_paths=F.array(F.concat(F.lit("customer/N"), text("c_nationkey"))),
    )
    space, root = F.concat(F.lit("Star.Catalog."), col("p_type")), F.concat(F.lit("Star.Catalog."), col("p_type"), F.lit("Base"))
    tag, abstract = F.concat(F.lit("Star.Tags."), col("p_brand")), col("p_size") % 5 == 0
    pair = lambda d, f: F.struct(d.alias("definition"), f.alias("full_name"))
    stock = F.concat(F.lit("Star.IStock<"), col("p_type"), F.lit(">"))
    parts = _types(
        table(spark, sf_dir, "part"),
        full_name=part_name(col("p_type"), col("p_partkey")), name=F.concat(F.lit("Part"), text("p_partkey")), namespace=space, kind=F.when(abstract, "Interface").otherwise("Class"), is_abstract=abstract, project_name=F.lit("Catalog"), base_type=root, interfaces=F.array(F.lit("Star.IStock<T>")), attributes=F.array(tag),
        all_interfaces=F.array(pair(F.lit("Star.IStock<T>"), stock)), base_type_chain=F.array(pair(root, root), pair(F.lit("System.Object"), F.lit("System.Object"))), attribute_constructions=F.array(pair(tag, tag)),
        declaration_sites=F.array(_site(F.concat(F.lit("part/S"), text("p_size")), col("p_partkey"))), file_paths=F.array(F.concat(F.lit("part/S"), text("p_size"))),
    )
    suppliers = _types(
        table(spark, sf_dir, "supplier"),
        full_name=supplier_name(col("s_nationkey"), col("s_suppkey")), name=F.concat(F.lit("Supplier"), text("s_suppkey")), namespace=F.concat(F.lit("Star.Supply.N"), text("s_nationkey")), is_static=col("s_acctbal") < 0, project_name=F.lit("Supply"),
        declaration_sites=F.array(_site(F.concat(F.lit("supplier/N"), text("s_nationkey")), col("s_suppkey"))), file_paths=F.array(F.concat(F.lit("supplier/N"), text("s_nationkey"))),
    )
    nations = _types(
        table(spark, sf_dir, "nation"),
        full_name=nation_name(col("n_regionkey"), col("n_nationkey")), name=F.concat(F.lit("Nation"), text("n_nationkey")), namespace=F.concat(F.lit("Geo.R"), text("n_regionkey")), project_name=F.lit("Geo"), is_external=F.lit(True),
    )
    return customers.unionByName(parts).unionByName(suppliers).unionByName(nations)


def _keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Names by key."""
    col = F.col
    return {
        "customer": table(spark, sf_dir, "customer").select("c_custkey", customer_name(col("c_mktsegment"), col("c_custkey")).alias("customer"), "c_nationkey"),
        "part": table(spark, sf_dir, "part").select("p_partkey", part_name(col("p_type"), col("p_partkey")).alias("part"), "p_size"),
        "supplier": table(spark, sf_dir, "supplier").select("s_suppkey", supplier_name(col("s_nationkey"), col("s_suppkey")).alias("supplier"), "s_nationkey"),
        "nation": table(spark, sf_dir, "nation").select("n_nationkey", nation_name(col("n_regionkey"), col("n_nationkey")).alias("nation")),
    }


def lines(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Line items with the named ones of customer, part, supplier, and the nation of the supplier,
    by their full names; tables that aren't named aren't read."""
    k = _keys(spark, sf_dir)
    own = table(spark, sf_dir, "lineitem")
    if "customer" in names:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        own = own.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(k["customer"], F.col("o_custkey") == F.col("c_custkey"))
    if "part" in names:
        own = own.join(k["part"], F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in names or "nation" in names:
        own = own.join(k["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    if "nation" in names:
        own = own.join(k["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    site = _site(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"))
    return own.withColumn("site", site)


def collected_sites() -> Column:
    """The distinct sites of a group, in order."""
    return F.array_sort(F.collect_set("site")).alias("sites")


def _among(frame: DataFrame, name: Column, names: DataFrame | None) -> DataFrame:
    """The rows of frame whose name is in names, a table of one column; all without it."""
    return frame if names is None else frame.join(names.toDF("__among"), name == F.col("__among"), "left_semi")


def _end(spark: SparkSession, sf_dir: str, kind: str, names: DataFrame | None) -> tuple[DataFrame, list[str], Column]:
    """The rows of a key table that are types of names, its columns that make up the name, the key
    first, and the name: lines are joined and grouped by numbers, names come last."""
    col = F.col
    columns, name = {
        "customer": (["c_custkey", "c_mktsegment"], customer_name(col("c_mktsegment"), col("c_custkey"))),
        "part": (["p_partkey", "p_type"], part_name(col("p_type"), col("p_partkey"))),
        "supplier": (["s_suppkey", "s_nationkey"], supplier_name(col("s_nationkey"), col("s_suppkey"))),
        "nation": (["n_nationkey", "n_regionkey"], nation_name(col("n_regionkey"), col("n_nationkey"))),
    }[kind]
    return _among(table(spark, sf_dir, kind).select(*columns), name, names), columns, name


def _line_edges(spark: SparkSession, sf_dir: str, source: str, target: str, where: str | None = None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, sites) of the line items that where holds for: edges between two of customer,
    part, supplier and the nation of the supplier, whose names are among sources and targets.

    Customers are joined to their orders before the lines, which move once for each join by a key,
    and the groups lie as the last join leaves them.
    """
    own = table(spark, sf_dir, "lineitem")
    own = own if where is None else own.where(where)
    ends = {source: _end(spark, sf_dir, source, sources), target: _end(spark, sf_dir, target, targets)}
    if "customer" in ends:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(ends["customer"][0], F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
        own = own.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    if "supplier" in ends or "nation" in ends:
        suppliers = ends["supplier"][0] if "supplier" in ends else _end(spark, sf_dir, "supplier", None)[0]
        if "nation" in ends:
            suppliers = suppliers.join(ends["nation"][0], F.col("s_nationkey") == F.col("n_nationkey"))
        own = own.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    if "part" in ends:
        own = own.join(ends["part"][0], F.col("l_partkey") == F.col("p_partkey"))
    (_, by, name), (_, by_too, name_too) = ends[source], ends[target]
    grouped = own.groupBy(*by, *by_too).agg(F.collect_set(F.struct("l_orderkey", F.col("l_linenumber").cast("int").alias("line"))).alias("__at"))
    return grouped.select(name.alias("source"), name_too.alias("target"), F.array_sort(F.transform("__at", lambda x: _site(F.concat(F.lit("orders/"), x.l_orderkey.cast("string")), x.line))).alias("sites"))


def _home_edges(spark: SparkSession, sf_dir: str, kind: str, sources: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    """(source, target, sites): customers or suppliers and their nation."""
    name, (nations, _, nation) = _end(spark, sf_dir, kind, None)[2], _end(spark, sf_dir, "nation", targets)
    key = "c_nationkey" if kind == "customer" else "s_nationkey"
    own = _among(table(spark, sf_dir, kind), name, sources)
    site = _site(F.concat(F.lit(f"{kind}/N"), F.col(key).cast("string")), F.lit(1))
    named = own.join(nations, F.col(key) == F.col("n_nationkey")).select(name.alias("source"), nation.alias("target"), site.alias("site"))
    return named.groupBy("source", "target").agg(collected_sites())


def edge_family(spark: SparkSession, sf_dir: str, family: str, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The edges of one family; with sources or targets, tables of one column, only those whose ends
    are among these names. Parts of a family never share an edge, so each is grouped on its own."""
    line = lambda source, target, where=None: _line_edges(spark, sf_dir, source, target, where, sources, targets)
    home = lambda kind: _home_edges(spark, sf_dir, kind, sources, targets)
    match family:
        case "reference":
            parts = [line("customer", "part"), home("customer"), home("supplier")]
        case "construct":
            parts = [line("customer", "part", "l_returnflag = 'R'")]
        case "inject":
            parts = [line("part", "supplier", "l_linestatus = 'O'")]
        case "catch":
            parts = [line("supplier", "part", "l_returnflag = 'A'")]
        case "throw":
            parts = [line("customer", "nation", "l_linestatus = 'F'"), line("customer", "supplier", "l_linestatus = 'F'")]
        case "expose":
            parts = [line("supplier", "part", "l_discount >= 0.09"), home("supplier")]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    return own.select(F.lit(family).alias("family"), "source", "target", "sites")


def edges_of(spark: SparkSession, sf_dir: str, *families: str) -> DataFrame:
    """The named families."""
    parts = [edge_family(spark, sf_dir, f) for f in families]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families; a filter on family leaves the others unread."""
    return edges_of(spark, sf_dir, *FAMILIES)


def _member_columns(customer: Column) -> dict[str, Column]:
    col = F.col
    name = F.concat(F.lit("Order"), col("o_orderkey").cast("string"), F.when(F.substring("o_orderpriority", 1, 1) == "1", "Async").otherwise(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1))))
    kind = F.when(col("o_orderstatus") == "F", "Method").when(col("o_orderstatus") == "O", F.when(col("o_orderkey") % 8 == 0, "Event").otherwise("Property")).otherwise("Field")
    return {"name": name, "kind": kind, "symbol": F.concat(F.substring(kind, 1, 1), F.lit(":"), customer, F.lit("."), name)}


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of their customers."""
    col = F.col
    own = table(spark, sf_dir, "orders").join(_keys(spark, sf_dir)["customer"], col("o_custkey") == col("c_custkey"))
    accepted = lines(spark, sf_dir, "part").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("p"), col("l_partkey").cast("string")).alias("name"), col("part").alias("type_full_name")))).alias("parameters"))
    m = _member_columns(col("customer"))
    status = F.concat(F.lit("Status."), col("o_orderpriority"))
    none = F.array().cast("array<struct<name:string,type_full_name:string>>")
    file = F.concat(F.lit("customer/N"), col("c_nationkey").cast("string"))
    return own.join(accepted, col("o_orderkey") == col("l_orderkey"), "left").select(
        col("customer").alias("declaring_type"), m["symbol"].alias("symbol_id"), m["name"].alias("name"), m["kind"].alias("kind"),
        F.when(col("o_totalprice") >= 200000, "Public").when(col("o_orderkey") % 3 == 0, "Internal").otherwise("Private").alias("accessibility"),
        (col("o_orderkey") % 2 == 0).alias("is_static"), (col("o_orderkey") % 5 == 0).alias("is_abstract"), (col("o_orderkey") % 7 == 0).alias("is_virtual"), (F.substring("o_orderpriority", 1, 1) == "1").alias("is_async"),
        F.when(m["kind"] == "Method", status).alias("return_type"), F.when(m["kind"] != "Method", status).alias("member_type"),
        F.when((m["kind"] == "Method") & col("parameters").isNotNull(), col("parameters")).otherwise(none).alias("parameters"),
        F.array(_site(file, col("o_orderkey"))).alias("declaration_sites"), F.array(file).alias("file_paths"),
    )


def member_edges(spark: SparkSession, sf_dir: str, sources: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Suppliers use the orders that they have a line item of; with sources (names) only these
    suppliers, with members (containing type, name) only these orders."""
    col = F.col
    suppliers, by, supplier = _end(spark, sf_dir, "supplier", sources)
    customers, by_too, customer = _end(spark, sf_dir, "customer", None)
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(customers, col("o_custkey") == col("c_custkey"))
    m = _member_columns(customer)
    if members is not None:
        own = own.join(members.toDF("__type", "__name"), (customer == col("__type")) & (m["name"] == col("__name")), "left_semi")
    lines_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", col("l_linenumber").cast("int").alias("line"))
    used = lines_.join(own, col("l_orderkey") == col("o_orderkey")).join(suppliers, col("l_suppkey") == col("s_suppkey"))
    grouped = used.groupBy(*by, *by_too, "o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.collect_set(F.struct("line")).alias("__at"))
    site = F.array_sort(F.transform("__at", lambda x: _site(F.concat(F.lit("orders/"), col("o_orderkey").cast("string")), x.line))).alias("sites")
    return grouped.select(supplier.alias("source"), customer.alias("containing_type"), m["name"].alias("member_name"), m["symbol"].alias("member_symbol_id"), m["kind"].alias("member_kind"), site)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines register their part; with a lifetime by its size, and without a supplier if returned goods are none."""
    col = F.col
    own = lines(spark, sf_dir, "part", "supplier").where("l_linenumber = 1")
    lifetime = F.when(col("p_size") % 3 == 0, "Singleton").when(col("p_size") % 3 == 1, "Scoped").otherwise("Transient")
    made = own.select(lifetime.alias("lifetime"), col("part").alias("service"), F.when(col("l_returnflag") != "N", col("supplier")).alias("implementation"), "site")
    return made.groupBy("lifetime", "service", "implementation").agg(collected_sites())


def projects(spark: SparkSession) -> DataFrame:
    """The projects and what they declare to use."""
    rows = [("Catalog", ["Supply"]), ("Sales", ["Catalog", "Supply", "Unused"]), ("Supply", []), ("Unused", [])]
    return spark.createDataFrame(rows, "name string, project_references array<string>")


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The whole graph; what a query doesn't use isn't computed."""
    made = {"types": types, "edges": edges, "members": members, "member_edges": member_edges, "registrations": registrations}
    narrowed = {"edges": lambda family, *among: edge_family(spark, sf_dir, family, *among), "member_edges": lambda *among: member_edges(spark, sf_dir, *among)}
    return Facts(narrowed, projects=lambda: projects(spark), **{n: lambda f=f: f(spark, sf_dir) for n, f in made.items()})


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers of nations with an even key."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("customer/N"), F.col("n_nationkey").cast("string")).alias("path"))


def fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three fragments by line number: declared types (fragment_ord, project and TYPES) and
    reference edges (fragment_ord, source, target, sites). A type is declared by each fragment that
    mentions it, under another project's name if its key ends in 0 and the fragment isn't the first."""
    col = F.col
    own = lines(spark, sf_dir, "customer", "part").select((col("l_linenumber") % 3).alias("fragment_ord"), "customer", "part", "site")
    mentions = own.select("fragment_ord", col("customer").alias("n")).union(own.select("fragment_ord", "part")).distinct()
    declared = mentions.join(types(spark, sf_dir), col("n") == col("full_name")).drop("n")
    other = (col("name").endswith("0")) & (col("fragment_ord") > 0)
    project = F.when(other, F.concat(col("project_name"), F.lit("Copy"), col("fragment_ord").cast("string"))).otherwise(col("project_name"))
    declared = declared.withColumn("project_name", project)
    linked = own.groupBy("fragment_ord", col("customer").alias("source"), col("part").alias("target")).agg(collected_sites())
    return declared.select("fragment_ord", *[c.split()[0] for c in _names()]), linked


def _names() -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TYPES).names
