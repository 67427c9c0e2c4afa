"""A query for each operator, over the star-schema tables, and SQL that says the same in DuckDB."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import names, patterns
from .functions.names import TypeRef
from .operators import baseline as upkeep
from .operators import extract, incremental, merge, survey
from .operators.select import ordered_members, select_members, select_types
from .plans import check as verdict
from .plans import render
from .plans.compile import evaluate
from .schema import BASELINE, Facts
from .session import written
from .sources import baselines, star
from .sources.tables import changed_files
from .spec import Constraint, MemberSelection, Selection, Spec

Query = Callable[[SparkSession, str], DataFrame]

# The same facts in SQL, written on their own. A site is an order and a line.
TYPES_SQL = """
types AS (
  SELECT 'Star.Sales.' || c_mktsegment || '.Customer' || c_custkey AS full_name, 'Customer' || c_custkey AS name, 'Star.Sales.' || c_mktsegment AS namespace,
    'Class' AS kind, CASE WHEN c_acctbal >= 0 THEN 'Public' ELSE 'Internal' END AS access, c_custkey % 2 = 0 AS sealed, FALSE AS static, FALSE AS abstract, 'Sales' AS project, FALSE AS ext,
    '' AS base, '' AS iface, '' AS attr, 'customer/N' || c_nationkey AS file, c_custkey AS k FROM customer
  UNION ALL SELECT 'Star.Catalog.' || p_type || '.Part' || p_partkey, 'Part' || p_partkey, 'Star.Catalog.' || p_type, CASE WHEN p_size % 5 = 0 THEN 'Interface' ELSE 'Class' END, 'Public', FALSE, FALSE, p_size % 5 = 0, 'Catalog', FALSE,
    'Star.Catalog.' || p_type || 'Base', 'Star.IStock<' || p_type || '>', 'Star.Tags.' || p_brand, 'part/S' || p_size, p_partkey FROM part
  UNION ALL SELECT 'Star.Supply.N' || s_nationkey || '.Supplier' || s_suppkey, 'Supplier' || s_suppkey, 'Star.Supply.N' || s_nationkey, 'Class', 'Public', FALSE, s_acctbal < 0, FALSE, 'Supply', FALSE, '', '', '', 'supplier/N' || s_nationkey, s_suppkey FROM supplier
  UNION ALL SELECT 'Geo.R' || n_regionkey || '.Nation' || n_nationkey, 'Nation' || n_nationkey, 'Geo.R' || n_regionkey, 'Class', 'Public', FALSE, FALSE, FALSE, 'Geo', TRUE, '', '', '', '', n_nationkey FROM nation
)"""
LINES_SQL = """
li AS (
  SELECT l.*, 'Star.Sales.' || c_mktsegment || '.Customer' || c_custkey AS cust, 'Star.Catalog.' || p_type || '.Part' || p_partkey AS part, 'Star.Supply.N' || s_nationkey || '.Supplier' || s_suppkey AS supp,
    'Geo.R' || n_regionkey || '.Nation' || n_nationkey AS nat, p_size, o_orderstatus, o_orderpriority, o_orderkey, c_nationkey
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
_HOME = "SELECT {who}, 'Geo.R' || n_regionkey || '.Nation' || n_nationkey, '{frm}/N' || {key}, 1 FROM {frm} JOIN nation ON {key} = n_nationkey"
_CUST = _HOME.format(who="'Star.Sales.' || c_mktsegment || '.Customer' || c_custkey", frm="customer", key="c_nationkey")
_SUPP = _HOME.format(who="'Star.Supply.N' || s_nationkey || '.Supplier' || s_suppkey", frm="supplier", key="s_nationkey")
_RAW = {
    "reference": f"SELECT cust AS source, part AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li UNION ALL {_CUST} UNION ALL {_SUPP}",
    "construct": "SELECT cust AS source, part AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li WHERE l_returnflag = 'R'",
    "inject": "SELECT part AS source, supp AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li WHERE l_linestatus = 'O'",
    "catch": "SELECT supp AS source, part AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li WHERE l_returnflag = 'A'",
    "throw": "SELECT cust AS source, nat AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li WHERE l_linestatus = 'F' UNION ALL SELECT cust, supp, 'orders/' || l_orderkey, l_linenumber FROM li WHERE l_linestatus = 'F'",
    "expose": f"SELECT supp AS source, part AS target, 'orders/' || l_orderkey AS f, l_linenumber AS n FROM li WHERE l_discount >= 0.09 UNION ALL {_SUPP}",
}
MEMBERS_SQL = """
mem AS (
  SELECT *, left(kind, 1) || ':' || owner || '.' || name AS id FROM (
    SELECT 'Star.Sales.' || c_mktsegment || '.Customer' || c_custkey AS owner, 'Customer' || c_custkey AS owner_name, o_orderkey AS ok, o_orderpriority AS prio, o_totalprice AS price,
      'Order' || o_orderkey || CASE WHEN o_orderpriority LIKE '1%' THEN 'Async' ELSE 'P' || substr(o_orderpriority, 1, 1) END AS name,
      CASE o_orderstatus WHEN 'F' THEN 'Method' WHEN 'O' THEN CASE WHEN o_orderkey % 8 = 0 THEN 'Event' ELSE 'Property' END ELSE 'Field' END AS kind,
      CASE WHEN o_totalprice >= 200000 THEN 'Public' WHEN o_orderkey % 3 = 0 THEN 'Internal' ELSE 'Private' END AS access, 'customer/N' || c_nationkey AS file
    FROM orders JOIN customer ON o_custkey = c_custkey)
)"""


def sites_sql(file: str = "'orders/' || l_orderkey", line: str = "l_linenumber") -> str:
    """An aggregate: the distinct sites of a group, in order, as sites() writes them."""
    return f"array_to_string(list_transform(list_sort(list_distinct(list({{'f': {file}, 'n': {line}}}))), lambda x: x.f || ':' || x.n), ' ')"


def family_sql(family: str) -> str:
    """A CTE of a family's edges with their sites."""
    return f"{family} AS (SELECT source, target, {sites_sql('f', 'n')} AS sites_text FROM ({_RAW[family]}) GROUP BY ALL)"


def sql(body: str, *ctes: str) -> str:
    """A query over CTEs; families by name."""
    parts = [LINES_SQL if c == "li" else TYPES_SQL if c == "types" else MEMBERS_SQL if c == "mem" else family_sql(c) if c in _RAW else c for c in ctes]
    return f"WITH {', '.join(parts)}\n{body}"


def types_sql(where: str) -> str:
    """Names of types."""
    return sql(f"SELECT full_name FROM types WHERE {where}", "types")


def edges_sql(family: str, kind: str, where: str) -> str:
    """Edges that break a rule; s and t are the types at their ends."""
    body = f"SELECT '{kind}' AS kind, e.source, e.target, sites_text FROM {family} e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE {where}"
    return sql(body, "types", "li", family)


def shape_sql(where: str) -> str:
    """Types that break a rule."""
    return sql(f"SELECT 'Shape' AS kind, full_name AS subject FROM types WHERE NOT ext AND ({where})", "types")


def member_sql(where: str) -> str:
    """Members that break a rule."""
    return sql(f"SELECT 'MemberShape' AS kind, id AS member, owner_name || '.' || name || CASE WHEN kind = 'Method' THEN '()' ELSE '' END AS display FROM mem WHERE {where}", "mem")


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _SQL[name] = oracle


def _types(name: str, make: Callable[[Spec], Selection], oracle: str, position: str = "subject") -> None:
    _add(name, lambda spark, d: select_types(star.facts(spark, d), make(Spec()), position).select("full_name"), oracle)


def _members(name: str, make: Callable[[Spec], MemberSelection], where: str) -> None:
    _add(name, lambda spark, d: select_members(star.facts(spark, d), make(Spec())).select(F.col("symbol_id").alias("member")), sql(f"SELECT id AS member FROM mem WHERE {where}", "mem"))


def ruled(*makes: Callable[[Spec], Constraint]) -> Spec:
    """A spec of enforced rules r0, r1 and so on."""
    s = Spec()
    for i, make in enumerate(makes):
        s.rule(f"r{i}").enforce(make(s)).because("it is so")
    return s


def _violations(*makes: Callable[[Spec], Constraint]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: evaluate(star.facts(spark, d), ruled(*makes).build().rules).violations


def sites(column: str = "sites") -> F.Column:
    """The sites in their order, as text."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x.file, x.line)), " ").alias("sites_text")


def _edge(name: str, make: Callable[[Spec], Constraint], oracle: str) -> None:
    own = _violations(make)
    _add(name, lambda spark, d: own(spark, d).select("kind", "source", "target", sites()), oracle)


def _shape(name: str, make: Callable[[Spec], Constraint], where: str) -> None:
    own = _violations(make)
    _add(name, lambda spark, d: own(spark, d).select("kind", "subject"), shape_sql(where))


def _member(name: str, make: Callable[[Spec], Constraint], where: str) -> None:
    own = _violations(make)
    _add(name, lambda spark, d: own(spark, d).select("kind", F.col("member_symbol_id").alias("member"), F.col("member_display").alias("display")), member_sql(where))


STOCK, CLOSED = TypeRef.of("Star.IStock<T>"), TypeRef("Star.IStock<T>", "Star.IStock<ECONOMY>")
CATALOG, SALES, SUPPLY = "Star.Catalog.*", "Star.Sales.*", "Star.Supply.*"


def sales_subject(s: Spec) -> Selection:
    """Customers of one segment."""
    return s.layer("Building", "Star.Sales.BUILDING")


# nouns
_types("n01_types", lambda s: s.types(), types_sql("NOT ext"), "target")
_types("n02_layer", lambda s: s.layer("Mixed", "Star.Sales.BUILDING", "Star.Catalog.ECON*"), types_sql("namespace = 'Star.Sales.BUILDING' OR namespace LIKE 'Star.Catalog.ECON%'"))
_types("n03_namespace", lambda s: s.namespace("Geo.*"), types_sql("namespace LIKE 'Geo.%'"), "target")
_types("n04_project", lambda s: s.project("Geo"), types_sql("project = 'Geo'"), "target")
_types("n05_type", lambda s: s.type("Geo.R0.Nation0"), types_sql("full_name = 'Geo.R0.Nation0'"), "target")
_REG = "reg AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Scoped' ELSE 'Transient' END AS life, part, CASE WHEN l_returnflag <> 'N' THEN supp END AS impl FROM li WHERE l_linenumber = 1)"
_types("n06_registered_lifetime", lambda s: s.registered("Singleton"), sql("SELECT part AS full_name FROM reg WHERE life = 'Singleton' UNION SELECT impl FROM reg WHERE life = 'Singleton' AND impl IS NOT NULL", "li", _REG))
_types("n07_registered", lambda s: s.registered(), sql("SELECT part AS full_name FROM reg UNION SELECT impl FROM reg WHERE impl IS NOT NULL", "li", _REG))
# filters
_types("a01_in_namespace", lambda s: s.types().in_namespace("Star.*.N1*"), types_sql("regexp_full_match(namespace, 'Star\\.[^.]+\\.N1[^.]*')"))
_types("a02_of_kind", lambda s: s.types().of_kind("Interface"), types_sql("kind = 'Interface'"))
_types("a03_with_suffix", lambda s: s.types().with_suffix("7"), types_sql("NOT ext AND right(name, 1) = '7'"))
_types("a04_with_prefix", lambda s: s.types().with_prefix("Supp"), types_sql("left(name, 4) = 'Supp'"))
_types("a05_with_name_matching", lambda s: s.types().with_name_matching("*r*1"), types_sql("NOT ext AND regexp_full_match(name, '.*r.*1')"))
_types("a06_implementing", lambda s: s.types().implementing(STOCK), types_sql("iface <> ''"))
_types("a06_implementing_closed", lambda s: s.types().implementing(CLOSED), types_sql("iface = 'Star.IStock<ECONOMY>'"))
_types("a07_derived_from", lambda s: s.types().derived_from("Star.Catalog.ECONOMYBase"), types_sql("base = 'Star.Catalog.ECONOMYBase'"))
_types("a08_attributed_with", lambda s: s.types().attributed_with("Star.Tags.Brand#11"), types_sql("attr = 'Star.Tags.Brand#11'"))
_types("a09_except", lambda s: s.types().except_(s.namespace("Star.Catalog.*").of_kind("Class")).with_suffix("3"), types_sql("NOT ext AND right(name, 1) = '3' AND NOT (namespace LIKE 'Star.Catalog.%' AND kind = 'Class')"))
_types("a10_where", lambda s: s.types().where(lambda t: F.length(t.name) > 11, "have long names"), types_sql("NOT ext AND length(name) > 11"))
_types("a10_where_python", lambda s: s.project("Supply").where(lambda t: int(t["name"][8:]) % 4 == 1, "are every fourth", python=True), types_sql("project = 'Supply' AND k % 4 = 1"))
# members
_members("p01_members", lambda s: s.namespace("Star.Sales.BUILDING").members, "owner LIKE 'Star.Sales.BUILDING.%'")
_members("p02_methods", lambda s: s.namespace(SALES).methods, "kind = 'Method'")
_members("p03_properties", lambda s: s.namespace(SALES).properties, "kind = 'Property'")
_members("p04_fields", lambda s: s.namespace(SALES).fields, "kind = 'Field'")
_members("p05_events", lambda s: s.namespace(SALES).events, "kind = 'Event'")
_members("m01_with_suffix", lambda s: s.types().members.with_suffix("Async"), "right(name, 5) = 'Async'")
_members("m02_with_prefix", lambda s: s.types().members.with_prefix("Order12"), "left(name, 7) = 'Order12'")
_members("m03_with_name_matching", lambda s: s.types().members.with_name_matching("Order*5P*"), "regexp_full_match(name, 'Order.*5P.*')")
_members("m04_returning", lambda s: s.types().methods.returning("Status.1-URGENT", "Status.2-HIGH"), "kind = 'Method' AND prio IN ('1-URGENT', '2-HIGH')")
_members("m05_where", lambda s: s.types().members.where(lambda m: m.is_static & m.is_abstract, "are static and abstract"), "ok % 10 = 0")


def _placed(ordered: DataFrame, *keys: str) -> DataFrame:
    """ordered with the place of each row among those of its keys, as it came."""
    numbered = ordered.withColumn("__n", F.monotonically_increasing_id())
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__n")).cast("long")).drop("__n")


_add("m06_order", lambda spark, d: _placed(ordered_members(select_members(star.facts(spark, d), Spec().namespace("Star.Sales.BUILDING").methods)).select("declaring_type", "symbol_id"), "declaring_type"), sql("SELECT owner AS declaring_type, id AS symbol_id, row_number() OVER (PARTITION BY owner ORDER BY id) AS place FROM mem WHERE kind = 'Method' AND owner LIKE 'Star.Sales.BUILDING.%'", "mem"))
# edges
_edge("d01_must_not_reference", lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY.*")), edges_sql("reference", "Reference", "s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'"))
_edge("d02_must_not_be_referenced_by", lambda s: s.namespace("Star.Catalog.ECONOMY").must_not_be_referenced_by(sales_subject(s)), edges_sql("reference", "Reference", "s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'"))
_edge("d03_must_only_reference", lambda s: s.namespace(SALES).must_only_reference(s.types().of_kind("Interface")), edges_sql("reference", "Reference", "s.project = 'Sales' AND NOT t.ext AND t.kind <> 'Interface'"))
_edge("d04_must_only_be_referenced_by", lambda s: s.namespace(CATALOG).must_only_be_referenced_by(s.namespace("Star.Sales.B*")), edges_sql("reference", "Reference", "t.project = 'Catalog' AND s.namespace NOT LIKE 'Star.Sales.B%'"))


def _banned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers mustn't use every 97th order of the customers of one segment."""
    own = star.members(spark, sf_dir).where("declaring_type like 'Star.Sales.BUILDING.%'").select("declaring_type", "name", F.regexp_extract("name", r"Order(\d+)", 1).cast("long").alias("o"))
    rows = own.where("o % 97 = 0").orderBy("o").collect()
    ban = lambda s: s.namespace(SUPPLY).must_not_use(*[s.member(r["declaring_type"], r["name"]) for r in rows])
    return _violations(ban)(spark, sf_dir).select("kind", "source", F.col("member_symbol_id").alias("member"), sites())


_add("d05_must_not_use", _banned, sql("SELECT 'MemberUse' AS kind, supp AS source, id AS member, " + sites_sql() + " AS sites_text FROM li JOIN mem ON li.cust = mem.owner AND li.o_orderkey = mem.ok WHERE ok % 97 = 0 AND owner LIKE 'Star.Sales.BUILDING.%' GROUP BY ALL", "li", "mem"))
_edge("d06_must_not_construct", lambda s: sales_subject(s).must_not_construct(s.types().implementing(CLOSED)), edges_sql("construct", "Construction", "s.namespace = 'Star.Sales.BUILDING' AND t.iface = 'Star.IStock<ECONOMY>'"))
_edge("d07_must_not_inject", lambda s: s.registered("Singleton").must_not_inject(s.registered("Scoped")), sql("SELECT 'Injection' AS kind, source, target, sites_text FROM inject WHERE source IN (SELECT part FROM reg WHERE life = 'Singleton' UNION SELECT impl FROM reg WHERE life = 'Singleton' AND impl IS NOT NULL) AND target IN (SELECT part FROM reg WHERE life = 'Scoped' UNION SELECT impl FROM reg WHERE life = 'Scoped' AND impl IS NOT NULL)", "li", _REG, "inject"))
_edge("d08_must_not_catch", lambda s: s.project("Supply").must_not_catch(s.namespace("Star.Catalog.STANDARD")), edges_sql("catch", "Catch", "s.project = 'Supply' AND t.namespace = 'Star.Catalog.STANDARD'"))
_edge("d09_must_not_expose", lambda s: s.project("Supply").must_not_expose(s.project("Geo")), edges_sql("expose", "Expose", "t.project = 'Geo'"))
_edge("d10_must_only_throw", lambda s: s.project("Sales").must_only_throw(s.project("Supply")), edges_sql("throw", "Throw", "s.project = 'Sales' AND t.project <> 'Supply'"))
_edge("d11_operand_union", lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY"), s.project("Geo"), s.types().attributed_with("Star.Tags.Brand#11")), edges_sql("reference", "Reference", "s.namespace = 'Star.Sales.BUILDING' AND (t.namespace = 'Star.Catalog.ECONOMY' OR t.project = 'Geo' OR t.attr = 'Star.Tags.Brand#11')"))
_add("d12_inert_target", lambda spark, d: evaluate(star.facts(spark, d), ruled(lambda s: s.namespace(SALES).must_not_catch(s.namespace("No.Such.*")), lambda s: s.namespace(SALES).must_not_catch(s.type("No.Such")), lambda s: s.namespace(SALES).must_not_inject(s.namespace("No.Such.*")), lambda s: s.namespace(SALES).must_not_construct(s.type("No.Such").with_suffix("x"))).build().rules).inert, "SELECT unnest(['r0', 'r3']) AS rule_id")
_add("d13_empty_subject", lambda spark, d: _violations(lambda s: s.namespace("No.Such").must_not_catch(s.type(CLOSED)), lambda s: s.namespace("No.Such").methods.must_be_public())(spark, d).select("rule_id", "kind"), "SELECT unnest(['r0', 'r1']) AS rule_id, 'EmptySubject' AS kind")
_add("d14_rule_error", lambda spark, d: _violations(lambda s: s.namespace(SALES).must_not_catch(s.type(CLOSED)), lambda s: s.type(CLOSED).must_be_public(), lambda s: s.project("Supply").where(lambda t: 1 // (int(t["name"][8:]) - 3), "divide", python=True).must_be_static())(spark, d).select("rule_id", "kind"), "SELECT unnest(['r0', 'r1', 'r2']) AS rule_id, 'RuleError' AS kind")
# shapes of types
_shape("h01_must_reside_in_namespace", lambda s: s.types().must_reside_in_namespace("Star.Sales.*"), "project <> 'Sales'")
_shape("h02_must_have_suffix", lambda s: s.project("Supply").must_have_suffix("5"), "project = 'Supply' AND right(name, 1) <> '5'")
_shape("h03_must_have_prefix", lambda s: s.types().must_have_prefix("Part"), "left(name, 4) <> 'Part'")
_shape("h04_must_have_name_matching", lambda s: s.types().must_have_name_matching("*1*"), "NOT contains(name, '1')")
_shape("h05_must_implement", lambda s: s.types().must_implement(CLOSED), "iface <> 'Star.IStock<ECONOMY>'")
_shape("h06_must_derive_from", lambda s: s.types().must_derive_from("System.Object"), "base = ''")
_shape("h07_must_be_attributed_with", lambda s: s.project("Catalog").must_be_attributed_with("Star.Tags.Brand#11"), "project = 'Catalog' AND attr <> 'Star.Tags.Brand#11'")
_shape("h08_must_not_implement", lambda s: s.types().must_not_implement("No.Such", CLOSED), "iface = 'Star.IStock<ECONOMY>'")
_shape("h09_must_not_derive_from", lambda s: s.types().must_not_derive_from("Star.Catalog.ECONOMYBase"), "base = 'Star.Catalog.ECONOMYBase'")
_shape("h10_must_not_be_attributed_with", lambda s: s.types().must_not_be_attributed_with("Star.Tags.Brand#11", "Star.Tags.Brand#12"), "attr IN ('Star.Tags.Brand#11', 'Star.Tags.Brand#12')")
_shape("h11_must_be_sealed", lambda s: s.project("Sales").must_be_sealed(), "project = 'Sales' AND NOT sealed")
_shape("h12_must_be_static", lambda s: s.project("Supply").must_be_static(), "project = 'Supply' AND NOT static")
_shape("h13_must_be_abstract", lambda s: s.project("Catalog").must_be_abstract(), "project = 'Catalog' AND NOT abstract")
_shape("h14_must_be_public", lambda s: s.types().must_be_public(), "access <> 'Public'")
_shape("h15_must_be_internal", lambda s: s.project("Sales").must_be_internal(), "project = 'Sales' AND access <> 'Internal'")
_shape("h16_must", lambda s: s.types().must(lambda t: F.length(t.namespace) < 19, "live in short namespaces"), "length(namespace) >= 19")
_shape("h16_must_python", lambda s: s.project("Supply").must(lambda t: not t["name"].endswith("2"), "not end in 2", python=True), "project = 'Supply' AND right(name, 1) = '2'")
# shapes of members
_member("g01_must_have_suffix", lambda s: s.types().methods.must_have_suffix("Async"), "kind = 'Method' AND name NOT LIKE '%Async'")
_member("g02_must_have_prefix", lambda s: s.types().properties.must_have_prefix("Order1"), "kind = 'Property' AND name NOT LIKE 'Order1%'")
_member("g03_must_have_name_matching", lambda s: s.types().fields.must_have_name_matching("*P*"), "kind = 'Field' AND name NOT LIKE '%P%'")
_member("g04_must_be_public", lambda s: s.types().methods.must_be_public(), "kind = 'Method' AND access <> 'Public'")
_member("g05_must_be_internal", lambda s: s.types().methods.must_be_internal(), "kind = 'Method' AND access <> 'Internal'")
_member("g06_must_be_private", lambda s: s.types().fields.must_be_private(), "kind = 'Field' AND access <> 'Private'")
_member("g07_must_be_static", lambda s: s.types().methods.must_be_static(), "kind = 'Method' AND ok % 2 <> 0")
_member("g08_must_be_abstract", lambda s: s.types().methods.must_be_abstract(), "kind = 'Method' AND ok % 5 <> 0")
_member("g09_must_be_virtual", lambda s: s.types().methods.must_be_virtual(), "kind = 'Method' AND ok % 7 <> 0")
_add("g10_must_accept_parameter", lambda spark, d: _violations(lambda s: s.types().methods.must_accept_parameter("Star.Catalog.ECONOMY.Part10"))(spark, d).select("kind", F.col("member_symbol_id").alias("member")), sql("SELECT 'MemberShape' AS kind, id AS member FROM mem WHERE kind = 'Method' AND ok NOT IN (SELECT l_orderkey FROM li WHERE part = 'Star.Catalog.ECONOMY.Part10')", "mem", "li"))
_member("g11_must", lambda s: s.types().members.must(lambda m: m.is_async | (m.accessibility == "Public"), "be async or public"), "NOT (prio LIKE '1%' OR access = 'Public')")
_member("g11_must_python", lambda s: s.namespace("Star.Sales.BUILDING").methods.must(lambda m: len(m["name"]) > 9, "have long names", python=True), "kind = 'Method' AND owner LIKE 'Star.Sales.BUILDING.%' AND length(name) <= 9")


# stances
def _ratchet_spec() -> Spec:
    s = Spec()
    s.rule("buy/economy").migrate("customers buy what they like", sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY"))).because("it is so")
    s.rule("sealed").migrate("open", s.project("Sales").must_be_sealed()).because("it is so")
    s.rule("new").migrate("loose", s.project("Supply").must_be_static()).because("it is so")
    s.rule("held").enforce(s.project("Geo").except_(s.project("Geo")).must_be_public()).because("it is so")
    s.scope("frozen").freeze(s.namespace("Star.Catalog.ECONOMY")).boundary_only_via("Star.Catalog.ECONOMY.Part10").because("it is so").dragons("old")
    s.scope("hermetic").freeze(s.namespace("Star.Sales.MACHINERY")).because("it is so").dragons("old")
    return s


def _baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every second violation of two rules, stale entries, and an empty section."""
    facts = star.facts(spark, sf_dir)
    rules = [r for r in _ratchet_spec().build().rules if r.id in ("buy/economy", "sealed")]
    found = written(upkeep.identities(evaluate(facts, rules).violations), "known")
    key = F.coalesce("source", "subject")
    even = found.where(F.regexp_extract(key, r"(\d)\z", 1).isin("0", "2", "4", "6", "8", "1"))
    stale = spark.createDataFrame([("buy/economy", f"T:Gone{i}", "T:Gone", None, None) for i in range(5)], BASELINE)
    own = even.withColumn("because", F.when(F.col("subject").isNotNull(), F.lit("old")))
    return own.unionByName(stale), spark.createDataFrame([("buy/economy",), ("sealed",), ("hermetic/containment",)], "rule_id string")


def _report(spark: SparkSession, sf_dir: str, changed: bool = True) -> verdict.Report:
    known, sections = _baseline(spark, sf_dir)
    return verdict.check(star.facts(spark, sf_dir), _ratchet_spec().build(), known, sections, star.changed_files(spark, sf_dir) if changed else None)


_BROKEN = """
broken AS (
  SELECT 'buy/economy' AS rule, e.source AS a, e.target AS b, regexp_extract(e.source, '(\\d)$', 1) IN ('0', '1', '2', '4', '6', '8') AS old FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'
  UNION ALL SELECT 'sealed', full_name, NULL, regexp_extract(full_name, '(\\d)$', 1) IN ('0', '1', '2', '4', '6', '8') FROM types WHERE project = 'Sales' AND NOT sealed
  UNION ALL SELECT 'new', full_name, NULL, FALSE FROM types WHERE project = 'Supply' AND NOT static
  UNION ALL SELECT 'held', NULL, NULL, FALSE
  UNION ALL SELECT 'frozen/containment', e.source, e.target, FALSE FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE t.namespace = 'Star.Catalog.ECONOMY' AND t.full_name <> 'Star.Catalog.ECONOMY.Part10' AND s.namespace <> 'Star.Catalog.ECONOMY'
)"""
_STATE = sql("SELECT rule AS rule_id, CASE WHEN old THEN 'grandfathered' ELSE 'new' END AS state, a AS source_or_subject, b AS target FROM broken", "types", "li", "reference", _BROKEN)
_RESULTS = sql("""
SELECT r.id AS rule_id, CASE WHEN count(b.rule) FILTER (WHERE NOT b.old) > 0 THEN 'Failed' ELSE 'Passed' END AS status, CAST(count(b.rule) FILTER (WHERE NOT b.old) AS BIGINT) AS violations, CAST(count(b.rule) FILTER (WHERE b.old) AS BIGINT) AS grandfathered, CAST(CASE WHEN r.id = 'buy/economy' THEN 5 ELSE 0 END AS BIGINT) AS stale, r.id IN ('buy/economy', 'sealed', 'hermetic/containment') AS captured
FROM (SELECT unnest(['buy/economy', 'sealed', 'new', 'held', 'frozen/containment', 'frozen/tripwire', 'hermetic/containment', 'hermetic/tripwire']) AS id) r LEFT JOIN broken b ON b.rule = r.id GROUP BY r.id""", "types", "li", "reference", _BROKEN)
_add("r01_results", lambda spark, d: _report(spark, d).results.select("rule_id", "status", "violations", "grandfathered", "stale", "captured"), _RESULTS)
_add("r03_ratchet", lambda spark, d: _report(spark, d).violations.select("rule_id", "state", F.coalesce("source", "subject").alias("source_or_subject"), "target"), _STATE)


def _stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = _baseline(spark, sf_dir)
    return verdict.stale_entries(evaluate(star.facts(spark, sf_dir), _ratchet_spec().build().rules).violations, known).select("rule_id", "source")


_add("r04_stale", _stale, "SELECT 'buy/economy' AS rule_id, 'T:Gone' || i AS source FROM range(5) t(i)")
_add("r06_identity", lambda spark, d: _violations(lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY")))(spark, d).select("id_source", "id_target", "id_subject"), edges_sql("reference", "x", "s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'").replace("SELECT 'x' AS kind, e.source, e.target, sites_text", "SELECT 'T:' || e.source AS id_source, 'T:' || e.target AS id_target, CAST(NULL AS VARCHAR) AS id_subject"))


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star.table(spark, sf_dir, "orders").select(F.lit("r").alias("rule_id"), F.concat(F.lit("T:"), F.col("o_custkey").cast("string")).alias("source"), F.lit("T:x").alias("target"), F.lit(None).cast("string").alias("subject"), F.col("o_orderkey").cast("string").alias("because"), F.col("o_orderkey").alias("ord"))
    return verdict.entries(own).select("source", "because")


_add("r07_first_entry_wins", _duplicates, "SELECT 'T:' || o_custkey AS source, CAST(min(o_orderkey) AS VARCHAR) AS because FROM orders GROUP BY o_custkey")


def _containment(via: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Spec()
        b = s.scope("area").freeze(s.namespace("Star.Catalog.ECONOMY")).because("it is so").dragons("old")
        if via:
            b.boundary_only_via("Star.Catalog.ECONOMY.Part10", "Star.Sales.BUILDING.Customer1")
        return evaluate(star.facts(spark, sf_dir), s.build().rules).violations.select("kind", "source", "target", sites())

    return run


_add("r08_freeze_boundary", _containment(True), edges_sql("reference", "Reference", "t.namespace = 'Star.Catalog.ECONOMY' AND t.full_name <> 'Star.Catalog.ECONOMY.Part10' AND s.namespace <> 'Star.Catalog.ECONOMY' AND s.full_name NOT IN ('Star.Sales.BUILDING.Customer1')"))
_add("r08_freeze_hermetic", _containment(False), edges_sql("reference", "Reference", "t.namespace = 'Star.Catalog.ECONOMY' AND s.namespace <> 'Star.Catalog.ECONOMY'"))
_add("r09_tripwire", lambda spark, d: _report(spark, d).warnings.where("kind = 'FrozenScopeTouched'").select("rule_id", "message"), "SELECT DISTINCT 'hermetic/tripwire' AS rule_id, 'a frozen file has changed: customer/N' || c_nationkey AS message FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0")
_add("r09_tripwire_skipped", lambda spark, d: _report(spark, d, False).results.where("status = 'Skipped'").select("rule_id"), "SELECT unnest(['frozen/tripwire', 'hermetic/tripwire']) AS rule_id")
_add("r10_diff_path", lambda spark, d: star.table(spark, d, "supplier").select(verdict.normal_path(F.concat(F.lit("C:\\Work\\"), F.regexp_replace("s_name", "#", "\\\\")), "c:/work", fold=True).alias("path")), "SELECT lower(replace(s_name, '#', '/')) AS path FROM supplier")
_add("r12_order", lambda spark, d: _placed(verdict.ordered(_violations(lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY")))(spark, d)).select("source", "target"), "source"), edges_sql("reference", "x", "s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'").replace("'x' AS kind, ", "").replace(", sites_text FROM", ", row_number() OVER (PARTITION BY e.source ORDER BY e.target) AS place FROM"))
_add("r13_totals", lambda spark, d: verdict.totals(_report(spark, d).results), sql("""
SELECT CAST(8 AS BIGINT) AS checked, CAST(8 - n AS BIGINT) AS passed, n AS failed, CAST(0 AS BIGINT) AS skipped, v AS violations, (SELECT CAST(count(DISTINCT c_nationkey) AS BIGINT) FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey % 2 = 0) AS warnings, g AS grandfathered, CAST(5 AS BIGINT) AS stale
FROM (SELECT CAST(count(DISTINCT rule) FILTER (WHERE NOT old) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE NOT old) AS BIGINT) AS v, CAST(count(*) FILTER (WHERE old) AS BIGINT) AS g FROM broken)""", "types", "li", "reference", _BROKEN))


def _upkeep(what: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = written(evaluate(star.facts(spark, sf_dir), _ratchet_spec().build().rules).violations, "violations")
        known, sections = _baseline(spark, sf_dir)
        if what == "init":
            now, _ = upkeep.initialise(found, ["buy/economy", "sealed", "new", "held", "frozen/containment"], sections, known)
            return now.groupBy("rule_id").agg(F.count("*").alias("entries"))
        if what == "accept":
            return upkeep.accept_reductions(found, known)[0].groupBy("rule_id").agg(F.count("*").alias("entries"))
        if what == "refused":
            return upkeep.accept_reductions(found, known)[1].select("rule_id", F.col("refused").cast("long").alias("refused"))
        if what == "unbaselinable":
            return upkeep.unbaselinable(found)
        if what == "add":
            one = found.where("rule_id = 'new'").orderBy("subject").first()["subject"]
            return upkeep.add_entry(found, known, "new", "by hand", subject=one).where("rule_id = 'new'").select("subject", "because")
        text = baselines.render(baselines.sections_of(known, sections))
        return spark.createDataFrame([("as written", _refused(text)), ("forged", _refused(text.replace('"because": "old"', '"because": "new"')))], "file string, refused boolean")

    return run


def _refused(text: str) -> bool:
    """Whether a baseline file with this text is refused."""
    try:
        baselines.parse(text)
    except upkeep.BaselineError:
        return True
    return False


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that the baseline file of a rule carries."""
    text = baselines.render(baselines.sections_of(*_subject_baseline(spark, sf_dir)))
    return spark.createDataFrame([("static", json.loads(text)["digest"])], "rule_id string, digest string")


_COUNTED = "SELECT rule AS rule_id, CAST(count(*) AS BIGINT) AS entries FROM broken WHERE old GROUP BY rule"
_add("r14_baseline_init", _upkeep("init"), sql("SELECT rule AS rule_id, CAST(count(*) + CASE WHEN rule = 'buy/economy' THEN 5 ELSE 0 END AS BIGINT) AS entries FROM broken WHERE old OR rule IN ('new', 'frozen/containment') GROUP BY rule", "types", "li", "reference", _BROKEN))
_add("r15_accept_reductions", _upkeep("accept"), sql(_COUNTED, "types", "li", "reference", _BROKEN))
_add("r15_refused", _upkeep("refused"), sql("SELECT rule AS rule_id, CAST(count(*) AS BIGINT) AS refused FROM broken WHERE NOT old AND rule IN ('buy/economy', 'sealed') GROUP BY rule", "types", "li", "reference", _BROKEN))
_add("r16_add_entry", _upkeep("add"), sql("SELECT 'T:' || min(full_name) AS subject, 'by hand' AS because FROM types WHERE project = 'Supply' AND NOT static", "types"))
_add("r17_unbaselinable", _upkeep("unbaselinable"), "SELECT 'held' AS rule_id")
_add("r18_digest", _sealed, sql(f"SELECT 'static' AS rule_id, sha256('{upkeep.PREAMBLE}' || chr(10) || 'rule static' || chr(10) || string_agg('subject T:' || full_name || chr(10), '' ORDER BY 'T:' || full_name)) AS digest FROM types WHERE project = 'Supply' AND NOT static", "types"))
_add("r19_tampered", _upkeep("tampered"), "SELECT unnest(['as written', 'forged']) AS file, unnest([FALSE, TRUE]) AS refused")


def _subject_baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = Spec()
    s.rule("static").enforce(s.project("Supply").must_be_static()).because("it is so")
    own = upkeep.identities(evaluate(star.facts(spark, sf_dir), s.build().rules).violations).withColumn("because", F.lit(None).cast("string"))
    return own, spark.createDataFrame([("static",)], "rule_id string")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _violations(lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY")))(spark, sf_dir)
    own = found.withColumn("state", F.lit("new")).withColumn("entry_because", F.lit(None).cast("string"))
    return render.fingerprints(own).select("fingerprint", F.col("line").cast("long").alias("line"))


_add("r21_fingerprint", _fingerprints, sql("SELECT 'v1|T:' || source || '|T:' || target || '||orders/' || f || '|' || (row_number() OVER (PARTITION BY source, target, f ORDER BY n) - 1) AS fingerprint, CAST(n AS BIGINT) AS line FROM (SELECT DISTINCT cust AS source, part AS target, l_orderkey AS f, l_linenumber AS n FROM li WHERE cust LIKE 'Star.Sales.BUILDING.%' AND part LIKE 'Star.Catalog.ECONOMY.%')", "li"))
_add("r22_promotable", lambda spark, d: verdict.promotable(verdict.check(star.facts(spark, d), _promo().build(), sections=spark.createDataFrame([("done",), ("open",)], "rule_id string")).results).select("rule_id"), "SELECT 'done' AS rule_id")


def _promo() -> Spec:
    s = Spec()
    s.rule("done").migrate("x", s.project("Catalog").must_be_public()).because("it is so")
    s.rule("open").migrate("x", s.project("Sales").must_be_public()).because("it is so")
    s.rule("bare").migrate("x", s.project("Catalog").must_be_public()).because("it is so")
    return s


# surveys
_PAIRS = "SELECT s.project AS a, t.project AS b, t.namespace AS ns, t.ext AS ext FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name"
_add("q01_project_edges", lambda spark, d: survey.project_edges(star.facts(spark, d)), sql(f"SELECT a AS source_project, b AS target_project, CAST(count(*) AS BIGINT) AS pairs FROM ({_PAIRS}) WHERE NOT ext AND a <> b GROUP BY ALL", "types", "li", "reference"))
_add("q02_external_edges", lambda spark, d: survey.external_edges(star.facts(spark, d)), sql(f"SELECT a AS source_project, split_part(ns, '.', 1) || '.' || split_part(ns, '.', 2) AS root, CAST(count(*) AS BIGINT) AS pairs FROM ({_PAIRS}) WHERE ext GROUP BY ALL", "types", "li", "reference"))
_add("q03_namespace_root", lambda spark, d: star.types(spark, d).select(names.namespace_root(F.when(F.col("project_name") == "Geo", "").otherwise(F.col("namespace"))).alias("root")).groupBy("root").agg(F.count("*").alias("n")), sql("SELECT CASE WHEN project = 'Geo' THEN '(global)' ELSE split_part(namespace, '.', 1) || '.' || split_part(namespace, '.', 2) END AS root, CAST(count(*) AS BIGINT) AS n FROM types GROUP BY 1", "types"))
_add("q04_namespaces", lambda spark, d: survey.namespaces(star.facts(spark, d)), sql("SELECT p AS project, namespace, CAST(count(namespace) AS BIGINT) AS types FROM (SELECT unnest(['Catalog', 'Sales', 'Supply', 'Unused']) AS p) LEFT JOIN types ON project = p AND NOT ext GROUP BY ALL", "types"))
_add("q05_unused_references", lambda spark, d: survey.unused_references(star.facts(spark, d)), "SELECT unnest(['Catalog', 'Sales', 'Sales']) AS project, unnest(['Supply', 'Supply', 'Unused']) AS reference")
_add("q06_common_directory", lambda spark, d: survey.deepest_common_directory(star.table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("g"), F.concat_ws("/", F.lit("src"), F.col("o_orderstatus"), F.concat(F.lit("d"), F.col("o_custkey") % 5), F.concat(F.col("o_orderkey"), F.lit(".x"))).alias("file")).where("g < 3 or o_orderstatus = 'F'"), "g"), "SELECT CAST(g AS BIGINT) AS g, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'src/' || min(o_orderstatus) || '/d' || g ELSE 'src' END AS directory FROM (SELECT o_custkey % 5 AS g, o_orderstatus FROM orders) WHERE g < 3 OR o_orderstatus = 'F' GROUP BY g")
_add("q07_frozen_place", lambda spark, d: reduce(DataFrame.unionByName, [p.withColumn("area", F.lit(n)) for n, p in survey.frozen_places(star.facts(spark, d), _ratchet_spec().build())]), "SELECT 'frozen' AS area, 'part' AS directory UNION ALL SELECT 'hermetic', 'customer'")
_add("q08_layer_place", lambda spark, d: reduce(DataFrame.unionByName, [p.withColumn("layer", F.lit(n)).withColumn("rules", F.lit(",".join(r))) for n, r, p in survey.layer_places(star.facts(spark, d), _ratchet_spec().build())]), "SELECT 'Building' AS layer, 'customer' AS directory, 'buy/economy' AS rules")
_add("q09_covering", lambda spark, d: survey.covering(star.table(spark, d, "supplier").select(F.concat(F.lit("src/N"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, "/deep").otherwise("")).alias("directory")).distinct(), "src/N1/deep/x.cs"), "SELECT DISTINCT 'src/N' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/deep' ELSE '' END AS directory FROM supplier WHERE s_nationkey = 1")
# scalar functions
_GLOBS = ("Star.Sales.*", "Star.*.N1", "Star.Catalog.E*", "*", "Geo.R1", "Star.Sales.B*G", "*.*")
_LIKE = ("regexp_full_match(namespace, 'Star\\.Sales(\\..*)?')", "regexp_full_match(namespace, 'Star\\.[^.]+\\.N1')", "regexp_full_match(namespace, 'Star\\.Catalog\\.E[^.]*')", "TRUE", "namespace = 'Geo.R1'", "regexp_full_match(namespace, 'Star\\.Sales\\.B[^.]*G')", "FALSE")
_add("f01_namespace_pattern", lambda spark, d: star.types(spark, d).select("full_name", *[patterns.namespace_like(F.col("namespace"), g).alias(f"g{i}") for i, g in enumerate(_GLOBS)]), sql(f"SELECT full_name, {', '.join(f'{x} AS g{i}' for i, x in enumerate(_LIKE))} FROM types", "types"))
_add("f01_url_names", lambda spark, d: star.table(spark, d, "pages").select("page_id", patterns.namespace_like(F.array_join(F.reverse(F.split(F.regexp_extract("url", "//([^/]+)/", 1), r"\.")), "."), "com.*").alias("com"), patterns.namespace_like(F.regexp_extract("url", "//([^/]+)/", 1), "*.*.example.net").alias("deep")), "SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) LIKE '%.com' AS com, regexp_full_match(regexp_extract(url, '//([^/]+)/', 1), '[^.]+\\.[^.]+\\.example\\.net') AS deep FROM pages")
_add("f03_name_pattern", lambda spark, d: star.types(spark, d).select("full_name", patterns.name_like(F.col("name"), "*a*1*").alias("a"), patterns.name_like(F.col("name"), "Part1").alias("b")), sql("SELECT full_name, regexp_full_match(name, '.*a.*1.*') AS a, name = 'Part1' AS b FROM types", "types"))
_add("f07_symbol_display", lambda spark, d: star.members(spark, d).select(names.symbol_display(F.col("symbol_id")).alias("shown")), sql("SELECT owner || '.' || name AS shown FROM mem", "mem"))
_add("f08_member_display", lambda spark, d: star.members(spark, d).select(names.member_display(F.col("declaring_type"), F.col("name"), F.col("kind")).alias("shown")), sql("SELECT owner_name || '.' || name || CASE kind WHEN 'Method' THEN '()' ELSE '' END AS shown FROM mem", "mem"))
_add("f09_relative_path", lambda spark, d: star.table(spark, d, "supplier").select(names.relative_path(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "/work/").otherwise("/else/"), F.col("s_name")), "/work").alias("path")), "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '/else/' || s_name END AS path FROM supplier")


# merge
def _merged(what: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        declared, linked = star.fragments(spark, sf_dir)
        match what:
            case "types":
                return merge.first_declared(declared).select("full_name", "project_name", sites("declaration_sites"))
            case "notes":
                return merge.conflations(declared)
            case "edges":
                return merge.merged_edges(linked).select("source", "target", sites())
            case "members":
                k = spark.range(3).select(F.col("id").cast("int").alias("fragment_ord"))
                own = star.members(spark, sf_dir).crossJoin(k).where("fragment_ord < 2 or is_static")
                return merge.winners_members(own, declared).select(F.col("symbol_id").alias("member"))
            case "external":
                ext = star.types(spark, sf_dir).where("is_external")
                mentions = ext.withColumn("fragment_ord", F.lit(1)).unionByName(ext.withColumn("fragment_ord", F.lit(0)).withColumn("project_name", F.concat("project_name", F.lit("First"))))
                named = star.edge_family(spark, sf_dir, "reference").where("source like 'Star.Supply.%'")
                return merge.external_types(mentions, declared, merge.referenced_names(declared, named)).select("full_name", "project_name")
            case "registrations":
                own = star.registrations(spark, sf_dir)
                return merge.merged_registrations(own.unionByName(own)).select("lifetime", "service", "implementation", sites())
            case "members_used":
                own = star.member_edges(spark, sf_dir)
                return merge.merged_member_edges(own.unionByName(own)).select("source", F.col("member_symbol_id").alias("member"), sites())
            case "projects":
                own = star.projects(spark).unionByName(spark.createDataFrame([("Sales", ["Supply", "Tools"]), ("Tools", [])], "name string, project_references array<string>"))
                return merge.merged_projects(own).select("name", F.array_join("project_references", ",").alias("refs"))
        return merge.retained(declared, "CatalogCopy1").groupBy("project_name").agg(F.count("*").alias("n"))

    return run


_FRAG = """
frag AS (SELECT DISTINCT l_linenumber % 3 AS o, full_name, name, CASE WHEN name LIKE '%0' AND l_linenumber % 3 > 0 THEN project || 'Copy' || (l_linenumber % 3) ELSE project END AS project FROM (SELECT l_linenumber, cust AS m FROM li UNION ALL SELECT l_linenumber, part FROM li) JOIN types ON m = full_name),
won AS (SELECT full_name, project, o FROM frag QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY o) = 1)"""
_add("x01_first_declared", _merged("types"), sql("SELECT full_name, won.project AS project_name, types.file || ':' || k AS sites_text FROM won JOIN types USING (full_name)", "types", "li", _FRAG))
_add("x02_conflations", _merged("notes"), sql("SELECT DISTINCT f.full_name || ' is declared by ' || w.project || ' and again by ' || f.project AS note FROM frag f JOIN won w ON f.full_name = w.full_name AND f.project <> w.project", "types", "li", _FRAG))
_add("x03_externals", _merged("external"), "SELECT DISTINCT 'Geo.R' || n_regionkey || '.Nation' || n_nationkey AS full_name, 'GeoFirst' AS project_name FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_add("x05_edges", _merged("edges"), sql("SELECT cust AS source, part AS target, " + sites_sql() + " AS sites_text FROM li GROUP BY ALL", "li"))
_add("x06_member_edges", _merged("members_used"), sql("SELECT supp AS source, id AS member, " + sites_sql() + " AS sites_text FROM li JOIN mem ON cust = owner AND o_orderkey = ok GROUP BY ALL", "li", "mem"))
_add("x07_members", _merged("members"), sql("SELECT id AS member FROM mem JOIN won ON owner = full_name WHERE o < 2 OR ok % 2 = 0", "types", "li", "mem", _FRAG))
for _n, _f in (("x08", "construct"), ("x09", "inject"), ("x11", "catch"), ("x12", "throw"), ("x13", "expose")):
    _add(f"{_n}_{_f}_edges", lambda spark, d, f=_f: merge.merged_edges((e := star.edge_family(spark, d, f)).unionByName(e)).select("source", "target", sites()), sql(f"SELECT * FROM {_f}", "li", _f))
_add("x10_registrations", _merged("registrations"), sql("SELECT CASE p_size % 3 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Scoped' ELSE 'Transient' END AS lifetime, part AS service, CASE WHEN l_returnflag <> 'N' THEN supp END AS implementation, " + sites_sql() + " AS sites_text FROM li WHERE l_linenumber = 1 GROUP BY ALL", "li"))
_add("x14_projects", _merged("projects"), "SELECT unnest(['Catalog', 'Sales', 'Supply', 'Unused', 'Tools']) AS name, unnest(['Supply', 'Catalog,Supply,Tools,Unused', '', '', '']) AS refs")
_add("x15_ordered_registrations", lambda spark, d: _placed(merge.ordered_registrations(star.registrations(spark, d)).select("lifetime", "service", "implementation"), "lifetime"), sql("SELECT life AS lifetime, part AS service, impl AS implementation, row_number() OVER (PARTITION BY life ORDER BY part, coalesce(impl, '')) AS place FROM reg", "li", _REG))
_add("i07_retain", _merged("retain"), sql("SELECT project AS project_name, CAST(count(*) AS BIGINT) AS n FROM frag WHERE project <> 'CatalogCopy1' GROUP BY 1", "types", "li", _FRAG))


# incremental
def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as projects that reference customer k/2, and files with the sums of their orders."""
    own = star.table(spark, sf_dir, "customer")
    projects = own.select(F.col("c_custkey").cast("string").alias("name"), F.when(F.col("c_custkey") > 1, F.array(F.floor(F.col("c_custkey") / 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("project_references"))
    files = own.select(F.col("c_custkey").cast("string").alias("project"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"), F.sha2("c_name", 256).alias("sha"))
    return projects, files


def _incremental(what: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        projects, files = _tree(spark, sf_dir)
        now = incremental.content_keys(files)
        if what == "keys":
            return now
        edited = incremental.content_keys(files.withColumn("sha", F.when((F.col("project") == "7") & (F.col("path") == "b"), F.lit("x")).otherwise(F.col("sha"))))
        if what == "dirty":
            return incremental.dirty(edited, now)
        if what == "merkle":
            return incremental.dirty(incremental.merkle_keys(edited, projects), incremental.merkle_keys(now, projects))
        return incremental.with_dependents(incremental.dirty(edited, now), incremental.dependency_edges(projects))

    return run


_DEPENDENTS = "WITH RECURSIVE r AS (SELECT CAST(7 AS BIGINT) AS k UNION SELECT c_custkey FROM customer JOIN r ON c_custkey // 2 = r.k) SELECT CAST(k AS VARCHAR) AS project FROM r"
_add("i01_content_keys", _incremental("keys"), "SELECT CAST(c_custkey AS VARCHAR) AS project, sha256('a' || chr(0) || sha256(c_name) || chr(10) || 'b' || chr(0) || sha256(c_name)) AS key FROM customer")
_add("i02_merkle", _incremental("merkle"), _DEPENDENTS)
_add("i03_dirty", _incremental("dirty"), "SELECT '7' AS project")
_add("i04_dependents", _incremental("dependents"), _DEPENDENTS)


# derivations
def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    return star.table(spark, sf_dir, "part").select(F.concat(F.lit("IMap<IList<"), col("p_type"), F.lit(">, "), F.concat(F.lit("Size"), col("p_size")), F.lit("[]>")).alias("t"), "p_partkey")


_add("e10_decompose", lambda spark, d: _signatures(spark, d).select("p_partkey", F.explode(extract.decomposed(F.col("t"))).alias("part")), "SELECT p_partkey, unnest(list_distinct([p_type, 'IList<1>', 'Size' || p_size, 'IMap<2>'])) AS part FROM part")
_add("e02_shape_mask", lambda spark, d: extract.normal_shape(star.types(spark, d).withColumn("is_static", F.col("is_static") | F.col("name").endswith("2"))).where("is_sealed or is_abstract").select("full_name"), sql("SELECT full_name FROM types WHERE NOT (static OR name LIKE '%2') AND (sealed OR abstract)", "types"))
_add("e04_inventory", lambda spark, d: extract.inventoried(star.members(spark, d).withColumns({"is_implicit": F.col("is_static"), "method_kind": F.when(F.col("is_abstract"), "Constructor").otherwise("Ordinary"), "is_indexer": F.lit(False), "explicit_interface": F.col("name").endswith("7P2")})).select(F.col("symbol_id").alias("member")), sql("SELECT id AS member FROM mem WHERE ok % 2 <> 0 AND NOT (kind = 'Method' AND ok % 5 = 0) AND name NOT LIKE '%7P2'", "mem"))
_add("e08_injection", lambda spark, d: extract.injection_edges(star.lines(spark, d, "part", "supplier").where("l_linestatus = 'O'").select(F.col("part").alias("declaring_type"), F.concat(F.lit("ILazy<"), "supplier", F.lit(">")).alias("parameter_type"), F.col("site.file").alias("file"), F.col("site.line").alias("line"))).where("target <> 'ILazy<1>'").select("source", "target", sites()), sql("SELECT * FROM inject", "li", "inject"))
_add("e09_exposure", lambda spark, d: extract.exposure_edges(star.members(spark, d).withColumn("return_type", F.regexp_replace("return_type", "-", "_")).withColumn("member_type", F.regexp_replace("member_type", "-", "_")), star.types(spark, d)).where("target like 'Status.%'").select("source", "target", sites()), sql("SELECT owner AS source, 'Status.' || replace(replace(prio, '-', '_'), ' ', '') AS target, " + sites_sql("mem.file", "ok") + " AS sites_text FROM mem JOIN types ON owner = full_name WHERE mem.access = 'Public' AND types.access = 'Public' GROUP BY ALL", "mem", "types"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    life = F.element_at(F.array(F.lit("AddSingleton"), F.lit("TryAddScoped"), F.lit("AddTransient"), F.lit("AddHostedService"), F.lit("AddDbContext"), F.lit("AddHttpClient"), F.lit("AddOther")), (col("p_partkey") % 7 + 1).cast("int"))
    kind = F.concat(F.lit("T"), col("p_size"))
    args = F.when(col("p_partkey") % 2 == 0, F.array(kind)).otherwise(F.array(kind, F.lit("Impl")))
    return star.table(spark, sf_dir, "part").select(life.alias("method"), args.alias("type_args"), (col("p_partkey") % 3).cast("int").alias("n_params"), F.array().cast("array<string>").alias("typeof_args"), F.lit(0).alias("n_type_params"), F.when(col("p_partkey") % 5 == 0, "?").when(col("p_partkey") % 5 == 1, "Singleton").alias("lifetime_arg"), F.lit("f").alias("file"), col("p_partkey").cast("int").alias("line"))


_add("e11_registrations", lambda spark, d: extract.recognised_registrations(_calls(spark, d)).select("lifetime", "service", "implementation", F.size("sites").cast("long").alias("n_sites")), """
SELECT life AS lifetime, service, impl AS implementation, CAST(count(*) AS BIGINT) AS n_sites FROM (
  SELECT CASE k % 7 WHEN 0 THEN 'Singleton' WHEN 1 THEN 'Scoped' WHEN 2 THEN 'Transient' WHEN 3 THEN 'Singleton' WHEN 4 THEN CASE k % 5 WHEN 1 THEN 'Singleton' ELSE 'Scoped' END ELSE 'Transient' END AS life,
    CASE WHEN k % 7 = 3 THEN 'Microsoft.Extensions.Hosting.IHostedService' ELSE t END AS service,
    CASE WHEN k % 7 = 3 THEN t WHEN k % 2 = 1 THEN 'Impl' WHEN k % 7 < 3 AND k % 3 <> 0 THEN NULL ELSE t END AS impl
  FROM (SELECT p_partkey AS k, 'T' || p_size AS t FROM part) WHERE k % 7 < 6 AND NOT (k % 7 = 3 AND k % 2 = 1) AND NOT (k % 7 = 4 AND k % 5 = 0)) GROUP BY ALL""")
_add("e03_hierarchy", lambda spark, d: extract.derived_hierarchy(_chain(spark, d)).select("full_name", "base", F.col("depth").cast("long").alias("depth")), "WITH RECURSIVE r AS (SELECT c_custkey AS k, c_custkey // 2 AS b, CAST(1 AS BIGINT) AS d FROM customer WHERE c_custkey >= 2 UNION ALL SELECT k, b // 2, d + 1 FROM r WHERE b > 1) SELECT 'T' || k AS full_name, 'T' || b AS base, d AS depth FROM r")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda c: F.concat(F.lit("T"), c.cast("string"))
    return star.table(spark, sf_dir, "customer").where("c_custkey >= 2").select(t(F.col("c_custkey")).alias("full_name"), t(F.floor(F.col("c_custkey") / 2)).alias("base"))


# sources and sinks
_add("s07_ancestors", lambda spark, d: star.table(spark, d, "supplier").select("s_suppkey", F.explode(survey.ancestors(F.concat(F.lit("src/N"), F.col("s_nationkey"), F.lit("/x.cs")))).alias("directory")), "SELECT s_suppkey, 'src' AS directory FROM supplier UNION ALL SELECT s_suppkey, 'src/N' || s_nationkey FROM supplier")
_add("s08_changed_files", lambda spark, d: changed_files(star.changed_files(spark, d), star.table(spark, d, "nation").where("n_nationkey < 7").select(F.concat(F.lit("customer/N"), F.col("n_nationkey")).alias("path"))), "SELECT 'customer/N' || n_nationkey AS path FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey < 7")


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _violations(lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY")))(spark, sf_dir)
    return found.withColumn("state", F.lit("new"))


_SITES_SQL = "(SELECT DISTINCT cust, part, l_orderkey, l_linenumber FROM li WHERE cust LIKE 'Star.Sales.BUILDING.%' AND part LIKE 'Star.Catalog.ECONOMY.%')"
_add("s12_site_lines", lambda spark, d: render.site_lines(_stated(spark, d)).select("path", F.col("line").cast("long").alias("line"), "text"), sql(f"SELECT 'orders/' || l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS line, cust || ' references ' || part AS text FROM {_SITES_SQL}", "li"))
_add("s13_violations_json", lambda spark, d: render.violations_json(_stated(spark, d)).select(F.get_json_object("json", "$.kind").alias("kind"), F.get_json_object("json", "$.source").alias("source"), F.get_json_object("json", "$.target").alias("target"), F.get_json_object("json", "$.sites[0].file").alias("first")), sql(f"SELECT 'reference' AS kind, cust AS source, part AS target, min('orders/' || l_orderkey) AS first FROM {_SITES_SQL} GROUP BY ALL", "li"))
_add("s15_status_lines", lambda spark, d: render.status_lines(_report(spark, d).results).select("line"), sql("""
SELECT CASE r.id WHEN 'frozen/tripwire' THEN 'skipped frozen/tripwire: looks at changes only' WHEN 'hermetic/tripwire' THEN 'skipped hermetic/tripwire: looks at changes only'
  WHEN 'buy/economy' THEN 'BROKEN buy/economy (migrate): ' || g || ' excused, ' || v || ' new, 5 fixed' WHEN 'sealed' THEN 'BROKEN sealed (migrate): ' || g || ' excused, ' || v || ' new, 0 fixed'
  WHEN 'new' THEN 'BROKEN new (migrate): nothing captured yet, ' || v || ' broken now' WHEN 'held' THEN 'BROKEN held: 1 broken' WHEN 'frozen/containment' THEN 'BROKEN frozen/containment (freeze): nothing captured yet, ' || v || ' broken now' ELSE 'ok hermetic/containment (freeze): none left' END AS line
FROM (SELECT unnest(['buy/economy', 'sealed', 'new', 'held', 'frozen/containment', 'frozen/tripwire', 'hermetic/containment', 'hermetic/tripwire']) AS id) r
LEFT JOIN (SELECT rule, count(*) FILTER (WHERE old) AS g, count(*) FILTER (WHERE NOT old) AS v FROM broken GROUP BY rule) b ON b.rule = r.id""", "types", "li", "reference", _BROKEN))
# the compiler
_SET = (
    lambda s: sales_subject(s).must_not_reference(s.namespace("Star.Catalog.ECONOMY.*")),
    lambda s: s.namespace("Star.Sales.MACHINERY").must_not_reference(s.types().of_kind("Interface")),
    lambda s: s.namespace(CATALOG).must_only_be_referenced_by(s.namespace("Star.Sales.B*")),
    lambda s: s.project("Sales").must_be_sealed(),
    lambda s: s.types().methods.must_have_suffix("Async"),
)
_SET_SQL = sql("""
SELECT 'r0' AS rule_id, CAST(count(*) AS BIGINT) AS n FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE s.namespace = 'Star.Sales.BUILDING' AND t.namespace = 'Star.Catalog.ECONOMY'
UNION ALL SELECT 'r1', count(*) FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE s.namespace = 'Star.Sales.MACHINERY' AND t.kind = 'Interface'
UNION ALL SELECT 'r2', count(*) FROM reference e JOIN types s ON e.source = s.full_name JOIN types t ON e.target = t.full_name WHERE t.project = 'Catalog' AND s.namespace NOT LIKE 'Star.Sales.B%'
UNION ALL SELECT 'r3', count(*) FROM types WHERE project = 'Sales' AND NOT sealed
UNION ALL SELECT 'r4', count(*) FROM mem WHERE kind = 'Method' AND name NOT LIKE '%Async'""", "types", "li", "reference", "mem")
_add("c01_rule_set", lambda spark, d: _violations(*_SET)(spark, d).groupBy("rule_id").agg(F.count("*").alias("n")), _SET_SQL)
_add("c02_rule_by_rule", lambda spark, d: evaluate(star.facts(spark, d), ruled(*_SET).build().rules, fused=False).violations.groupBy("rule_id").agg(F.count("*").alias("n")), _SET_SQL)


def queries() -> dict[str, Query]:
    """All queries by the operator they show."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of each."""
    return dict(_SQL)


def facts_of(spark: SparkSession, sf_dir: str) -> Facts:
    """The graph that the queries are about."""
    return star.facts(spark, sf_dir)
