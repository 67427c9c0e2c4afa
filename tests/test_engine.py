"""What rules mean, on small graphs with results derived by hand."""

import pytest
from fixtures import graph, hierarchy, layered, member_row, type_row
from pyspark.sql import functions as F

from factloom.functions.names import TypeRef
from factloom.operators import baseline as upkeep
from factloom.operators.select import select_types
from factloom.plans import render
from factloom.plans.check import check, exit_code, totals, tripwire
from factloom.plans.compile import evaluate
from factloom.schema import BASELINE
from factloom.spec import Spec


def rules(*makes):
    s = Spec()
    for i, make in enumerate(makes):
        s.rule(f"r{i}").enforce(make(s)).because("it is so")
    return s.build().rules


def found(facts, *makes):
    rows = evaluate(facts, rules(*makes)).violations.collect()
    return sorted((r["rule_id"], r["kind"], r["source"] or r["subject"] or "", r["target"] or r["member_symbol_id"] or "") for r in rows)


def test_forbidden_and_allowed_references(spark):
    got = found(
        layered(spark),
        lambda s: s.namespace("App.Core.*").must_not_reference(s.namespace("App.Web")),
        lambda s: s.namespace("App.Core").must_only_reference(s.namespace("App.Core")),
        lambda s: s.namespace("App.Web").must_only_be_referenced_by(s.type("App.Core.Apple")),
        lambda s: s.type("App.Web.Helper").must_not_be_referenced_by(s.types()),
    )
    web = [("App.Core.Apple", "App.Web.Page"), ("App.Core.Service", "App.Web.Helper"), ("App.Core.Service", "App.Web.Page"), ("App.Core.Zebra", "App.Web.Page")]
    assert got == [("r0", "Reference", *p) for p in web] + [("r1", "Reference", *p) for p in web] + [("r2", "Reference", *p) for p in web[1:]] + [("r3", "Reference", *web[1])]


def test_positions_of_selections(spark):
    f = layered(spark)
    # outside types are targets, but neither subjects nor among types()
    assert found(f, lambda s: s.namespace("Lib.*").must_be_sealed()) == [("r0", "EmptySubject", "", "")]
    assert found(f, lambda s: s.types().must_not_reference(s.project("Lib"))) == [("r0", "Reference", "App.Core.Service", "Lib.Text.Builder")]
    assert found(f, lambda s: s.type("App.Core.Service").must_not_reference(s.types().with_suffix("Builder"))) == []
    s = Spec()
    assert {r["full_name"] for r in select_types(f, s.types().except_(s.namespace("App.Web"))).collect()} == {f"App.Core.{n}" for n in ("Service", "Model", "Apple", "Zebra")}


def test_throw_constrains_outside_types_too(spark):
    f = graph(spark, [type_row("A.X"), type_row("L.Err", "L", is_external=True)], [("throw", "A.X", "L.Err"), ("catch", "A.X", "L.Err"), ("inject", "A.X", "L.Err"), ("expose", "A.X", "L.Err")])
    got = found(f, lambda s: s.type("A.X").must_only_throw(s.namespace("A.*")), lambda s: s.type("A.X").must_not_catch(s.type("L.Err")), lambda s: s.type("A.X").must_not_inject(s.project("L")), lambda s: s.type("A.X").must_not_expose(s.namespace("L")))
    assert [g[1] for g in got] == ["Throw", "Catch", "Injection", "Expose"]


def test_warnings_of_inert_targets(spark):
    f = layered(spark)
    got = evaluate(f, rules(
        lambda s: s.namespace("App.Core").must_not_reference(s.namespace("Gone.*")), lambda s: s.namespace("App.Core").must_not_reference(s.type("Gone.X")), lambda s: s.namespace("App.Core").must_not_reference(s.type("Gone.X").except_(s.types())),
        lambda s: s.namespace("App.Core").must_only_reference(s.namespace("Gone.*")), lambda s: s.namespace("App.Core").must_not_inject(s.namespace("Gone.*")), lambda s: s.namespace("None").must_not_reference(s.namespace("Gone.*")), lambda s: s.namespace("App.Core").must_not_reference(s.namespace("Gone.*"), s.namespace("App.Web")),
    )).inert.collect()
    assert sorted(r["rule_id"] for r in got) == ["r0", "r2"]


def test_hierarchy_open_and_closed(spark):
    f = hierarchy(spark)
    closed = TypeRef("App.IHandler<T>", "App.IHandler<App.Order>")
    names = lambda make: sorted(r["name"] for r in select_types(f, make(Spec())).collect())
    assert names(lambda s: s.types().implementing("App.IHandler<T>")) == ["OrderHandler", "TextHandler"]
    assert names(lambda s: s.types().implementing(closed)) == ["OrderHandler"]
    assert names(lambda s: s.types().derived_from("App.Base")) == ["Widget"]
    assert names(lambda s: s.types().attributed_with("App.MarkAttribute")) == ["Tagged"]
    got = found(f, lambda s: s.types().must_not_implement(closed), lambda s: s.types().with_suffix("Handler").must_implement(closed), lambda s: s.type("App.Plain").must_not_construct(s.types().implementing("App.IHandler<T>")))
    assert [(g[0], g[2]) for g in got] == [("r0", "App.OrderHandler"), ("r1", "App.TextHandler"), ("r2", "App.Plain")]


def test_faults_are_contained(spark):
    f = layered(spark)
    closed = TypeRef("G<T>", "G<X>")
    got = found(
        f, lambda s: s.type(closed).must_be_sealed(), lambda s: s.namespace("App.Core").must_not_reference(s.type(closed)), lambda s: s.namespace("None").must_not_reference(s.type(closed)),
        lambda s: s.namespace("App.Core").where(lambda t: 1 // (t["name"] != "Zebra") and 1 // (t["name"] != "Model"), "divide", python=True).must_be_sealed(), lambda s: s.type("App.Web.Page").must(lambda t: t["nothing"], "have it", python=True), lambda s: s.type("App.Web.Page").must_be_public(),
    )
    assert [g[:2] for g in got] == [("r0", "RuleError"), ("r1", "RuleError"), ("r2", "EmptySubject"), ("r3", "RuleError"), ("r4", "RuleError")]
    detail = {r["rule_id"]: r["detail"] for r in evaluate(f, rules(lambda s: s.namespace("App.Core").where(lambda t: 1 // (t["name"] not in ("Zebra", "Model")), "divide", python=True).must_be_sealed())).violations.collect()}
    assert "App.Core.Model" in detail["r0"]


def members(spark):
    rows = [member_row("A.X", "SaveAsync", is_async=True, return_type="Task", parameters=[{"name": "c", "type_full_name": "Token"}]), member_row("A.X", "Load", return_type="Task"), member_row("A.X", "_count", "Field", accessibility="Private"), member_row("A.Y", "Size", "Property", is_virtual=True), member_row("L.Out", "Z")]
    uses = [("A.Y", "Clock", "Now", "P:Clock.Now", "Property"), ("A.Y", "Clock", "Wait", "M:Clock.Wait(1)", "Method"), ("A.Y", "Clock", "Wait", "M:Clock.Wait(2)", "Method"), ("A.X", "Other", "Now", "P:Other.Now", "Property")]
    return graph(spark, [type_row("A.X"), type_row("A.Y"), type_row("L.Out", "L", is_external=True)], members=rows, uses=uses, registrations=[("Singleton", "A.X", None), ("Scoped", "A.X", "A.Y"), ("Transient", "Nobody", "L.Out")])


def test_members(spark):
    f = members(spark)
    got = found(
        f, lambda s: s.types().methods.returning("Task").must_have_suffix("Async"), lambda s: s.types().methods.must_accept_parameter("Token"), lambda s: s.types().fields.must_be_private(), lambda s: s.types().properties.must_be_virtual(), lambda s: s.types().events.must_be_public(),
        lambda s: s.types().members.where(lambda m: m["name"] == "Load", "load", python=True).must_be_static(), lambda s: s.types().must_not_use(s.member("Clock", "Wait", method=True)),
    )
    assert got == [("r0", "MemberShape", "", "M:A.X.Load"), ("r1", "MemberShape", "", "M:A.X.Load"), ("r4", "EmptySubject", "", ""), ("r5", "MemberShape", "", "M:A.X.Load"), ("r6", "MemberUse", "A.Y", "M:Clock.Wait(1)"), ("r6", "MemberUse", "A.Y", "M:Clock.Wait(2)")]


def test_registered(spark):
    f = members(spark)
    names = lambda life, where="subject": sorted(r["full_name"] for r in select_types(f, Spec().registered(life), where).collect())
    assert names("Singleton") == ["A.X"] and names("Scoped") == ["A.X", "A.Y"] and names("Transient") == [] and names("Transient", "target") == ["L.Out"] and names(None) == ["A.X", "A.Y"]


def ratcheted():
    s = Spec()
    s.rule("core").migrate("mixed", s.namespace("App.Core").must_not_reference(s.namespace("App.Web"))).because("layers").fix("use a port")
    s.rule("empty").migrate("x", s.type("App.Core.Model").must_be_sealed()).because("it is so")
    s.rule("bare").migrate("x", s.type("App.Core.Model").must_be_sealed()).because("it is so")
    s.rule("gone").migrate("x", s.namespace("Nowhere").must_be_sealed()).because("it is so")
    s.scope("web").freeze(s.namespace("App.Web")).boundary_only_via("App.Web.Helper").because("old").dragons("bite")
    return s.build()


ENTRIES = [("core", "T:App.Core.Service", "T:App.Web.Page", None, "known"), ("core", "T:App.Core.Service", "T:App.Web.Page", None, "twice"), ("core", "T:Old", "T:App.Web.Page", None, None), ("gone", "T:a", "T:b", None, None)]


def test_ratchet(spark):
    known = spark.createDataFrame(ENTRIES, BASELINE)
    sections = spark.createDataFrame([("core",), ("empty",), ("gone",)], "rule_id string")
    report = check(layered(spark), ratcheted(), known, sections)
    r = {x["rule_id"]: x for x in report.results.collect()}
    assert (r["core"]["status"], r["core"]["violations"], r["core"]["grandfathered"], r["core"]["stale"]) == ("Failed", 3, 1, 1)
    assert r["empty"]["captured"] and r["empty"]["violations"] == 1 and not r["bare"]["captured"] and r["bare"]["violations"] == 1
    assert r["gone"]["violations"] == 1 and r["gone"]["stale"] == 1 and r["web/tripwire"]["status"] == "Skipped"
    assert r["web/containment"]["violations"] == 3
    old = report.violations.where("state = 'grandfathered'").collect()
    assert [x["entry_because"] for x in old] == ["known"]
    t = totals(report.results).first()
    assert (t["checked"], t["failed"], t["skipped"], t["grandfathered"], t["stale"]) == (6, 5, 1, 1, 2)
    text = render.human(report)
    assert "BROKEN core: Types in `App.Core` must not reference types in `App.Web`." in text and "  instead: use a port" in text and "e(1): App.Core.Apple references App.Web.Page" in text
    assert render.rule_block(report, "empty").startswith("BROKEN empty")
    sarif = __import__("json").loads(render.sarif(report))
    results = sarif["runs"][0]["results"]
    assert {x["level"] for x in results} == {"error", "note"} and len({x["partialFingerprints"]["violation/v1"] for x in results if x["ruleId"] == "core"}) == 8
    body = __import__("json").loads(render.check_json(report, "x"))
    assert [x["id"] for x in body["rules"]][0] == "core" and len(body["rules"][0]["violations"]) == 3


def test_tripwire(spark):
    f, rule = layered(spark), ratcheted().rules[-1]
    changed = spark.createDataFrame([("App\\Web\\Page.x",), ("/w/app/web/HELPER.x",), ("App/Core/Model.x",)], "path string")
    assert tripwire(f, rule, changed).count() == 1
    assert tripwire(f, rule, changed, "/W", fold=True).count() == 2
    report = check(f, ratcheted(), changed=changed)
    assert {r["rule_id"]: r["status"] for r in report.results.collect()}["web/tripwire"] == "Passed"


def test_upkeep(spark, tmp_path):
    from factloom.sources import baselines

    f, model = layered(spark), ratcheted()
    now = evaluate(f, model.rules).violations
    known, sections = spark.createDataFrame(ENTRIES, BASELINE), spark.createDataFrame([("core",)], "rule_id string")
    made, captured = upkeep.initialise(now, ["core", "bare", "gone", "web/containment"], sections, known)
    assert {r[0] for r in captured.collect()} == {"core", "bare", "web/containment"} and made.where("rule_id = 'bare'").count() == 1
    kept, refused = upkeep.accept_reductions(now, known)
    assert [r["because"] for r in kept.collect()] == ["known"] and [tuple(r) for r in refused.collect()] == [("core", 3)]
    added = upkeep.add_entry(now, known, "core", "by hand", source="App.Core.Apple", target="T:App.Web.Page")
    assert added.where("because = 'by hand'").count() == 1
    for bad in ({"source": "App.Core.Apple", "target": "None"}, {"subject": "x"}):
        with pytest.raises(upkeep.BaselineError):
            upkeep.add_entry(now, known, "core", "by hand", **bad)
    path = tmp_path / "b.json"
    rules_ = baselines.sections_of(kept, sections)
    assert baselines.write(path, rules_) and not baselines.write(path, rules_)
    assert baselines.parse(path.read_text()) == rules_
    again, s = baselines.load(spark, tmp_path, ["b.json", "none.json"])
    assert again.count() == 1 and baselines.sections_of(again, s) == rules_
    for text in (path.read_text().replace("known", "forged"), "{", "{}", path.read_text().replace('"because"', '"why"')):
        with pytest.raises(upkeep.BaselineError):
            baselines.parse(text)
    changed = dict(rules_, core=[dict(rules_["core"][0], because="other")])
    assert upkeep.digest_of(changed) != upkeep.digest_of(rules_)


def test_one_plan_equals_many(spark):
    makes = [lambda s: s.namespace("App.Core").must_not_reference(s.namespace("App.Web")), lambda s: s.types().must_be_sealed(), lambda s: s.namespace("No").must_be_sealed(), lambda s: s.namespace("App.Web").must_only_be_referenced_by(s.namespace("App.Web"))]
    f = layered(spark)
    one, many = (evaluate(f, rules(*makes), fused=x).violations for x in (True, False))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.count() == many.count()


def test_edge_families_are_read_once(spark, tmp_path):
    from factloom.sources.tables import read_facts, write_facts

    write_facts(layered(spark), str(tmp_path / "f"))
    f = read_facts(spark, str(tmp_path / "f"))
    makes = [lambda s, k=k: s.namespace("App.Core").with_prefix(k).must_not_reference(s.namespace("App.Web")) for k in "ASZM"]
    df = evaluate(f, rules(*makes)).violations
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    # the flags are read from their own table; of the facts only the edges, once
    assert final.count("/f/edges") <= 1 and "/f/types" not in final and "FileScan" in final
    assert found(f, makes[0]) == [("r0", "Reference", "App.Core.Apple", "App.Web.Page")]


def test_edges_of_other_subjects_are_left_out_before_they_are_grouped(spark):
    raw = spark.createDataFrame([("reference", s, t, f"{i}.x") for i, (s, t) in enumerate([("App.Core.Apple", "App.Web.Page"), ("App.Web.Page", "App.Core.Model")] * 3)], "family string, source string, target string, file string")
    grouped = raw.groupBy("family", "source", "target").agg(F.array_sort(F.collect_set(F.struct("file", F.lit(1).alias("line")))).alias("sites"))
    df = evaluate(layered(spark).with_(edges=grouped), rules(lambda s: s.namespace("App.Core").must_not_reference(s.namespace("App.Web")))).violations
    assert [(r["source"], len(r["sites"])) for r in df.collect()] == [("App.Core.Apple", 3)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [family") < plan.index("LeftSemi")


def test_shapes_are_shown_where_they_are_declared_first(spark):
    f = layered(spark)
    twice = f.types.withColumn("declaration_sites", F.array(*[F.struct(F.lit(x).alias("file"), F.lit(i).alias("line")) for i, x in enumerate(("a.x", "b.x"))]))
    report = check(f.with_(types=twice), rules_model(lambda s: s.namespace("App.Web").must_be_sealed()))
    lines = [x for x in render.human(report).split("\n") if ".x(" in x]
    assert lines and all("a.x(0)" in x for x in lines)


def rules_model(*makes):
    s = Spec()
    for i, make in enumerate(makes):
        s.rule(f"r{i}").enforce(make(s)).because("it is so")
    return s.build()


def test_exit_codes():
    assert [exit_code(0, False), exit_code(3, False), exit_code(3, True), exit_code(0, False, ["warning NU1901: x"]), exit_code(0, False, ["error"])] == [0, 1, 2, 0, 2]


def _unnarrowed(facts):
    """The same tables, which a source gives whole."""
    from factloom.schema import TABLES, Facts

    return Facts(**{n: (lambda n=n: getattr(facts, n)) for n in TABLES})


def test_edges_of_other_types_are_left_out_before_they_are_grouped(spark):
    from factloom.queries import facts_of, ruled

    facts = facts_of(spark, "/root/testdata/sf0.001")
    rules = ruled(lambda s: s.namespace("Star.Sales.BUILDING").must_not_reference(s.namespace("Star.Catalog.ECONOMY"), s.namespace("Geo.R1"))).build().rules
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # a semi-join moves below a grouping by itself only where it broadcasts, which large tables don't allow
        plan = evaluate(facts, rules).violations._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    groups = [i for i, x in enumerate(plan) if "collect_set" in x]
    semis = [i for i, x in enumerate(plan) if "LeftSemi" in x]
    assert len(groups) == 3 and len(semis) == 6  # two ends of three parts of the family
    depth = lambda i: len(plan[i]) - len(plan[i].lstrip(" :+-"))
    for i in semis:
        above = [j for j in groups if j < i]
        assert above and depth(above[-1]) < depth(i)


@pytest.mark.parametrize("which", ["source", "target", "both", "only", "uses"])
def test_narrowed_facts_give_what_whole_tables_give(spark, which):
    from factloom.queries import facts_of, ruled

    facts = facts_of(spark, "/root/testdata/sf0.001")
    sales, stock, geo = (lambda s, n=n: s.namespace(n) for n in ("Star.Sales.BUILDING", "Star.Catalog.E*", "Geo.*"))
    orders = [r["name"] for r in facts.members.where("declaring_type = 'Star.Sales.BUILDING.Customer1' or name like 'Order7%'").select("name").collect()]
    owners = [r["declaring_type"] for r in facts.members.where("declaring_type = 'Star.Sales.BUILDING.Customer1' or name like 'Order7%'").select("declaring_type").collect()]
    makes = {
        "source": [lambda s: sales(s).must_only_reference(stock(s)), lambda s: s.namespace("Star.Supply.*").must_not_reference(geo(s))],
        "target": [lambda s: stock(s).must_only_be_referenced_by(sales(s)), lambda s: geo(s).must_not_be_referenced_by(sales(s)), lambda s: stock(s).must_not_be_referenced_by(sales(s))],
        "both": [lambda s: sales(s).must_not_reference(stock(s)), lambda s: stock(s).must_not_be_referenced_by(s.types().with_suffix("7"))],
        "only": [lambda s: sales(s).must_only_throw(s.project("Supply")), lambda s: stock(s).must_not_inject(s.namespace("Star.Supply.N1*")), lambda s: s.project("Supply").must_not_expose(geo(s), stock(s)), lambda s: s.project("Supply").must_not_catch(stock(s)), lambda s: sales(s).must_not_construct(s.types().of_kind("Interface"))],
        "uses": [lambda s: s.namespace("Star.Supply.*").must_not_use(*[s.member(o, n) for o, n in zip(owners, orders)]), lambda s: s.namespace("Star.Supply.N1*").must_not_use(*[s.member(o, n) for o, n in zip(owners[:3], orders[:3])])],
    }[which]
    rules = ruled(*makes).build().rules
    got, want = (evaluate(f, rules).violations.collect() for f in (facts, _unnarrowed(facts)))
    assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_facts_replaced_are_not_narrowed(spark):
    from factloom.queries import facts_of
    from factloom.schema import EDGES

    facts = facts_of(spark, "/root/testdata/sf0.001")
    own = spark.createDataFrame([("reference", "A", "B", []), ("catch", "A", "C", [])], EDGES)
    names = spark.createDataFrame([("A",), ("B",)], "n string")
    assert [(r["source"], r["target"]) for r in facts.with_(edges=own).edges_among("reference", names, names).collect()] == [("A", "B")]
    assert facts.with_(edges=own).edges_among("reference", names, names.where("n = 'A'")).isEmpty()
