"""Merge, survey, incremental work, streams, sources and the command line."""

import json
import os
import subprocess
from pathlib import Path

import pytest
from fixtures import graph, layered, type_row
from pyspark.sql import functions as F

from factloom.cli import main
from factloom.operators import extract, incremental, merge, survey
from factloom.schema import TYPES
from factloom.sources import cache, specs
from factloom.sources.tables import read_facts, snapshot_valid, source_files, write_diagnostics, write_facts
from factloom.streaming.fragments import keep_latest


def fragment(spark, order, project, *names):
    return spark.createDataFrame([type_row(n, project, declaration_sites=[{"file": project, "line": order}]) for n in names], TYPES).withColumn("fragment_ord", F.lit(order))


def test_first_declarer_wins_whatever_the_row_order(spark):
    a, b, c = fragment(spark, 0, "P", "N.X", "N.Y"), fragment(spark, 1, "Q", "N.X", "N.Z"), fragment(spark, 2, "P", "N.X")
    for df in (a.unionByName(b).unionByName(c), c.unionByName(b).unionByName(a)):
        got = {r["full_name"]: (r["project_name"], len(r["declaration_sites"])) for r in merge.first_declared(df).collect()}
        assert got == {"N.X": ("P", 3), "N.Y": ("P", 1), "N.Z": ("Q", 1)}
        assert [r[0] for r in merge.conflations(df).collect()] == ["N.X is declared by P and again by Q"]


def test_edges_unite_and_never_loop(spark):
    rows = [("reference", "A", "B", [("f", 2), ("f", 1)]), ("reference", "A", "B", [("f", 1)]), ("reference", "A", "A", [("f", 9)])]
    df = spark.createDataFrame(rows, "family string, source string, target string, sites array<struct<file:string,line:int>>")
    got = merge.merged_edges(df).collect()
    assert len(got) == 1 and [tuple(s) for s in got[0]["sites"]] == [("f", 1), ("f", 2)]


def test_outside_types_only_if_named(spark):
    types = fragment(spark, 0, "P", "N.X")
    mentions = fragment(spark, 1, "L1", "L.A", "N.X", "L.B").unionByName(fragment(spark, 0, "L0", "L.A"))
    named = spark.createDataFrame([("L.A",), ("N.X",)], "full_name string")
    assert [(r["full_name"], r["project_name"]) for r in merge.external_types(mentions, types, named).collect()] == [("L.A", "L0")]


def test_survey(spark):
    types = [type_row("A.B.C.X", "P"), type_row("A.Y", "Q"), type_row("Z", "Q"), type_row("L.M.N.T", "Lib", is_external=True), type_row("G", "Lib", is_external=True)]
    edges = [("reference", "A.B.C.X", "A.Y"), ("reference", "A.B.C.X", "Z"), ("reference", "A.Y", "Z"), ("reference", "Z", "L.M.N.T"), ("reference", "Z", "G"), ("catch", "A.Y", "A.B.C.X")]
    f = graph(spark, types, edges, projects=[("P", ["Q", "R"]), ("Q", []), ("R", [])])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(survey.project_edges(f)) == [("P", "Q", 2)]
    assert rows(survey.external_edges(f)) == [("Q", "(global)", 1), ("Q", "L.M", 1)]
    assert set(rows(survey.unused_references(f))) == {("P", "R")}
    assert {tuple(r) for r in survey.namespaces(f).collect()} == {("P", "A.B.C", 1), ("Q", "A", 1), ("Q", "", 1), ("R", None, 0)}


def test_common_directory(spark):
    at = lambda *files: survey.deepest_common_directory(spark.createDataFrame([(x,) for x in files], "file string")).first()["directory"]
    assert [at("/a/b/c.x", "/a/b/d/e.x"), at("a\\b\\c.x", "a\\d.x"), at("/a/x"), at("x", "y"), at("/a/bc/x", "/a/b/x"), at("/a-b/x", "/a/x", "/a.b/x")] == ["/a/b", "a", "/a", "", "/a", ""]


def test_dirty_closure(spark):
    projects = spark.createDataFrame([("a", ["b"]), ("b", ["c", "gone"]), ("c", []), ("d", ["e"]), ("e", ["d"])], "name string, project_references array<string>")
    files = lambda sha: spark.createDataFrame([(p, "x", sha if p == "c" else "1") for p in "abcde"], "project string, path string, sha string")
    old, new = incremental.content_keys(files("1")), incremental.content_keys(files("2"))
    names = lambda df: sorted(r["project"] for r in df.collect())
    assert names(incremental.dirty(old, new)) == ["c"]
    assert names(incremental.with_dependents(incremental.dirty(old, new), incremental.dependency_edges(projects))) == ["a", "b", "c"]
    assert names(incremental.dirty(incremental.merkle_keys(old, projects), incremental.merkle_keys(new, projects))) == ["a", "b", "c"]
    assert incremental.merkle_keys(old, projects).count() == 5
    facts = lambda v: spark.createDataFrame([(p, v) for p in "abcde"], "project string, v int")
    again = incremental.with_dependents(incremental.dirty(old, new), incremental.dependency_edges(projects))
    assert sorted((r["project"], r["v"]) for r in incremental.refreshed(facts(1), facts(2), again).collect()) == [("a", 2), ("b", 2), ("c", 2), ("d", 1), ("e", 1)]


@pytest.mark.parametrize("levels", [2, 16])
def test_merkle_keys_pass_no_table_to_the_driver(spark, monkeypatch, levels):
    import hashlib

    refs = {f"p{i}": [f"p{j}" for j in {i // 2, i // 3, i - 1} if 0 < j < i] for i in range(1, 13)} | {"x": ["y", "p3"], "y": ["x"], "z": ["x", "p12"], "self": ["self"]}
    sha = lambda *parts: hashlib.sha256("\0".join(parts).encode()).hexdigest()
    want: dict[str, str] = {}
    for _ in refs:  # what has all it references settles
        want |= {p: sha(f"k{p}", *[want[r] for r in sorted(rs)]) if rs else sha(f"k{p}") for p, rs in refs.items() if p not in want and all(r in want for r in rs)}
    want |= {p: sha(f"k{p}", "\0".join(want.get(r, "") for r in sorted(rs))) for p, rs in refs.items() if p not in want}
    plans = []
    monkeypatch.setattr(incremental, "written", lambda df, name, own=incremental.written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), own(df, name))[1])
    monkeypatch.setattr(incremental, "LEVELS", levels, raising=False)
    made = F.udf(lambda p: f"k{p}").asNondeterministic()
    keys = spark.createDataFrame([(p,) for p in refs], "project string").select("project", made("project").alias("key"))
    projects = spark.createDataFrame(list(refs.items()), "name string, project_references array<string>")
    got = {r["project"]: r["key"] for r in incremental.merkle_keys(keys, projects).collect()}
    assert got == want
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert sum("BatchEvalPython" in p for p in plans) == 1  # the keys are computed once, not in each round


def test_extraction_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    projects = lambda names: spark.createDataFrame([(p, ["c"] if p == "a" else []) for p in names], "name string, project_references array<string>")
    files = lambda names, **sha: spark.createDataFrame([(p, "x", sha.get(p, "1")) for p in names], "project string, path string, sha string")
    facts = lambda v: spark.createDataFrame([(p, v) for p in "abcd"], "project string, v int")
    names = lambda df: sorted(r["project"] for r in df.collect())
    kept = lambda: sorted((r["project"], r["v"]) for r in cache.fragments_of(spark, path).collect())

    def run(who, v, fingerprint="f1", **sha):
        found = cache.look_up(spark, path, files(who, **sha), projects(who), fingerprint)
        again = names(found.again)
        if found.kind != "hit":
            cache.store(found, path, facts(v), fingerprint)
        return found.kind, again

    assert run("abc", 1) == ("miss", ["a", "b", "c"]) and run("abc", 9) == ("hit", [])
    assert run("abc", 2, c="2") == ("partial", ["a", "c"]) and kept() == [("a", 2), ("b", 1), ("c", 2)]
    assert run("acd", 3, c="2") == ("partial", ["d"]) and kept() == [("a", 2), ("c", 2), ("d", 3)]
    assert run("ac", 4, "f2", c="2") == ("miss", ["a", "c"]) and kept() == [("a", 4), ("c", 4)]


def test_decomposition(spark):
    cases = {"A.B": {"A.B"}, "List<A>": {"List<1>", "A"}, "Map<A, List<B[]>>": {"Map<2>", "A", "List<1>", "B"}, "A[,]": {"A"}, "T<U<V<W>>>": {"T<1>", "U<1>", "V<1>", "W"}}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", extract.decomposed(F.col("t")).alias("p")).collect():
        assert set(r["p"]) == cases[r["t"]], r


def test_hierarchy_with_a_cycle(spark):
    direct = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "full_name string, base string")
    assert {tuple(r) for r in extract.derived_hierarchy(direct).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}


def test_hierarchy_of_any_length_with_type_arguments(spark):
    chain = [(f"T{i}", f"T{i + 1}") for i in range(100)]
    got = extract.derived_hierarchy(spark.createDataFrame(chain, "full_name string, base string")).where("full_name = 'T0'")
    assert sorted(r["depth"] for r in got.collect()) == list(range(1, 101))
    direct = [("Ints", "Box<Int>"), ("Box<T>", "List<T>"), ("List<E>", "IMap<E, IList<E>>"), ("Pair<T, U>", "IMap<U, T>"), ("Own", "Pair<A.T, List<U>>")]
    got = {(r["full_name"], r["base"]) for r in extract.derived_hierarchy(spark.createDataFrame(direct, "full_name string, base string")).collect()}
    assert {("Ints", "List<Int>"), ("Ints", "IMap<Int, IList<Int>>"), ("Box<T>", "IMap<T, IList<T>>"), ("Own", "IMap<List<U>, A.T>")} <= got


def test_changed_files_of_a_folder_below_the_top(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    sub = tmp_path / "sub"
    sub.mkdir()
    for n in ("top.cs", "sub/a.cs", "sub/gone.cs", "sub/same.cs"):
        (tmp_path / n).write_text(n)
    git("add", "-A")
    git("commit", "-qm", "x")
    for n in ("top.cs", "sub/a.cs", "sub/neu é.cs"):
        (tmp_path / n).write_text("other")
    (sub / "gone.cs").unlink()
    top = os.path.realpath(tmp_path)
    assert specs.changed_since(str(sub), "HEAD") == [f"{top}/{n}" for n in ("sub/a.cs", "sub/gone.cs", "sub/neu é.cs", "top.cs")]
    for base in ("nope", "--output=x", "-p"):
        with pytest.raises(ValueError):
            specs.changed_since(str(sub), base)
    assert not (tmp_path / "x").exists() and not (sub / "x").exists()


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "project string, generation int, version int, v int"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    out = str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        keep_latest(stream, out, str(tmp_path / "cp")).awaitTermination(120)
        return sorted((r["project"], r["v"]) for r in spark.read.parquet(out).collect())

    put(1, [("a", 1, 1, 10), ("a", 1, 2, 11), ("b", 1, 1, 20)])
    assert run() == [("a", 11), ("b", 20)]
    put(2, [("a", 1, 1, 12), ("b", 2, 0, 21)])
    assert run() == [("a", 11), ("b", 21)]


def test_sources(spark, tmp_path):
    for p in ("src/a.cs", "src/obj/b.cs", "src/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    files = source_files(spark, str(tmp_path / "src"))
    assert [Path(r["path"]).name for r in files.collect()] == ["a.cs"]
    there = spark.createDataFrame([("x", "1"), ("y", "1")], "path string, sha string")
    now = spark.createDataFrame([("x", "2"), ("z", "1")], "path string, sha string")
    assert {tuple(r) for r in snapshot_valid(there, now).collect()} == {("x", "changed"), ("y", "missing"), ("z", "added")}


SPEC = """
from factloom.spec import Spec
def spec():
    s = Spec()
    s.rule("core/web").migrate("mixed", s.layer("Core", "App.Core.*").must_not_reference(s.namespace("App.Web"))).because("layers")
    s.scope("web").freeze(s.namespace("App.Web")).because("old").dragons("bite")
    return s
"""


def test_command_line(spark, tmp_path, capsys):
    write_facts(layered(spark), str(tmp_path / "facts"))
    assert read_facts(spark, str(tmp_path / "facts")).types.count() == 7
    (tmp_path / "spec.py").write_text(SPEC)
    run = lambda *a: main([*a, "--root", str(tmp_path)], spark)
    facts, spec = ["--facts", str(tmp_path / "facts")], ["--spec", str(tmp_path / "spec.py")]
    assert run("check", *facts, *spec, "--sarif", str(tmp_path / "r.sarif")) == 1
    assert "BROKEN core/web" in capsys.readouterr().out and json.loads((tmp_path / "r.sarif").read_text())["version"] == "2.1.0"
    assert run("baseline", *facts, *spec, "--init") == 0
    assert run("check", *facts, *spec) == 0
    assert run("status", *facts, *spec) == 0
    assert "4 excused" in capsys.readouterr().out
    assert run("explain", *spec, "core/web") == 0 and run("explain", *spec, "nope") == 2
    assert run("render", *spec, "--into", str(tmp_path / "A.md")) == 0 and "core/web" in (tmp_path / "A.md").read_text()
    assert run("graph", *facts, "--json") == 0
    capsys.readouterr()
    assert run("context", *facts, *spec, "App/Web/Page.x") == 0 and "Frozen: web" in capsys.readouterr().out
    assert run("context", *facts, *spec, "Else/x") == 0 and "covers 'Else/x'" in capsys.readouterr().out
    write_diagnostics(spark.createDataFrame([("error CS1: x",), ("warning NU1901: y",)], "message string"), str(tmp_path / "facts"))
    assert run("check", *facts, *spec) == 2 and run("check", *facts, *spec, "--allow-workspace-diagnostics") == 0
    write_diagnostics(spark.createDataFrame([("warning NU1901: y",)], "message string"), str(tmp_path / "facts"))
    assert run("check", *facts, *spec) == 0
    (tmp_path / "arch/baselines/core/web.json").write_text("{}")
    assert run("check", *facts, *spec) == 2
