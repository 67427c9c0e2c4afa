"""Patterns, names, sentences and the faults of specs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factloom.functions import names, patterns
from factloom.functions.names import TypeRef, construct, display_names
from factloom.plans import render
from factloom.prose import sentence
from factloom.spec import Spec
from factloom.validate import SpecError

NAMESPACES = [
    ("A.B.*", "A.B", True), ("A.B.*", "A.B.C", True), ("A.B.*", "A.B.C.D", True), ("A.B.*", "A.BX", False), ("A.B.*", "A", False), ("A.B", "A.B", True), ("A.B", "A.B.C", False), ("A.*.C", "A.B.C", True), ("A.*.C", "A.C", False), ("A.*.C", "A.B.B.C", False),
    ("A.L*", "A.L", True), ("A.L*", "A.Lx", True), ("A.L*", "A.L.x", False), ("*", "A", True), ("*", "A.B", True), ("*", "", True), ("*.*", "A.B", False), ("A", "A\n", False), ("A.(x)", "A.(x)", True), ("A.[x]*", "A.[x]y", True),
]
NAMES = [("Order", "Order", True), ("Order", "Orders", False), ("Order", "order", False), ("*Repo", "XRepo", True), ("*Repo", "Repo", True), ("*Repo", "RepoX", False), ("I*", "I", True), ("I*", "XI", False), ("*R*", "xRy", True), ("*R*", "xy", False), ("*A*B", "xAyB", True), ("*A*B", "AB", True), ("*A*B", "ABx", False), ("*", "", True), ("a.c", "abc", False), ("A", "A\n", False)]


def test_truth_tables(spark):
    from pyspark.sql import functions as F

    for table, like, plain in ((NAMESPACES, patterns.namespace_like, patterns.matches_namespace), (NAMES, patterns.name_like, patterns.matches_name)):
        for pattern, value, want in table:
            assert plain(pattern, value) is want, (pattern, value)
        row = spark.range(1).select(*[like(F.lit(v), p).alias(str(i)) for i, (p, v, _) in enumerate(table)]).first()
        assert list(row) == [w for _, _, w in table]


@given(st.text(alphabet="aB.+*(", max_size=8), st.text(alphabet="aB.+(", max_size=8))
def test_name_pattern_is_a_wildcard(pattern, value):
    def wild(p, v):
        if not p:
            return not v
        return any(wild(p[1:], v[i:]) for i in range(len(v) + 1)) if p[0] == "*" else bool(v) and v[0] == p[0] and wild(p[1:], v[1:])

    assert patterns.matches_name(pattern, value) == wild(pattern, value)


def test_type_names():
    assert construct("N", [("Map", ("K", "V"))]) == TypeRef("N.Map<K, V>", "N.Map<K, V>")
    nested = construct("N", [("Out", ("T",)), ("In", ("U",))], ("A", TypeRef("L<T>", "L<B>")))
    assert nested == TypeRef("N.Out<T>.In<U>", "N.Out<A>.In<L<B>>") and nested.closed
    assert construct("", [("X", ())], ranks=(1, 3)).full_name == "X[][,,]"
    with pytest.raises(ValueError):
        construct("N", [("Map", ("K", "V"))], ("A",))
    assert names.simple_name("N.Out<A.B>.In<C.D>") == "In" and names.segment_depth("A.B.C<D.E>") == 2
    assert display_names(["A.X", "B.X", "A.C.Y"]) == {"A.X": "A.X", "B.X": "B.X", "A.C.Y": "Y"}
    assert names.attribute_label("N.MarkAttribute") == "[Mark]"


@given(st.lists(st.lists(st.sampled_from(["A", "B", "C", "G<A.B>"]), min_size=1, max_size=4).map(".".join), max_size=9))
def test_display_names_as_pairs_tell(full_names):
    want = {}
    for name in full_names:
        others = [x for x in full_names if x != name and names.simple_name(x) == names.simple_name(name)]
        k = 0
        while k < names.segment_depth(name) and any(names.qualified_name(x, k) == names.qualified_name(name, k) for x in others):
            k += 1
        want[name] = names.qualified_name(name, k)
    assert list(display_names(full_names).items()) == list(want.items())


def test_a_rule_may_ban_very_many_members(monkeypatch):
    calls, split = [0], names._depth_split

    def counted(name):
        calls[0] += 1
        return split(name)

    monkeypatch.setattr(names, "_depth_split", counted)
    s = Spec()
    s.rule("r").enforce(s.types().must_not_use(*[s.member(f"N.S{i % 7}.T{i // 2}", f"m{i}") for i in range(6_000)])).because("it is so")
    rule = s.build().rules[0]
    assert rule.sentence.count("`") == 12_000 and "T2999.m5999" in rule.sentence
    assert calls[0] < 20 * 6_000  # a few times each name, not each pair of names
    assert rule.constraint.operands[0].where.startswith("test_spec.py:")


def test_sentences():
    s = Spec()
    web = s.layer("Web", "A.Web.*")
    assert sentence(web.must_not_reference(s.type("A.X"), s.type("B.X"), s.namespace("C.*"))) == "The Web layer must not reference `A.X`, `B.X` or types in `C.*`."
    assert sentence(web.where(lambda t: t.is_static, "are static").with_suffix("Controller").except_(s.type("A.X")).must_be_sealed()) == "Types in the Web layer named `*Controller` that are static, but for `X` must be sealed."
    assert sentence(s.types().of_kind("Interface").must_have_prefix("I")) == "Interfaces must have names beginning with `I`."
    assert sentence(web.methods.returning("T.Task").must_have_suffix("Async")) == "Methods of the Web layer returning `Task` must have names ending in `Async`."
    assert sentence(s.registered("Singleton").must_not_use(s.member("S.Clock", "Now"), s.member("S.Task", "Wait", method=True))) == "Singleton registered types must not use `Clock.Now` or `Task.Wait()`."


def test_all_faults_at_once():
    other, s = Spec(), Spec()
    closed = TypeRef("G<T>", "G<X>")
    ok = s.types().must_be_sealed()
    s.rule("Bad Id").enforce(ok).because("x")
    s.rule("dup").enforce(ok).because("x")
    s.rule("dup").enforce(ok).because("x")
    s.rule("hang")
    s.rule("why").enforce(ok)
    s.rule("blank").enforce(ok).because(" ")
    s.rule("lines").enforce(ok).because("a\nb")
    s.rule("again").enforce(ok).because("x").because("y")
    b = s.rule("twice")
    b.enforce(ok)
    b.migrate("x", ok).because("x")
    s.scope("area").freeze(s.types()).because("x").boundary_only_via()
    s.rule("area/more").enforce(ok).because("x")
    s.rule("foreign").enforce(s.types().must_not_reference(other.types())).because("x")
    s.rule("member").enforce(s.types().must_not_use(s.member("T", " "), other.member("T", "M"), s.member("T", "Wait", declared=("Go",), inherited=(("Wait", "Base"),)))).because("x")
    s.rule("globs").enforce(s.namespace("A.*.B.*").with_suffix("").must_reside_in_namespace(" ")).because("x")
    s.rule("life").enforce(s.registered("Forever").must_be_public()).because("x")
    s.rule("returns").enforce(s.types().methods.returning(closed).must_accept_parameter(closed)).because("x")
    s.rule("category").enforce(s.types().must_implement(TypeRef("B", "B", "class"))).because("x")
    s.rule("category2").enforce(s.types().must_not_derive_from(TypeRef("I", "I", "interface"))).because("x")
    s.layer("L", "A"), s.layer("L", "")
    with pytest.raises(SpecError) as e:
        s.build()
    codes = {f.code for f in e.value.faults}
    assert codes == {
        "MalformedId", "DuplicateId", "DanglingAnchor", "MissingBecause", "BlankProse", "MultiLineProse", "RepeatedTrailer", "RepeatedPosture", "EmptyBoundary", "MissingDragons", "IdExtendsScope", "ForeignSelection", "BlankMemberName", "ForeignMember", "MemberNotDeclared",
        "UnanchoredSubtreePattern", "BlankPattern", "UndefinedLifetime", "MemberReturningClosedGeneric", "MemberAcceptParameterClosedGeneric", "HierarchyAnchorWrongCategory", "DuplicateLayerName",
    }
    assert any(f.where.startswith("test_spec.py:") for f in e.value.faults) and "Base" in str(e.value)


def test_managed_block_and_truncation():
    made = render.splice("intro\n", "body")
    assert render.splice(made, "other").count("other") == 1 and "body" not in render.splice(made, "other") and made.startswith("intro\n\n")
    with pytest.raises(ValueError):
        render.splice(render.BEGIN, "x")
    windows = "intro  \r\nmore\r\n\r\n"
    added = render.splice(windows, "a\nb")
    assert added == f"intro  \r\nmore\r\n\r\n{render.BEGIN}\r\na\r\nb\r\n{render.END}\r\n"
    assert render.splice(added + "tail \r\n", "c") == f"intro  \r\nmore\r\n\r\n{render.BEGIN}\r\nc\r\n{render.END}\r\ntail \r\n"
    assert render.splice(" \n", "x") == f"{render.BEGIN}\nx\n{render.END}\n"
    assert render.truncated("x" * 30_000).startswith("x") and len(render.truncated("x" * 30_000)) <= 25_000 and len(render.truncated("x" * 30_000, 100)) <= 250 and render.truncated("a") == "a"
