"""Rules as data: selections of a fact graph, what must hold for them, and the stance taken.

A Spec mints selections and rules; build() checks everything at once and returns the model.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .functions.names import TypeRef


@dataclass(frozen=True)
class Noun:
    """The scan that a selection starts from; kind is types, layer, namespace, project, type, registered or union."""

    kind: str
    name: str | None = None
    globs: tuple[str, ...] = ()
    ref: TypeRef | None = None
    lifetime: str | None = None
    parts: tuple[Selection, ...] = ()


@dataclass(frozen=True)
class Filter:
    """An adjective; kind names the test, value is its pattern, kind, reference, selection or predicate."""

    kind: str
    value: Any = None
    description: str | None = None
    python: bool = False


@dataclass(frozen=True)
class Selection:
    """A set of types: a noun, then filters."""

    owner: int
    noun: Noun
    filters: tuple[Filter, ...] = ()

    def _with(self, kind: str, value: Any, description: str | None = None, python: bool = False) -> Selection:
        return replace(self, filters=(*self.filters, Filter(kind, value, description, python)))

    def in_namespace(self, glob: str) -> Selection:
        """Those whose namespace matches."""
        return self._with("in_namespace", glob)

    def of_kind(self, kind: str) -> Selection:
        """Those of a kind: Class, Interface, Struct, Enum or Delegate."""
        return self._with("of_kind", kind)

    def with_suffix(self, text: str) -> Selection:
        """Those whose name ends so."""
        return self._with("with_suffix", text)

    def with_prefix(self, text: str) -> Selection:
        """Those whose name begins so."""
        return self._with("with_prefix", text)

    def with_name_matching(self, glob: str) -> Selection:
        """Those whose name matches."""
        return self._with("with_name_matching", glob)

    def implementing(self, ref: str | TypeRef) -> Selection:
        """Those that implement an interface, directly or not; a definition stands for all its constructions."""
        return self._with("implementing", TypeRef.of(ref))

    def derived_from(self, ref: str | TypeRef) -> Selection:
        """Those with a type among their bases."""
        return self._with("derived_from", TypeRef.of(ref))

    def attributed_with(self, ref: str | TypeRef) -> Selection:
        """Those that carry an attribute themselves."""
        return self._with("attributed_with", TypeRef.of(ref))

    def except_(self, other: Selection) -> Selection:
        """Those that other doesn't select; other is read as a target."""
        return self._with("except", other)

    def where(self, predicate: Callable, description: str, python: bool = False) -> Selection:
        """Those for which a predicate holds: a function from the type's columns to a Column, or with
        python=True one from a dictionary of the type's fields to a truth value."""
        return self._with("where", predicate, description, python)

    @property
    def members(self) -> MemberSelection:
        """All members."""
        return MemberSelection(self, None)

    @property
    def methods(self) -> MemberSelection:
        """The methods."""
        return MemberSelection(self, "Method")

    @property
    def properties(self) -> MemberSelection:
        """The properties."""
        return MemberSelection(self, "Property")

    @property
    def fields(self) -> MemberSelection:
        """The fields."""
        return MemberSelection(self, "Field")

    @property
    def events(self) -> MemberSelection:
        """The events."""
        return MemberSelection(self, "Event")

    def is_pattern(self) -> bool:
        """Whether it may rightly select nothing yet: anything but one type by name."""
        return self.noun.kind != "type" or bool(self.filters)

    # what must hold

    def _must(self, verb: str, operands: tuple = (), value: Any = None, description: str | None = None, python: bool = False) -> Constraint:
        return Constraint(verb, self, tuple(operands), value, description, python)

    def must_not_reference(self, first: Selection, *more: Selection) -> Constraint:
        """No reference to the operands."""
        return self._must("must_not_reference", (first, *more))

    def must_only_reference(self, first: Selection, *more: Selection) -> Constraint:
        """No reference within the graph but to the operands."""
        return self._must("must_only_reference", (first, *more))

    def must_not_be_referenced_by(self, first: Selection, *more: Selection) -> Constraint:
        """No reference from the operands."""
        return self._must("must_not_be_referenced_by", (first, *more))

    def must_only_be_referenced_by(self, first: Selection, *more: Selection) -> Constraint:
        """No reference but from the operands."""
        return self._must("must_only_be_referenced_by", (first, *more))

    def must_not_use(self, first: Member, *more: Member) -> Constraint:
        """No use of these members, whatever the overload."""
        return self._must("must_not_use", (first, *more))

    def must_not_construct(self, first: Selection, *more: Selection) -> Constraint:
        """No creation of the operands."""
        return self._must("must_not_construct", (first, *more))

    def must_not_inject(self, first: Selection, *more: Selection) -> Constraint:
        """The operands are no constructor parameters."""
        return self._must("must_not_inject", (first, *more))

    def must_not_catch(self, first: Selection, *more: Selection) -> Constraint:
        """The operands aren't caught."""
        return self._must("must_not_catch", (first, *more))

    def must_not_expose(self, first: Selection, *more: Selection) -> Constraint:
        """The operands aren't part of public signatures."""
        return self._must("must_not_expose", (first, *more))

    def must_only_throw(self, first: Selection, *more: Selection) -> Constraint:
        """Nothing but the operands is thrown."""
        return self._must("must_only_throw", (first, *more))

    def must_reside_in_namespace(self, glob: str) -> Constraint:
        """The namespace matches."""
        return self._must("must_reside_in_namespace", value=glob)

    def must_have_suffix(self, text: str) -> Constraint:
        """The name ends so."""
        return self._must("must_have_suffix", value=text)

    def must_have_prefix(self, text: str) -> Constraint:
        """The name begins so."""
        return self._must("must_have_prefix", value=text)

    def must_have_name_matching(self, glob: str) -> Constraint:
        """The name matches."""
        return self._must("must_have_name_matching", value=glob)

    def must_implement(self, ref: str | TypeRef) -> Constraint:
        """The interface is implemented."""
        return self._must("must_implement", value=(TypeRef.of(ref),))

    def must_derive_from(self, ref: str | TypeRef) -> Constraint:
        """The type is among the bases."""
        return self._must("must_derive_from", value=(TypeRef.of(ref),))

    def must_be_attributed_with(self, ref: str | TypeRef) -> Constraint:
        """The attribute is there."""
        return self._must("must_be_attributed_with", value=(TypeRef.of(ref),))

    def must_not_implement(self, first: str | TypeRef, *more: str | TypeRef) -> Constraint:
        """None of the interfaces is implemented."""
        return self._must("must_not_implement", value=tuple(map(TypeRef.of, (first, *more))))

    def must_not_derive_from(self, first: str | TypeRef, *more: str | TypeRef) -> Constraint:
        """None of the types is among the bases."""
        return self._must("must_not_derive_from", value=tuple(map(TypeRef.of, (first, *more))))

    def must_not_be_attributed_with(self, first: str | TypeRef, *more: str | TypeRef) -> Constraint:
        """None of the attributes is there."""
        return self._must("must_not_be_attributed_with", value=tuple(map(TypeRef.of, (first, *more))))

    def must_be_sealed(self) -> Constraint:
        """Sealed."""
        return self._must("must_be_sealed")

    def must_be_static(self) -> Constraint:
        """Static."""
        return self._must("must_be_static")

    def must_be_abstract(self) -> Constraint:
        """Abstract."""
        return self._must("must_be_abstract")

    def must_be_public(self) -> Constraint:
        """Public."""
        return self._must("must_be_public")

    def must_be_internal(self) -> Constraint:
        """Internal."""
        return self._must("must_be_internal")

    def must(self, predicate: Callable, description: str, python: bool = False) -> Constraint:
        """A predicate holds; see where()."""
        return self._must("must", value=predicate, description=description, python=python)


@dataclass(frozen=True)
class MemberSelection:
    """The members, of a kind or all, that the types of a selection declare."""

    source: Selection
    kind: str | None
    filters: tuple[Filter, ...] = ()

    def _with(self, kind: str, value: Any, description: str | None = None, python: bool = False) -> MemberSelection:
        return replace(self, filters=(*self.filters, Filter(kind, value, description, python)))

    def with_suffix(self, text: str) -> MemberSelection:
        """Those whose name ends so."""
        return self._with("with_suffix", text)

    def with_prefix(self, text: str) -> MemberSelection:
        """Those whose name begins so."""
        return self._with("with_prefix", text)

    def with_name_matching(self, glob: str) -> MemberSelection:
        """Those whose name matches."""
        return self._with("with_name_matching", glob)

    def returning(self, first: str | TypeRef, *more: str | TypeRef) -> MemberSelection:
        """Methods that return one of the definitions."""
        if self.kind != "Method":
            raise TypeError("only methods return")
        return self._with("returning", tuple(map(TypeRef.of, (first, *more))))

    def where(self, predicate: Callable, description: str, python: bool = False) -> MemberSelection:
        """Those for which a predicate holds; see Selection.where()."""
        return self._with("where", predicate, description, python)

    def _must(self, verb: str, value: Any = None, description: str | None = None, python: bool = False) -> Constraint:
        return Constraint(verb, self, (), value, description, python)

    def must_have_suffix(self, text: str) -> Constraint:
        """The name ends so."""
        return self._must("must_have_suffix", text)

    def must_have_prefix(self, text: str) -> Constraint:
        """The name begins so."""
        return self._must("must_have_prefix", text)

    def must_have_name_matching(self, glob: str) -> Constraint:
        """The name matches."""
        return self._must("must_have_name_matching", glob)

    def must_be_public(self) -> Constraint:
        """Public."""
        return self._must("must_be_public")

    def must_be_internal(self) -> Constraint:
        """Internal."""
        return self._must("must_be_internal")

    def must_be_private(self) -> Constraint:
        """Private."""
        return self._must("must_be_private")

    def must_be_static(self) -> Constraint:
        """Static."""
        return self._must("must_be_static")

    def must_be_abstract(self) -> Constraint:
        """Abstract."""
        return self._must("must_be_abstract")

    def must_be_virtual(self) -> Constraint:
        """Virtual."""
        return self._must("must_be_virtual")

    def must_accept_parameter(self, ref: str | TypeRef) -> Constraint:
        """A parameter of this definition is among the method's."""
        if self.kind != "Method":
            raise TypeError("only methods accept parameters")
        return self._must("must_accept_parameter", TypeRef.of(ref))

    def must(self, predicate: Callable, description: str, python: bool = False) -> Constraint:
        """A predicate holds; see Selection.where()."""
        return self._must("must", predicate, description, python)


@dataclass(frozen=True)
class Member:
    """A member that may be banned: by type and name, all overloads."""

    owner: int
    type: TypeRef
    name: str
    method: bool = False
    where: str = ""
    #: names that the type declares, if known, to catch misspelt ones; and the base that declares others
    declared: tuple[str, ...] | None = None
    inherited: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Constraint:
    """A subject, what must hold for it, and what that is said of."""

    verb: str
    subject: Selection | MemberSelection
    operands: tuple = ()
    value: Any = None
    description: str | None = None
    python: bool = False

    @property
    def types(self) -> Selection:
        """The types that the subject is about."""
        return self.subject.source if isinstance(self.subject, MemberSelection) else self.subject


@dataclass
class Rule:
    """A rule of a built model."""

    id: str
    posture: str  # enforce, migrate or freeze
    constraint: Constraint | None
    because: str = ""
    fix: str | None = None
    sentence: str = ""
    baseline_path: str | None = None
    policy: str | None = None
    from_: str | None = None
    role: str | None = None  # of a frozen scope: containment or tripwire
    frozen: Selection | None = None
    dragons: str | None = None
    dragons_doc: str | None = None


@dataclass
class Model:
    """The rules in order, and the layers."""

    rules: list[Rule]
    layers: dict[str, Noun]


@dataclass
class _Draft:
    """What the builders of a rule or scope have been told."""

    id: str
    where: str
    scope: bool
    postures: int = 0
    posture: str | None = None
    constraint: Constraint | None = None
    frozen: Selection | None = None
    facades: tuple[TypeRef, ...] | None = None
    said: dict[str, list] = field(default_factory=dict)

    def get(self, key: str) -> Any:
        return self.said.get(key, [None])[-1]


def _caller() -> str:
    # frames as they are: a spec may have very many members, and inspect.stack() reads the sources each time
    f = sys._getframe(2)
    while f is not None:
        if Path(f.f_code.co_filename).parent != Path(__file__).parent:
            return f"{Path(f.f_code.co_filename).name}:{f.f_lineno}"
        f = f.f_back
    return ""


class RuleBuilder:
    """Says what a rule is; every method returns the builder."""

    def __init__(self, draft: _Draft) -> None:
        self._draft = draft

    def _said(self, key: str, value: Any) -> RuleBuilder:
        self._draft.said.setdefault(key, []).append(value)
        return self

    def _posture(self, posture: str, constraint: Constraint | None) -> RuleBuilder:
        self._draft.postures += 1
        self._draft.posture, self._draft.constraint = posture, constraint
        return self

    def enforce(self, constraint: Constraint) -> RuleBuilder:
        """It holds now."""
        return self._posture("enforce", constraint)

    def migrate(self, from_: str, to: Constraint) -> RuleBuilder:
        """It holds but for what a baseline records."""
        self._said("from", from_)
        return self._posture("migrate", to)

    def because(self, text: str) -> RuleBuilder:
        """Why."""
        return self._said("because", text)

    def fix(self, text: str) -> RuleBuilder:
        """What to do instead."""
        return self._said("fix", text)

    def baseline(self, path: str) -> RuleBuilder:
        """Where the baseline is, if not in the usual place."""
        return self._said("baseline", path)

    def policy(self, name: str) -> RuleBuilder:
        """migrate_if_small, always_migrate or never_expand."""
        return self._said("policy", name)


class ScopeBuilder(RuleBuilder):
    """Says what a frozen area is."""

    def freeze(self, selection: Selection) -> ScopeBuilder:
        """Nothing new may come to depend on it."""
        self._draft.postures += 1
        self._draft.posture, self._draft.frozen = "freeze", selection
        return self

    def boundary_only_via(self, *types: str | TypeRef) -> ScopeBuilder:
        """The types through which the rest may use it."""
        self._draft.facades = tuple(map(TypeRef.of, types))
        return self._said("boundary", types)

    def dragons(self, text: str) -> ScopeBuilder:
        """What lurks in it."""
        return self._said("dragons", text)

    def dragons_doc(self, path: str) -> ScopeBuilder:
        """Where that is written down."""
        return self._said("dragons_doc", path)


class Spec:
    """Mints the selections and rules of one model."""

    def __init__(self) -> None:
        self.drafts: list[_Draft] = []
        self.layers: list[Noun] = []

    def _selection(self, noun: Noun) -> Selection:
        return Selection(id(self), noun)

    def types(self) -> Selection:
        """All types of the graph itself, also where it is a target."""
        return self._selection(Noun("types"))

    def layer(self, name: str, glob: str, *more: str) -> Selection:
        """Types in any of the namespaces, under a name."""
        noun = Noun("layer", name=name, globs=(glob, *more))
        self.layers.append(noun)
        return self._selection(noun)

    def namespace(self, glob: str) -> Selection:
        """Types in a namespace."""
        return self._selection(Noun("namespace", globs=(glob,)))

    def project(self, name: str) -> Selection:
        """Types of a project; as a target also those of an outside library of this name."""
        return self._selection(Noun("project", name=name))

    def type(self, ref: str | TypeRef) -> Selection:
        """One type."""
        return self._selection(Noun("type", ref=TypeRef.of(ref)))

    def registered(self, lifetime: str | None = None) -> Selection:
        """Services and implementations registered with a lifetime, or any."""
        return self._selection(Noun("registered", lifetime=lifetime))

    def member(self, type: str | TypeRef, name: str, method: bool = False, declared: tuple[str, ...] | None = None, inherited: tuple[tuple[str, str], ...] = ()) -> Member:
        """A member to ban. declared lists what the type declares, inherited (name, base) what a base does."""
        return Member(id(self), TypeRef.of(type), name, method, _caller(), declared, inherited)

    def rule(self, id_: str) -> RuleBuilder:
        """A rule under an id of lower-case words parted by - and /."""
        self.drafts.append(_Draft(id_, _caller(), False))
        return RuleBuilder(self.drafts[-1])

    def scope(self, id_: str) -> ScopeBuilder:
        """A frozen area under an id; it becomes two rules."""
        self.drafts.append(_Draft(id_, _caller(), True))
        return ScopeBuilder(self.drafts[-1])

    def build(self) -> Model:
        """The model; SpecError with all faults at once if there are any."""
        from .validate import SpecError, faults

        found = faults(self)
        if found:
            raise SpecError(found)
        rules = [r for d in self.drafts for r in expand(d, id(self))]
        return Model(rules, {n.name: n for n in self.layers})


def baseline_path(rule_id: str) -> str:
    """The usual place of a rule's baseline."""
    return f"arch/baselines/{rule_id}.json"


def expand(draft: _Draft, owner: int) -> list[Rule]:
    """The rules of a draft; a frozen area is one on containment, which has a baseline, and a
    tripwire on changes."""
    from .prose import sentence

    because, fix = draft.get("because") or "", draft.get("fix")
    if not draft.scope:
        rule = Rule(draft.id, draft.posture or "", draft.constraint, because, fix, sentence(draft.constraint) if draft.constraint else "")
        if draft.posture == "migrate":
            rule.baseline_path = draft.get("baseline") or baseline_path(draft.id)
            rule.policy, rule.from_ = draft.get("policy") or "migrate_if_small", draft.get("from")
        return [rule]
    constraint = None
    inside = f"{draft.id}/containment"
    if draft.frozen is not None:
        facades = [Selection(owner, Noun("type", ref=t)) for t in draft.facades or ()]
        if facades:
            way = facades[0] if len(facades) == 1 else Selection(owner, Noun("union", parts=tuple(facades)))
            # the facades are free for all, and they as well as the area itself may use the area
            constraint = draft.frozen.except_(way).must_only_be_referenced_by(draft.frozen, *facades)
        else:
            constraint = draft.frozen.must_only_be_referenced_by(draft.frozen)
    common = {"because": because, "fix": fix, "frozen": draft.frozen, "dragons": draft.get("dragons"), "dragons_doc": draft.get("dragons_doc")}
    return [
        Rule(inside, "freeze", constraint, sentence=sentence(constraint) if constraint else "", baseline_path=draft.get("baseline") or baseline_path(inside), role="containment", **common),
        Rule(f"{draft.id}/tripwire", "freeze", None, role="tripwire", **common),
    ]
