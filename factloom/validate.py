"""Everything that can be wrong with a spec, found in one go."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from .functions.names import TypeRef
from .functions.patterns import pattern_fault
from .schema import LIFETIMES
from .spec import Constraint, Filter, Member, MemberSelection, Selection

if TYPE_CHECKING:
    from .spec import Spec

_ID = re.compile(r"[a-z0-9-]+(/[a-z0-9-]+)*\Z")
_ONCE = ("because", "fix", "baseline", "policy", "boundary", "dragons", "dragons_doc")


@dataclass(frozen=True)
class Fault:
    """What is wrong (code), with what, and where in the spec's source."""

    code: str
    message: str
    where: str = ""


class SpecError(ValueError):
    """A spec with faults, all of them."""

    def __init__(self, found: list[Fault]) -> None:
        super().__init__("\n".join(f"{f.where + ': ' if f.where else ''}{f.code}: {f.message}" for f in found))
        self.faults = found


def _selections(s: Selection) -> Iterator[Selection]:
    yield s
    for p in s.noun.parts:
        yield from _selections(p)
    for f in s.filters:
        if f.kind == "except":
            yield from _selections(f.value)


def _filters(c: Constraint) -> Iterator[tuple[Filter, bool]]:
    """All filters, and whether they are on members."""
    for s in _all_selections(c):
        yield from ((f, False) for f in s.filters)
    if isinstance(c.subject, MemberSelection):
        yield from ((f, True) for f in c.subject.filters)


def _all_selections(c: Constraint) -> Iterator[Selection]:
    yield from _selections(c.types)
    for o in c.operands:
        if isinstance(o, Selection):
            yield from _selections(o)


def _prose(text: str | None, what: str, where: str) -> Iterator[Fault]:
    if text is None:
        return
    if not text.strip():
        yield Fault("BlankProse", f"{what} is blank", where)
    elif "\n" in text or "\r" in text or text.lstrip()[0] in "#>|" or re.match(r"\s*([-*+]|\d+\.)\s|\s*```", text):
        yield Fault("MultiLineProse", f"{what} must be one plain line", where)


def _category(verb: str, ref: TypeRef, what: str, where: str) -> Iterator[Fault]:
    c = ref.category
    if c is None:
        return
    if "implement" in verb and c != "interface":
        yield Fault("HierarchyAnchorWrongCategory", f"{what}: {verb} takes an interface, and `{ref.full_name}` is none; a base goes with the deriving verbs", where)
    if "derive" in verb and c == "interface":
        yield Fault("HierarchyAnchorWrongCategory", f"{what}: {verb} takes no interface, and `{ref.full_name}` is one; it goes with the implementing verbs", where)
    if "attributed" in verb and c != "attribute":
        yield Fault("HierarchyAnchorWrongCategory", f"{what}: {verb} takes an attribute, and `{ref.full_name}` is none", where)


def _constraint(c: Constraint, what: str, where: str, owner: int) -> Iterator[Fault]:
    for s in _all_selections(c):
        if s.owner != owner:
            yield Fault("ForeignSelection", f"{what} uses a selection of another spec", where)
        n = s.noun
        if n.kind == "namespace":
            yield from _glob(n.globs[0], what, where)
        if n.kind == "registered" and n.lifetime is not None and n.lifetime not in LIFETIMES:
            yield Fault("UndefinedLifetime", f"{what}: `{n.lifetime}` is no lifetime; there are {', '.join(LIFETIMES)}", where)
    for f, on_members in _filters(c):
        if f.kind in ("with_suffix", "with_prefix", "with_name_matching") and not f.value.strip():
            yield Fault("BlankPattern", f"{what}: {f.kind} is blank", where)
        if f.kind == "in_namespace":
            yield from _glob(f.value, what, where)
        if f.kind == "where":
            yield from _prose(f.description, f"{what}: the description of a condition", where)
        if f.kind == "returning":
            for r in f.value:
                if r.closed:
                    yield Fault("MemberReturningClosedGeneric", f"{what}: `{r.full_name}` has arguments, and return types are matched by definition: use `{r.definition}`", where)
    if c.verb in ("must_have_suffix", "must_have_prefix", "must_have_name_matching") and not c.value.strip():
        yield Fault("BlankPattern", f"{what}: {c.verb} is blank", where)
    if c.verb == "must_reside_in_namespace":
        yield from _glob(c.value, what, where)
    if c.verb == "must":
        yield from _prose(c.description, f"{what}: the description of a demand", where)
    if c.verb == "must_accept_parameter" and c.value.closed:
        yield Fault("MemberAcceptParameterClosedGeneric", f"{what}: `{c.value.full_name}` has arguments, and parameters are matched by definition: use `{c.value.definition}`", where)
    if isinstance(c.value, tuple):
        for r in c.value:
            yield from _category(c.verb, r, what, where)
    for m in c.operands:
        if isinstance(m, Member):
            yield from _member(m, what, where, owner)


def _member(m: Member, what: str, where: str, owner: int) -> Iterator[Fault]:
    at = m.where or where
    if m.owner != owner:
        yield Fault("ForeignMember", f"{what} uses a member of another spec", at)
    if not m.name.strip():
        yield Fault("BlankMemberName", f"{what} bans a member without a name", at)
    elif m.declared is not None and m.name not in m.declared:
        base = dict(m.inherited).get(m.name)
        more = f"; its base `{base}` does: name that" if base else ""
        yield Fault("MemberNotDeclared", f"{what}: `{m.type.definition}` doesn't declare `{m.name}`{more}", at)


def _glob(glob: str, what: str, where: str) -> Iterator[Fault]:
    fault = pattern_fault(glob)
    if fault == "blank":
        yield Fault("BlankPattern", f"{what}: a namespace pattern is blank", where)
    if fault == "dead":
        yield Fault("UnanchoredSubtreePattern", f"{what}: `{glob}` matches nothing, since what stands before a final `.*` is taken literally", where)


def faults(spec: Spec) -> list[Fault]:
    """All faults of a spec, in the order of its rules."""
    found: list[Fault] = []
    owner = id(spec)
    scopes = [d.id for d in spec.drafts if d.scope]
    made: list[tuple[str, str]] = []
    for d in spec.drafts:
        what = f"'{d.id}'"
        made += [(f"{d.id}/{k}", d.where) for k in ("containment", "tripwire")] if d.scope else []
        made.append((d.id, d.where))
        if not _ID.match(d.id):
            found.append(Fault("MalformedId", f"{what} isn't made of lower-case words, digits, - and /", d.where))
        if any(d.id.startswith(s + "/") for s in scopes):
            found.append(Fault("IdExtendsScope", f"{what} lies under the id of a frozen area", d.where))
        if not d.postures:
            found.append(Fault("DanglingAnchor", f"{what} says nothing", d.where))
            continue
        if d.postures > 1:
            found.append(Fault("RepeatedPosture", f"{what} takes {d.postures} stances", d.where))
        if d.get("because") is None:
            found.append(Fault("MissingBecause", f"{what} doesn't say why", d.where))
        if d.scope and d.get("dragons") is None and d.get("dragons_doc") is None:
            found.append(Fault("MissingDragons", f"{what} doesn't say what lurks in it", d.where))
        for k in ("because", "fix", "from", "dragons"):
            for text in d.said.get(k, []):
                found += _prose(text, f"{what}: {k}", d.where)
        for k in ("baseline", "dragons_doc"):
            for text in d.said.get(k, []):
                if text is not None and not text.strip():
                    found.append(Fault("BlankProse", f"{what}: {k} is blank", d.where))
        found += [Fault("RepeatedTrailer", f"{what} says {k} {len(d.said[k])} times", d.where) for k in _ONCE if len(d.said.get(k, [])) > 1]
        if d.facades == ():
            found.append(Fault("EmptyBoundary", f"{what} has a boundary of no types; without one, nothing may pass", d.where))
        if d.constraint is not None:
            found += _constraint(d.constraint, what, d.where, owner)
        if d.frozen is not None:
            found += _constraint(d.frozen.must_only_be_referenced_by(d.frozen), what, d.where, owner)
    ids = Counter(i for i, _ in made)
    found += [Fault("DuplicateId", f"'{i}' stands for {n} rules", next(w for j, w in reversed(made) if j == i)) for i, n in ids.items() if n > 1]
    names = Counter(n.name for n in spec.layers)
    found += [Fault("DuplicateLayerName", f"{n} layers are called '{name}'") for name, n in names.items() if n > 1]
    for n in spec.layers:
        for g in n.globs:
            found += _glob(g, f"layer '{n.name}'", "")
    return list(dict.fromkeys(found))
