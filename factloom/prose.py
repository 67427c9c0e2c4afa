"""What a rule says, in one sentence that depends on nothing but the rule."""

from __future__ import annotations

from .functions.names import attribute_label, display_names, simple_name
from .spec import Constraint, Filter, MemberSelection, Noun, Selection

_PLURAL = {"Class": "classes", "Interface": "interfaces", "Struct": "structs", "Enum": "enums", "Delegate": "delegates", None: "members", "Method": "methods", "Property": "properties", "Field": "fields", "Event": "events"}


def tick(text: str) -> str:
    """text as code."""
    return f"`{text}`"


def listed(parts: list[str], last: str = "or") -> str:
    """a, b or c."""
    return parts[0] if len(parts) == 1 else f"{', '.join(parts[:-1])} {last} {parts[-1]}"


def _noun(noun: Noun) -> str:
    match noun.kind:
        case "types":
            return "types"
        case "layer":
            return f"the {noun.name} layer"
        case "namespace":
            return f"types in {tick(noun.globs[0])}"
        case "project":
            return f"types of project {tick(noun.name or '')}"
        case "type":
            return tick(simple_name(noun.ref.full_name))
        case "registered":
            return f"{noun.lifetime.lower() + ' ' if noun.lifetime else ''}registered types"
    return listed([reference(p) for p in noun.parts])


def _filter(f: Filter) -> str:
    match f.kind:
        case "in_namespace":
            return f" in {tick(f.value)}"
        case "with_suffix":
            return f" named {tick('*' + f.value)}"
        case "with_prefix":
            return f" named {tick(f.value + '*')}"
        case "with_name_matching":
            return f" named {tick(f.value)}"
        case "implementing":
            return f" implementing {tick(simple_name(f.value.full_name))}"
        case "derived_from":
            return f" derived from {tick(simple_name(f.value.full_name))}"
        case "attributed_with":
            return f" marked {tick(attribute_label(f.value.full_name))}"
        case "returning":
            return f" returning {listed([tick(simple_name(r.full_name)) for r in f.value])}"
        case "except":
            return f", but for {reference(f.value)},"
        case "where":
            return f" that {f.description}"
    return ""


def reference(selection: Selection) -> str:
    """How a selection is spoken of."""
    filters = selection.filters
    if not filters:
        return _noun(selection.noun)
    kinds = [f for f in filters if f.kind == "of_kind"]
    head = _PLURAL.get(kinds[-1].value, "types") if kinds else "types"
    match selection.noun.kind:
        case "types":
            base = head
        case "layer":
            base = f"{head} in the {selection.noun.name} layer"
        case "namespace":
            base = f"{head} in {tick(selection.noun.globs[0])}"
        case "project":
            base = f"{head} of project {tick(selection.noun.name or '')}"
        case "type":
            base = f"{head} {_noun(selection.noun)}"
        case _:
            base = _noun(selection.noun)
    # exceptions and conditions go last, in the order given
    late = ("except", "where")
    text = base + "".join(_filter(f) for f in filters if f.kind not in late and f.kind != "of_kind") + "".join(_filter(f) for f in filters if f.kind in late)
    return text.rstrip(",")


def subject(s: Selection | MemberSelection) -> str:
    """The beginning of a sentence about a selection."""
    if isinstance(s, MemberSelection):
        late = ("where",)
        text = f"{_PLURAL[s.kind]} of {reference(s.source)}" + "".join(_filter(f) for f in s.filters if f.kind not in late) + "".join(_filter(f) for f in s.filters if f.kind in late)
    else:
        text = reference(s)
    return text[:1].upper() + text[1:]


def _targets(operands: tuple) -> str:
    shown = display_names([o.noun.ref.full_name for o in operands if o.noun.kind == "type" and not o.filters])
    return listed([tick(shown[o.noun.ref.full_name]) if o.noun.kind == "type" and not o.filters else reference(o) for o in operands])


_EDGE = {
    "must_not_reference": "must not reference", "must_only_reference": "must reference only", "must_not_be_referenced_by": "must not be referenced by", "must_only_be_referenced_by": "must be referenced only by", "must_not_construct": "must not construct", "must_not_inject": "must not take by injection",
    "must_not_catch": "must not catch", "must_not_expose": "must not expose", "must_only_throw": "must throw only",
}
_PLAIN = {"must_be_sealed": "be sealed", "must_be_static": "be static", "must_be_abstract": "be abstract", "must_be_public": "be public", "must_be_internal": "be internal", "must_be_private": "be private", "must_be_virtual": "be virtual"}
_REFS = {"must_implement": "must implement", "must_derive_from": "must derive from", "must_be_attributed_with": "must be marked", "must_not_implement": "must not implement", "must_not_derive_from": "must not derive from", "must_not_be_attributed_with": "must not be marked"}


def verb_phrase(c: Constraint) -> str:
    """What must hold."""
    if c.verb in _EDGE:
        return f"{_EDGE[c.verb]} {_targets(c.operands)}"
    if c.verb in _PLAIN:
        return f"must {_PLAIN[c.verb]}"
    if c.verb in _REFS:
        names = [attribute_label(r.full_name) if "attributed" in c.verb else simple_name(r.full_name) for r in c.value]
        return f"{_REFS[c.verb]} {listed([tick(n) for n in names])}"
    match c.verb:
        case "must_not_use":
            shown = display_names([m.type.full_name for m in c.operands])
            return "must not use " + listed([tick(f"{shown[m.type.full_name]}.{m.name}{'()' * m.method}") for m in c.operands])
        case "must_reside_in_namespace":
            return f"must live in {tick(c.value)}"
        case "must_have_suffix":
            return f"must have names ending in {tick(c.value)}"
        case "must_have_prefix":
            return f"must have names beginning with {tick(c.value)}"
        case "must_have_name_matching":
            return f"must have names like {tick(c.value)}"
        case "must_accept_parameter":
            return f"must accept a {tick(simple_name(c.value.full_name))}"
    return f"must {c.description}"


def sentence(c: Constraint) -> str:
    """The rule's sentence."""
    return f"{subject(c.subject)} {verb_phrase(c)}."


def layer_definition(noun: Noun) -> str:
    """A line of the map of layers."""
    return f"**{noun.name}**: {', '.join(tick(g) for g in noun.globs)}"
