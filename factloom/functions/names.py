"""Type references and the names they are shown by."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TypeRef:
    """A type by name: definition is what facts are keyed by, full_name what was written. They
    differ for a generic type with arguments, which is then closed."""

    definition: str
    full_name: str
    #: interface, class, attribute or None where unknown
    category: str | None = None

    @property
    def closed(self) -> bool:
        """Whether it is a generic type with arguments."""
        return self.definition != self.full_name

    @staticmethod
    def of(value: str | TypeRef) -> TypeRef:
        """A reference from a full name, taken as a definition."""
        return value if isinstance(value, TypeRef) else TypeRef(value, value)


def construct(namespace: str, chain: list[tuple[str, tuple[str, ...]]], arguments: tuple[str | TypeRef, ...] = (), ranks: tuple[int, ...] = ()) -> TypeRef:
    """A reference from its parts: (name, parameters) of each containing type and itself,
    outermost first; arguments for all parameters in order, or none for the open definition.

    ranks make arrays of it, outermost first. Some arguments only are refused.
    """
    wanted = [p for _, ps in chain for p in ps]
    given = [a.full_name if isinstance(a, TypeRef) else a for a in arguments]
    if given and len(given) != len(wanted):
        raise ValueError("a type is either open or has all its arguments")

    def shown(values: list[str]) -> str:
        parts, at = [], 0
        for name, ps in chain:
            own = values[at : at + len(ps)]
            at += len(ps)
            parts.append(f"{name}<{', '.join(own)}>" if own else name)
        return ".".join(([namespace] if namespace else []) + parts)

    tail = "".join(f"[{',' * (r - 1)}]" for r in ranks)
    return TypeRef(shown(wanted) + tail, shown(given or wanted) + tail)


def _depth_split(name: str) -> list[str]:
    """The dotted segments of a name; dots between angle brackets don't part."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(name):
        depth += (c == "<") - (c == ">")
        if c == "." and not depth:
            parts.append(name[start:i])
            start = i + 1
    return [*parts, name[start:]]


def simple_name(full_name: str) -> str:
    """The last segment, without type arguments."""
    return re.sub(r"<.*>", "", _depth_split(full_name)[-1])


def qualified_name(full_name: str, segments: int) -> str:
    """The simple name with so many segments before it."""
    own = _depth_split(full_name)
    return ".".join([*own[-1 - segments : -1], simple_name(full_name)] if segments else [simple_name(full_name)])


def segment_depth(full_name: str) -> int:
    """How many segments stand before the simple name."""
    return len(_depth_split(full_name)) - 1


def display_names(full_names: list[str]) -> dict[str, str]:
    """For each name its simple name; where two share one, as few segments before it as tell them apart.

    Names that share a simple name are counted by their ends, longer ones each time, so the work
    grows with the names and not with their pairs.
    """
    alike: dict[str, list[str]] = {}
    for name in dict.fromkeys(full_names):
        alike.setdefault(simple_name(name), []).append(name)
    out = dict.fromkeys(full_names, "")
    for names in alike.values():
        k, open_ = 0, names
        while open_:
            ends = {x: qualified_name(x, k) for x in names}
            count = Counter(ends.values())
            out |= {x: ends[x] for x in open_}
            open_ = [x for x in open_ if count[ends[x]] > 1 and k < segment_depth(x)]
            k += 1
    return out


def attribute_label(full_name: str) -> str:
    """An attribute's simple name without its customary ending, in brackets."""
    name = simple_name(full_name)
    return f"[{name.removesuffix('Attribute') or name}]"


def symbol_display(symbol_id: Column) -> Column:
    """A symbol id without the letter of its kind."""
    return F.regexp_replace(symbol_id, r"\A[TMPFE]:", "")


def member_display(type_name: Column, member: Column, kind: Column) -> Column:
    """Type.Member, with parentheses for a method."""
    simple = F.regexp_replace(F.element_at(F.split(F.regexp_replace(type_name, r"<.*>", ""), r"\."), -1), r"<.*>", "")
    return F.concat(simple, F.lit("."), member, F.when(kind == "Method", F.lit("()")).otherwise(F.lit("")))


def relative_path(path: Column, root: str) -> Column:
    """path below root, with forward slashes; a path elsewhere stays."""
    own, base = F.translate(path, "\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(own.startswith(base), F.substring(own, len(base) + 1, 1 << 30)).otherwise(own) if root else own


def namespace_root(namespace: Column) -> Column:
    """The first two segments of a namespace, or (global)."""
    return F.when(namespace == "", F.lit("(global)")).otherwise(F.substring_index(namespace, ".", 2))
