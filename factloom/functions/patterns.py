"""Glob patterns, compiled once to anchored regular expressions.

A namespace pattern is matched segment by segment: `A.B.*` is A.B and everything below it, a
segment `*` is any one segment, and a `*` inside a segment is any run without a dot. A name
pattern knows `*` only, as any run, also an empty one. Case counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}\-&~#])")


def _quoted(text: str) -> str:
    """text with every sign taken literally, the same in Java, Python and RE2."""
    return _SPECIAL.sub(r"\\\1", text)


def namespace_regex(pattern: str) -> str:
    """The expression that a namespace matches exactly if the pattern does; for search, not match."""
    if pattern == "*":
        return r"\A[\s\S]*\z"
    if pattern.endswith(".*"):
        return rf"\A{_quoted(pattern[:-2])}(?:\.[\s\S]*)?\z"
    segments = []
    for s in pattern.split("."):
        segments.append("[^.]+" if s == "*" else "[^.]*".join(_quoted(x) for x in s.split("*")))
    return rf"\A{r'\.'.join(segments)}\z"


def name_regex(pattern: str) -> str:
    """The expression that a simple name matches exactly if the pattern does."""
    return rf"\A{r'[\s\S]*'.join(_quoted(x) for x in pattern.split('*'))}\z"


def namespace_like(column: Column, pattern: str) -> Column:
    """Whether a namespace matches; the plain cases as comparisons, which the scan can use."""
    if "*" not in pattern:
        return column == F.lit(pattern)
    return column.rlike(namespace_regex(pattern))


def name_like(column: Column, pattern: str) -> Column:
    """Whether a name matches."""
    if "*" not in pattern:
        return column == F.lit(pattern)
    return column.rlike(name_regex(pattern))


def _python(expression: str) -> str:
    return expression.replace(r"\z", r"\Z")


def matches_namespace(pattern: str, namespace: str) -> bool:
    """namespace_like() of one value on the driver."""
    return re.search(_python(namespace_regex(pattern)), namespace) is not None


def matches_name(pattern: str, name: str) -> bool:
    """name_like() of one value on the driver."""
    return re.search(_python(name_regex(pattern)), name) is not None


def pattern_fault(pattern: str) -> str | None:
    """What is wrong with a namespace pattern: "blank", or "dead" if it can never match; else None."""
    if not pattern or not pattern.strip():
        return "blank"
    if pattern.endswith(".*") and "*" in pattern[:-2]:
        return "dead"
    return None
