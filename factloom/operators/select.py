"""Selections as boolean columns of the types table, so that one scan serves all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import TypeRef
from ..functions.patterns import name_like, namespace_like
from ..schema import Facts
from ..spec import Filter, MemberSelection, Noun, Selection


class RuleFault(Exception):
    """A rule that can't be evaluated, with the reason."""


def columns_of(df: DataFrame, prefix: str = "") -> SimpleNamespace:
    """The columns of a table by name, as a predicate gets them."""
    return SimpleNamespace(**{c: F.col(prefix + c) for c in df.columns if c.isidentifier()})


@dataclass
class Scan:
    """What is computed along with the types table: flags of selections, and errors of predicates.

    registered: which registration flags to join. columns: name to Column, evaluated in one
    select. errors: names of string columns that predicates of a selection may set.
    """

    facts: Facts
    registered: bool = False
    columns: dict[str, Column] = field(default_factory=dict)
    errors: dict[str, list[str]] = field(default_factory=dict)
    _seen: dict[tuple[Selection, str], str] = field(default_factory=dict)

    def flag(self, selection: Selection, position: str) -> str:
        """The name of the boolean column that says whether a type is in selection; position is subject or target."""
        key = (selection, position)
        if key not in self._seen:
            errors: list[str] = []
            found = F.coalesce(self.membership(selection, position, errors), F.lit(False))
            # a selection that can't be evaluated gets no flag, and fails again when asked for again
            name = self._seen[key] = f"s{len(self._seen)}"
            self.columns[name], self.errors[name] = found, errors
        return self._seen[key]

    def membership(self, s: Selection, position: str, errors: list[str]) -> Column:
        """The condition; errors gets the columns in which its predicates report failures."""
        found = self._noun(s.noun, position, errors)
        if position == "subject":
            found = ~F.col("is_external") & found
        for f in s.filters:
            if f.kind == "where" and f.python:
                found = self._guarded(f, found, errors)
            else:
                found = found & F.coalesce(self._filter(f, errors), F.lit(False))
        return found

    def _noun(self, n: Noun, position: str, errors: list[str]) -> Column:
        match n.kind:
            case "types":
                return ~F.col("is_external")
            case "layer" | "namespace":
                return reduce(lambda a, b: a | b, [namespace_like(F.col("namespace"), g) for g in n.globs])
            case "project":
                return F.col("project_name") == F.lit(n.name)
            case "type":
                if n.ref.closed:
                    raise RuleFault(f"`{n.ref.full_name}` has type arguments; facts know only `{n.ref.definition}`")
                return F.col("full_name") == F.lit(n.ref.definition)
            case "registered":
                self.registered = True
                return F.coalesce(F.col("__lifetimes") if n.lifetime is None else F.array_contains("__which", n.lifetime), F.lit(False))
            case "union":
                return reduce(lambda a, b: a | b, [self.membership(p, position, errors) for p in n.parts])
        raise RuleFault(f"there is no noun {n.kind}")

    def _filter(self, f: Filter, errors: list[str]) -> Column:
        match f.kind:
            case "in_namespace":
                return namespace_like(F.col("namespace"), f.value)
            case "of_kind":
                return F.col("kind") == F.lit(f.value)
            case "with_suffix":
                return F.col("name").endswith(f.value)
            case "with_prefix":
                return F.col("name").startswith(f.value)
            case "with_name_matching":
                return name_like(F.col("name"), f.value)
            case "implementing":
                return built_from("all_interfaces", f.value)
            case "derived_from":
                return built_from("base_type_chain", f.value)
            case "attributed_with":
                return built_from("attribute_constructions", f.value)
            case "except":
                return ~F.coalesce(self.membership(f.value, "target", errors), F.lit(False))
            case "where":
                return f.value(columns_of(self.facts.types))
        raise RuleFault(f"there is no filter {f.kind}")

    def _guarded(self, f: Filter, so_far: Column, errors: list[str]) -> Column:
        name = f"p{len(self.columns)}"
        self.columns[name] = guarded(f.value, self.facts.types)(F.coalesce(so_far, F.lit(False)))
        errors.append(name)
        return so_far & F.coalesce(F.col(f"{name}.ok"), F.lit(False))

    def table(self, keep: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
        """keep and all flags (and extra columns, which may use the flags), one row per type."""
        types = self.facts.types
        if self.registered:
            types = types.join(registered_types(self.facts.registrations), types.full_name == F.col("__fqn"), "left")
        # predicates in Python come one by one, since each runs only on what the one before left
        for name in [n for n in self.columns if n.startswith("p")]:
            types = types.withColumn(name, self.columns[name])
        flagged = types.select("*", *[c.alias(n) for n, c in self.columns.items() if not n.startswith("p")])
        return flagged.select(*keep, *self.columns, *[c.alias(n) for n, c in (extra or {}).items()])


def built_from(column: str, ref: TypeRef) -> Column:
    """Whether an array of constructions holds one of a definition, or with type arguments that very one."""
    if ref.closed:
        return F.exists(column, lambda c: c.full_name == F.lit(ref.full_name))
    return F.exists(column, lambda c: (c.definition == F.lit(ref.definition)) | (c.full_name == F.lit(ref.definition)))


def registered_types(registrations: DataFrame) -> DataFrame:
    """(__fqn, __which, __lifetimes): for each registered service or implementation, its lifetimes."""
    both = registrations.select("lifetime", F.explode(F.array("service", "implementation")).alias("__fqn")).where("__fqn is not null")
    return both.groupBy("__fqn").agg(F.collect_set("lifetime").alias("__which"), F.lit(True).alias("__lifetimes"))


_RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("err", T.StringType())])


def guarded(predicate: Callable[[dict], Any], table: DataFrame, label: str = "full_name") -> Callable[[Column], Column]:
    """A Python predicate over rows, in batches: (ok, err), where a failure becomes err and the row
    doesn't hold. It isn't called where the condition that the result is applied to is false."""
    names = [c for c in table.columns if not c.startswith("__")]

    @F.pandas_udf(_RESULT)
    def run(asked: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
        ok, err = [], []
        for a, row in zip(asked, rows.to_dict("records")):
            good, why = False, None
            if a:
                try:
                    good = bool(predicate(row))
                except Exception as e:  # noqa: BLE001 - any failure of a user's predicate is a rule's fault
                    why = f"the predicate failed on {row[label]}: {type(e).__name__}: {e}"
            ok.append(good)
            err.append(why)
        return pd.DataFrame({"ok": pd.Series(ok, dtype=bool), "err": pd.Series(err, dtype=object)})

    return lambda asked: run(asked, F.struct(*[F.col(n) for n in names]))


def select_types(facts: Facts, selection: Selection, position: str = "subject") -> DataFrame:
    """The types of a selection, with all their columns."""
    scan = Scan(facts)
    flag = scan.flag(selection, position)
    return scan.table(facts.types.columns).where(flag).select(*facts.types.columns)


def member_condition(s: MemberSelection, facts: Facts) -> Column:
    """What a selection asks of the members themselves."""
    found = F.lit(True) if s.kind is None else F.col("kind") == F.lit(s.kind)
    for f in s.filters:
        match f.kind:
            case "with_suffix":
                own = F.col("name").endswith(f.value)
            case "with_prefix":
                own = F.col("name").startswith(f.value)
            case "with_name_matching":
                own = name_like(F.col("name"), f.value)
            case "returning":
                own = F.col("return_type").isin([r.definition for r in f.value])
            case "where":
                own = F.col(f"__{id(f)}.ok") if f.python else f.value(columns_of(facts.members))
            case _:
                raise RuleFault(f"there is no filter {f.kind} of members")
        found = found & F.coalesce(own, F.lit(False))
    return found


def select_members(facts: Facts, selection: MemberSelection) -> DataFrame:
    """The members of a selection, with all their columns."""
    owners = select_types(facts, selection.source).select("full_name")
    own = facts.members.join(owners, facts.members.declaring_type == owners.full_name, "left_semi")
    for f in selection.filters:
        if f.kind == "where" and f.python:
            own = own.withColumn(f"__{id(f)}", guarded(f.value, facts.members, "symbol_id")(F.lit(True)))
    return own.where(member_condition(selection, facts)).select(*facts.members.columns)


def ordered_members(members: DataFrame) -> DataFrame:
    """Members in their canonical order."""
    return members.orderBy("declaring_type", "symbol_id")


def first_error(df: DataFrame, column: str, by: str) -> Column:
    """An aggregate: the error of the first row, by name, that has one."""
    return F.min_by(F.col(f"{column}.err"), F.when(F.col(f"{column}.err").isNotNull(), F.col(by)))


def rank_within(by: list[str], order: list[Column]) -> Column:
    """row_number() over a partition."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
