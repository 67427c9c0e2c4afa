"""Upkeep of baselines: capture, accept what was fixed, add one by hand, and seal by digest."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.check import SLOTS, entries, identified

PREAMBLE = "factloom-baseline-v1"


class BaselineError(ValueError):
    """A baseline that can't be changed or read as asked."""


def identities(violations: DataFrame) -> DataFrame:
    """(rule_id, source, target, subject): what a baseline records of violations."""
    return violations.where(identified()).select("rule_id", *[F.col(f"id_{s}").alias(s) for s in SLOTS]).distinct()


def unbaselinable(violations: DataFrame) -> DataFrame:
    """(rule_id): rules with a violation that has no identity; they can't be captured."""
    return violations.groupBy("rule_id").agg(F.bool_or(~identified()).alias("x")).where("x").select("rule_id")


def initialise(violations: DataFrame, rule_ids: list[str], sections: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline and the sections, with what is broken now for those of rule_ids that have no section yet."""
    spark = violations.sparkSession
    fresh = spark.createDataFrame([(r,) for r in rule_ids], "rule_id string").join(sections, "rule_id", "left_anti").join(unbaselinable(violations), "rule_id", "left_anti")
    new = identities(violations).join(fresh, "rule_id", "left_semi").withColumn("because", F.lit(None).cast("string"))
    return baseline.select("rule_id", *SLOTS, "because").unionByName(new), sections.select("rule_id").unionByName(fresh)


def _matching(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s in SLOTS], F.col("l.rule_id") == F.col("r.rule_id"))
    return left.alias("l").join(right.alias("r"), same, how)


def accept_reductions(violations: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline without what isn't broken any more; and (rule_id, refused): what is broken but
    not in it, which is counted and not added."""
    now = identities(violations)
    kept = _matching(entries(baseline), now, "left_semi")
    captured = baseline.select("rule_id").distinct()
    refused = _matching(now, entries(baseline), "left_anti").join(captured, "rule_id", "left_semi").groupBy("rule_id").agg(F.count("*").alias("refused"))
    return kept, refused


def candidates(violations: DataFrame, rule_id: str, source: str | None = None, target: str | None = None, subject: str | None = None) -> DataFrame:
    """Identities of a rule's violations that are named so, by full name or by symbol id; a member's
    full name stands for all its overloads."""
    own = violations.where((F.col("rule_id") == rule_id) & identified())
    member = F.regexp_replace(F.regexp_replace("member_symbol_id", r"\A[TMPFE]:", ""), r"\(.*\z", "")
    if subject is not None:
        own = own.where((F.col("subject") == subject) | (F.col("id_subject") == subject) | (F.col("subject").isNull() & (member == subject)))
    else:
        own = own.where((F.col("source") == source) | (F.col("id_source") == source))
        own = own.where((F.col("target") == target) | (F.col("id_target") == target) | (F.col("target").isNull() & (member == target)))
    return identities(own)


def add_entry(violations: DataFrame, baseline: DataFrame, rule_id: str, because: str, source: str | None = None, target: str | None = None, subject: str | None = None) -> DataFrame:
    """The baseline with one violation more, and why. Exactly one identity must be named so; one
    that is there already gets the new reason."""
    if not because.strip():
        raise BaselineError("an added entry says why")
    found = candidates(violations, rule_id, source, target, subject)
    rows = found.limit(21).collect()
    if not rows:
        raise BaselineError(f"no violation of '{rule_id}' is named so")
    if len(rows) > 1:
        raise BaselineError(f"several violations of '{rule_id}' are named so, use symbol ids: {sorted(str(tuple(x for x in r[1:] if x)) for r in rows)}")
    new = found.withColumn("because", F.lit(because))
    return _matching(baseline.select("rule_id", *SLOTS, "because"), new, "left_anti").unionByName(new)


def digest_of(rules: dict[str, list[dict]]) -> str:
    """The digest of sections on the driver: rule id to entries (dictionaries of slots and because)."""
    text = PREAMBLE + "\n"
    for rule in sorted(rules):
        text += f"rule {rule}\n"
        for e in sorted(rules[rule], key=lambda e: (e.get("source") or e.get("subject") or "", e.get("target") or "")):
            text += f"subject {e['subject']}\n" if e.get("subject") else f"edge {e['source']} -> {e['target']}\n"
            text += f"because {e['because']}\n" if e.get("because") else ""
    return hashlib.sha256(text.encode()).hexdigest()
