"""The verdict on a rule set: violations against baselines, tripwires, and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.select import select_types
from ..schema import BASELINE, Facts
from ..session import written
from ..spec import Model, Rule
from .compile import evaluate

SLOTS = ("source", "target", "subject")


@dataclass
class Report:
    """violations has a column state (new or grandfathered) and the because of the entry that
    excuses it; warnings (rule_id, kind, message); results one row per rule, in order."""

    model: Model
    violations: DataFrame
    warnings: DataFrame
    results: DataFrame


def entries(baseline: DataFrame) -> DataFrame:
    """One entry per rule and identity: of equal ones the first by ord, or else the least because."""
    own = baseline if "ord" in baseline.columns else baseline.withColumn("ord", F.lit(0))
    w = Window.partitionBy("rule_id", *SLOTS).orderBy(F.col("ord"), F.col("because").asc_nulls_last())
    return own.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("rule_id", *SLOTS, "because")


def identified() -> Column:
    """Whether a violation has an identity that a baseline can record."""
    return F.col("id_source").isNotNull() | F.col("id_subject").isNotNull()


def ratchet(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """violations with state and entry_because: grandfathered if the baseline has their identity."""
    known = entries(baseline)
    left, right = violations.alias("v"), known.alias("b")
    same = (F.col("v.rule_id") == F.col("b.rule_id")) & F.col("v.id_source").eqNullSafe(F.col("b.source")) & F.col("v.id_target").eqNullSafe(F.col("b.target")) & F.col("v.id_subject").eqNullSafe(F.col("b.subject"))
    joined = left.join(right, same & identified(), "left")
    return joined.select("v.*", F.when(F.col("b.rule_id").isNotNull(), F.lit("grandfathered")).otherwise(F.lit("new")).alias("state"), F.col("b.because").alias("entry_because"))


def stale_entries(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Entries that no violation matches any more."""
    current = violations.where(identified()).select("rule_id", *[F.col(f"id_{s}").alias(s) for s in SLOTS]).distinct().alias("v")
    known = entries(baseline).alias("b")
    same = (F.col("v.rule_id") == F.col("b.rule_id")) & F.col("v.source").eqNullSafe(F.col("b.source")) & F.col("v.target").eqNullSafe(F.col("b.target")) & F.col("v.subject").eqNullSafe(F.col("b.subject"))
    return known.join(current, same, "left_anti")


def normal_path(path: Column, root: str = "", fold: bool = False) -> Column:
    """path with forward slashes, below root, in lower case where the file system doesn't tell."""
    own = F.translate(path, "\\", "/")
    if root:
        base = root.replace("\\", "/").rstrip("/") + "/"
        own = F.when(F.lower(own).startswith(base.lower()) if fold else own.startswith(base), F.substring(own, len(base) + 1, 1 << 30)).otherwise(own)
    return F.lower(own) if fold else own


def tripwire(facts: Facts, rule: Rule, changed: DataFrame, root: str = "", fold: bool = False) -> DataFrame:
    """(rule_id, kind, message): a warning for each changed file that declares a frozen type."""
    files = select_types(facts, rule.frozen).select(F.explode(F.array_distinct(F.transform("declaration_sites", lambda s: s.file))).alias("file")).select(normal_path(F.col("file"), root, fold).alias("file")).distinct()
    touched = changed.select(normal_path(F.col("path"), root, fold).alias("file")).distinct()
    return files.join(touched, "file", "left_semi").select(F.lit(rule.id).alias("rule_id"), F.lit("FrozenScopeTouched").alias("kind"), F.concat(F.lit("a frozen file has changed: "), F.col("file")).alias("message"))


def ordered(violations: DataFrame) -> DataFrame:
    """Violations in their canonical order, which is that of UTF-8 bytes."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return violations.orderBy("rule_id", F.coalesce("source", "subject", F.lit("")), empty("target"), empty("member_symbol_id"))


def check(facts: Facts, model: Model, baseline: DataFrame | None = None, sections: DataFrame | None = None, changed: DataFrame | None = None, root: str = "", fold: bool = False, fused: bool = True) -> Report:
    """The verdict. baseline and sections (rule_id of captured rules) are what is excused, changed
    (path) the files that differ; without it tripwires are skipped.

    A section that is there but empty is captured; a rule without a section is not, and all its
    violations are new.
    """
    spark = facts.types.sparkSession
    compiled = evaluate(facts, model.rules, fused)
    # everything below reads the violations: they're found once
    compiled.violations = written(compiled.violations, "violations")
    ratcheted = [r.id for r in model.rules if r.baseline_path]
    known = (baseline if baseline is not None else spark.createDataFrame([], BASELINE)).where(F.col("rule_id").isin(ratcheted))
    captured = (sections if sections is not None else known.select("rule_id")).where(F.col("rule_id").isin(ratcheted)).select("rule_id").distinct()
    known = known.join(captured, "rule_id", "left_semi")
    violations = ratchet(compiled.violations, known)
    stale = stale_entries(compiled.violations, known).groupBy("rule_id").agg(F.count("*").alias("stale"))
    warnings = compiled.inert.select("rule_id", F.lit("InertTarget").alias("kind"), F.lit("no type matches the target, so the rule can't be broken yet").alias("message"))
    for r in model.rules:
        if r.role == "tripwire" and changed is not None:
            warnings = warnings.unionByName(tripwire(facts, r, changed, root, fold))
    skipped = lambda r: r.role == "tripwire" and changed is None
    rules = spark.createDataFrame([(i, r.id, r.posture, r.role, skipped(r)) for i, r in enumerate(model.rules)], "ord int, rule_id string, posture string, role string, skipped boolean")
    counts = violations.groupBy("rule_id").agg(F.count_if(F.col("state") == "new").alias("violations"), F.count_if(F.col("state") == "grandfathered").alias("grandfathered"))
    warned = warnings.groupBy("rule_id").agg(F.count("*").alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = rules.join(counts, "rule_id", "left").join(stale, "rule_id", "left").join(warned, "rule_id", "left").join(captured.withColumn("captured", F.lit(True)), "rule_id", "left")
    status = F.when(F.col("skipped"), "Skipped").when(F.coalesce("violations", F.lit(0)) > 0, "Failed").otherwise("Passed")
    results = joined.select("ord", "rule_id", "posture", "role", status.alias("status"), zero("violations"), zero("grandfathered"), zero("stale"), zero("warnings"), F.coalesce("captured", F.lit(False)).alias("captured"))
    return Report(model, violations, warnings, results)


def totals(results: DataFrame) -> DataFrame:
    """One row of sums over the rules."""
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    return results.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "Passed").alias("passed"), F.count_if(F.col("status") == "Failed").alias("failed"), F.count_if(F.col("status") == "Skipped").alias("skipped"), total("violations", "violations"), total("warnings", "warnings"), total("grandfathered", "grandfathered"), total("stale", "stale"))


def promotable(results: DataFrame) -> DataFrame:
    """Migrating rules whose baseline is captured and used up: they might be enforced."""
    return results.where((F.col("posture") == "migrate") & F.col("captured") & (F.col("grandfathered") == 0) & (F.col("stale") == 0) & (F.col("violations") == 0))


def exit_code(failed: int, incomplete: bool, diagnostics: list[str] = (), advisory: tuple[str, ...] = ("NU1901", "NU1902", "NU1903", "NU1904", "NU1905")) -> int:
    """2 for facts that are incomplete, 1 for violations, else 0. Advisories of package audits don't make facts incomplete."""
    real = [d for d in diagnostics if not any(a in d for a in advisory)]
    return 2 if incomplete or real else 1 if failed else 0
