"""Commands: check, status, explain, render, baseline, graph and context, over facts written as Parquet."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import baseline as upkeep
from .operators import survey
from .plans import render
from .plans.check import Report, check, exit_code, totals
from .sources import baselines, specs
from .sources.tables import read_diagnostics, read_facts


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("factloom")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("check", "status", "explain", "render", "baseline", "graph", "context"):
        s = sub.add_parser(verb)
        s.add_argument("--facts", required=verb not in ("explain", "render"))
        s.add_argument("--root", default=".")
        if verb != "graph":
            s.add_argument("--spec", required=True)
        if verb in ("check", "graph", "status"):
            s.add_argument("--json", action="store_true")
        if verb == "check":
            s.add_argument("--sarif")
            s.add_argument("--diff-base")
            s.add_argument("--allow-workspace-diagnostics", action="store_true", help="facts with diagnostics count as complete")
        if verb == "explain":
            s.add_argument("id")
        if verb == "context":
            s.add_argument("path", help="a file or folder, below root")
        if verb == "render":
            s.add_argument("--into", required=True)
        if verb == "baseline":
            how = s.add_mutually_exclusive_group(required=True)
            how.add_argument("--init", action="store_true")
            how.add_argument("--accept-reductions", action="store_true")
            how.add_argument("--add", metavar="RULE")
            for a in ("--source", "--target", "--subject", "--because"):
                s.add_argument(a)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; the result is its exit code."""
    a = _parser().parse_args(argv)
    try:
        return _run(a, spark)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


def _run(a: argparse.Namespace, spark: SparkSession | None) -> int:
    model = specs.load(a.spec) if a.verb != "graph" else None
    if a.verb == "explain":
        found = survey.explain(model, a.id)
        if isinstance(found, list):
            print("\n".join(found))
            return 2
        print(f"{found.id} ({found.posture}): {found.sentence}\nwhy: {found.because}" + (f"\ninstead: {found.fix}" if found.fix else ""))
        return 0
    if a.verb == "render":
        path = Path(a.into)
        before = ""
        if path.exists():
            with open(path, newline="") as f:  # its line endings stay
                before = f.read()
        with open(path, "w", newline="") as f:
            f.write(render.splice(before, render.context(model)))
        return 0
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    facts = read_facts(spark, a.facts)
    if a.verb == "graph":
        parts = survey.project_edges(facts), survey.external_edges(facts), survey.namespaces(facts)
        print((render.graph_json if a.json else render.graph_text)(*parts), end="")
        return 0
    root = Path(a.root)
    if a.verb == "context":
        print(render.context_of(facts, model, a.path, str(root.resolve())), end="")
        return 0
    known, sections = baselines.load(spark, root, [r.baseline_path for r in model.rules if r.baseline_path])
    base = getattr(a, "diff_base", None)
    changed = spark.createDataFrame([(p,) for p in specs.changed_since(a.root, base)], "path string") if base else None
    report = check(facts, model, known, sections, changed, str(root.resolve()))
    if a.verb == "baseline":
        return _baseline(a, report, known, sections, root)
    if a.verb == "status":
        print(render.status_json(report) if a.json else "\n".join(r["line"] for r in render.status_lines(report.results).orderBy("ord").collect()))
        return 0
    at, said = str(root.resolve()), tuple(read_diagnostics(spark, a.facts))
    code = exit_code(totals(report.results).first()["failed"], False, () if a.allow_workspace_diagnostics else said)
    if a.sarif:
        with open(a.sarif, "w") as f:
            f.writelines(render.sarif_parts(report, at, code != 2, said))
    if a.json:
        print(render.check_json(report, root.resolve().name, at, base, said), end="")
        return code
    for line in render.human_lines(report, at):
        print(line)
    for d in said:
        print(f"diagnostic: {d}", file=sys.stderr)
    return code


def _baseline(a: argparse.Namespace, report: Report, known, sections, root: Path) -> int:
    paths = {r.id: r.baseline_path for r in report.model.rules if r.baseline_path}
    if a.init:
        known, sections = upkeep.initialise(report.violations, list(paths), sections, known)
    elif a.accept_reductions:
        known, refused = upkeep.accept_reductions(report.violations, known)
        for r in refused.collect():
            print(f"{r['rule_id']}: {r['refused']} new violations weren't added")
    else:
        known = upkeep.add_entry(report.violations, known, a.add, a.because or "", a.source, a.target, a.subject)
        sections = sections.union(sections.sparkSession.createDataFrame([(a.add,)], "rule_id string")).distinct()
    by_file: dict[str, dict] = {}
    for rule, entries in baselines.sections_of(known, sections).items():
        by_file.setdefault(paths[rule], {})[rule] = entries
    written = [p for p, rules in by_file.items() if baselines.write(root / p, rules)]
    print(json.dumps({"written": sorted(written)}))
    return 0
