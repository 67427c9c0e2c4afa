"""Reports as text, JSON and SARIF.

Lines of sites, violations in JSON and SARIF results are made by Spark and come to the driver a
partition at a time, in the order of the report; it holds what each rule has in few lines. The
tables themselves (site_lines, violations_json, sarif_results) can be written from Spark instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.names import relative_path, symbol_display
from ..schema import Facts
from ..spec import Model, Rule
from .check import Report, ordered, totals

_MARK = {"Passed": "ok", "Failed": "BROKEN", "Skipped": "skipped"}


def message() -> F.Column:
    """What a violation says."""
    arrow = {"Reference": " references ", "Construction": " constructs ", "Injection": " takes by injection ", "Catch": " catches ", "Throw": " throws ", "Expose": " exposes "}
    out = F.coalesce("detail", F.lit(""))
    for kind, verb in arrow.items():
        out = F.when(F.col("kind") == kind, F.concat("source", F.lit(verb), "target")).otherwise(out)
    out = F.when(F.col("kind") == "MemberUse", F.concat("source", F.lit(" uses "), "member_display")).otherwise(out)
    out = F.when(F.col("kind") == "Shape", F.concat("subject", F.lit(" isn't as it must be"))).otherwise(out)
    return F.when(F.col("kind") == "MemberShape", F.concat(symbol_display(F.col("member_symbol_id")), F.lit(" isn't as it must be"))).otherwise(out)


def site_lines(violations: DataFrame, root: str = "") -> DataFrame:
    """(rule_id, state, path, line, text): a row per site, one without place for a violation without
    sites; what isn't as it must be is shown where it is declared first."""
    shown = F.when(F.col("kind").isin("Shape", "MemberShape"), F.slice("sites", 1, 1)).otherwise(F.col("sites"))
    each = violations.select("rule_id", "state", message().alias("text"), F.explode_outer(shown).alias("s"))
    return each.select("rule_id", "state", relative_path(F.col("s.file"), root).alias("path"), F.col("s.line").alias("line"), "text")


def _by_rule(rows: Iterator[Row], report: Report) -> Iterator[tuple[Rule, Row, Iterator[Row]]]:
    """Each rule with its result and those of rows, which are in the order of the rules, that are its."""
    ahead = next(rows, None)
    for r, rule in zip(report.results.orderBy("ord").collect(), report.model.rules):
        def own(rule_id: str = rule.id) -> Iterator[Row]:
            nonlocal ahead
            while ahead is not None and ahead["rule_id"] == rule_id:
                yield ahead
                ahead = next(rows, None)

        mine = own()
        yield rule, r, mine
        for _ in mine:  # what wasn't asked for
            pass


def _placed(rows: DataFrame, report: Report, *order: str) -> Iterator[Row]:
    """Rows in the order of the rules and then as given, a partition of them on the driver at a time."""
    ranks = F.create_map(*[x for i, r in enumerate(report.model.rules) for x in (F.lit(r.id), F.lit(i))]) if report.model.rules else F.lit(None)
    return rows.orderBy(ranks[F.col("rule_id")], *order).toLocalIterator()


def human_lines(report: Report, root: str = "") -> Iterator[str]:
    """The lines of human(), one after the other."""
    warned: dict[str, list[str]] = {}
    for r in report.warnings.orderBy("rule_id", "message").collect():
        warned.setdefault(r["rule_id"], []).append(f"  warning: {r['message']}")
    sites = _placed(site_lines(report.violations.where("state = 'new'"), root), report, "path", "line", "text")
    for rule, r, own in _by_rule(sites, report):
        yield f"{_MARK[r['status']]} {rule.id}" + (f": {rule.sentence}" if rule.sentence else "")
        if r["status"] == "Skipped":
            yield "  no changed files were given"
        if r["status"] == "Failed":
            yield f"  why: {rule.because}"
            if rule.fix:
                yield f"  instead: {rule.fix}"
            for s in own:
                at = f"{s['path']}({s['line']}): " if s["path"] is not None else ""
                yield f"  {at}{s['text']}"
        yield from warned.get(rule.id, [])
    t = totals(report.results).first()
    yield f"\n{t['checked']} rules: {t['passed']} hold, {t['failed']} are broken, {t['skipped']} were skipped; {t['violations']} violations, {t['warnings']} warnings."


def human(report: Report, root: str = "") -> str:
    """The report as text: a block for each rule, then the sums."""
    return "\n".join(human_lines(report, root)) + "\n"


def rule_block(report: Report, rule_id: str, root: str = "") -> str:
    """One rule's block of human()."""
    text = human(report, root).split("\n")
    start = next(i for i, x in enumerate(text) if x.split(" ")[1:2] in ([rule_id], [rule_id + ":"]))
    end = next((i for i in range(start + 1, len(text)) if not text[i].startswith("  ")), len(text))
    return "\n".join(text[start:end])


def violations_json(violations: DataFrame, root: str = "") -> DataFrame:
    """(rule_id, json): each violation as a JSON object; what it lacks is left out."""
    sites = F.transform("sites", lambda s: F.struct(relative_path(s.file, root).alias("file"), s.line.alias("line")))
    kind = F.concat(F.lower(F.substring("kind", 1, 1)), F.expr("substring(kind, 2)"))
    body = F.struct(kind.alias("kind"), "source", "target", F.when(F.col("kind") == "MemberUse", F.col("member_symbol_id")).alias("targetMember"), "subject", F.when(F.col("kind") == "MemberShape", F.col("member_symbol_id")).alias("subjectMember"), "detail", F.coalesce(sites, F.array().cast("array<struct<file:string,line:int>>")).alias("sites"))
    return ordered(violations).select("rule_id", F.to_json(body).alias("json"))


def check_json(report: Report, name: str, root: str = "", diff_base: str | None = None, diagnostics: tuple[str, ...] = ()) -> str:
    """The report as JSON."""
    warned: dict[str, list] = {}
    for r in report.warnings.orderBy("rule_id", "message").collect():
        warned.setdefault(r["rule_id"], []).append({"kind": r["kind"][0].lower() + r["kind"][1:], "message": r["message"]})
    rules = []
    found = violations_json(report.violations.where("state = 'new'"), root).toLocalIterator()
    # violations come in the order of rule ids, the report has that of the spec
    own: dict[str, list] = {}
    for r in found:
        own.setdefault(r["rule_id"], []).append(json.loads(r["json"]))
    for r, rule in zip(report.results.orderBy("ord").collect(), report.model.rules):
        body = {"id": rule.id, "posture": rule.posture, "status": r["status"].lower(), "sentence": rule.sentence, "because": rule.because, "fix": rule.fix, "skipReason": "no changed files were given" if r["status"] == "Skipped" else None}
        body["baseline"] = {"path": rule.baseline_path, "grandfathered": r["grandfathered"], "stale": r["stale"]} if rule.baseline_path else None
        rules.append({k: v for k, v in body.items() if v is not None} | {"violations": own.get(rule.id, []), "warnings": warned.get(rule.id, [])})
    t = totals(report.results).first().asDict()
    document = {"schemaVersion": 3, "solution": name, "diffBase": diff_base, "rules": rules, "diagnostics": list(diagnostics), "summary": {k: t[k] for k in ("checked", "passed", "failed", "skipped", "violations", "warnings")}}
    return json.dumps({k: v for k, v in document.items() if v is not None}, indent=2, ensure_ascii=False)


def fingerprints(violations: DataFrame, root: str = "") -> DataFrame:
    """A row per site with a fingerprint that outlives moved lines: the identity, the file, and the
    site's ordinal among the violation's sites in that file."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    each = violations.select("rule_id", "kind", "state", "entry_because", message().alias("text"), "id_source", "id_target", "id_subject", "source", "target", "subject", "member_symbol_id", F.posexplode("sites").alias("pos", "s"))
    each = each.select("*", relative_path(F.col("s.file"), root).alias("path"), F.col("s.line").alias("line"))
    w = Window.partitionBy("rule_id", "kind", "source", "target", "subject", "member_symbol_id", "path").orderBy("pos")
    each = each.withColumn("ordinal", F.row_number().over(w) - 1)
    return each.withColumn("fingerprint", F.concat_ws("|", F.lit("v1"), empty("id_source"), empty("id_target"), empty("id_subject"), F.col("path"), F.col("ordinal").cast("string")))


def sarif_results(report: Report, root: str = "") -> DataFrame:
    """(rule_id, json): a SARIF result for each site, in order, excused ones as suppressed notes."""
    new, line = F.col("state") == "new", lambda *c: F.struct(*c)
    paths = {r.id: f"recorded in {r.baseline_path}" for r in report.model.rules}
    recorded = F.create_map(*[F.lit(x) for kv in paths.items() for x in kv])[F.col("rule_id")] if paths else F.lit(None)
    place = line(line(line(F.col("path").alias("uri"), F.lit("SRCROOT").alias("uriBaseId")).alias("artifactLocation"), line(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    body = line(
        F.col("rule_id").alias("ruleId"), F.when(new, "error").otherwise("note").alias("level"), line(F.col("text").alias("text")).alias("message"), F.array(place).alias("locations"),
        line(F.col("fingerprint").alias("violation/v1")).alias("partialFingerprints"), F.when(new, "new").otherwise("unchanged").alias("baselineState"),
        F.when(~new, F.array(line(F.lit("external").alias("kind"), F.coalesce("entry_because", recorded).alias("justification")))).alias("suppressions"),
    )
    ranks = F.create_map(*[x for i, r in enumerate(report.model.rules) for x in (F.lit(r.id), F.lit(i))])[F.col("rule_id")] if paths else F.lit(0)
    empty = lambda *c: F.coalesce(*c, F.lit(""))
    rows = fingerprints(report.violations, root).orderBy(ranks, ~new, empty("source", "subject"), empty("target"), empty("member_symbol_id"), "pos")
    return rows.select("rule_id", F.to_json(body).alias("json"))


def sarif_parts(report: Report, root: str = "", complete: bool = True, diagnostics: tuple[str, ...] = ()) -> Iterator[str]:
    """The text of sarif() in parts, for a file; the driver holds one partition of results at a time."""
    rules = []
    for r in report.model.rules:
        body = {"id": r.id, "shortDescription": {"text": r.sentence} if r.sentence else None, "fullDescription": {"text": r.because}, "help": {"text": r.fix} if r.fix else None, "defaultConfiguration": {"level": "error"}, "properties": {"posture": r.posture}}
        rules.append({k: v for k, v in body.items() if v is not None})
    run = {"executionSuccessful": complete} | ({"toolExecutionNotifications": [{"message": {"text": d}, "level": "warning"} for d in diagnostics]} if diagnostics else {})
    document = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "factloom", "rules": rules}}, "invocations": [run], "originalUriBaseIds": {"SRCROOT": {}}, "results": []}]}
    head, _, tail = json.dumps(document, indent=2, ensure_ascii=False).rpartition("[]")
    yield head + "["
    some = False
    for r in sarif_results(report, root).toLocalIterator():
        yield ("," if some else "") + "\n        " + r["json"]
        some = True
    yield ("\n      ]" if some else "]") + tail + "\n"


def sarif(report: Report, root: str = "", complete: bool = True, diagnostics: tuple[str, ...] = ()) -> str:
    """The report in SARIF 2.1.0: a result for each site, excused ones as suppressed notes."""
    return "".join(sarif_parts(report, root, complete, diagnostics))


def status_lines(results: DataFrame) -> DataFrame:
    """(ord, line): how each rule stands, made by Spark."""
    n = lambda c: F.col(c).cast("string")
    mark = F.when(F.col("status") == "Failed", "BROKEN ").otherwise("ok ")
    plain = F.concat_ws(", ", F.when(F.col("violations") > 0, F.concat(n("violations"), F.lit(" broken"))), F.when(F.col("warnings") > 0, F.concat(n("warnings"), F.lit(" warned"))))
    ratchet = (
        F.when(~F.col("captured"), F.concat(F.lit("nothing captured yet, "), n("violations"), F.lit(" broken now")))
        .when(F.col("violations") > 0, F.concat(n("grandfathered"), F.lit(" excused, "), n("violations"), F.lit(" new, "), n("stale"), F.lit(" fixed")))
        .when((F.col("grandfathered") == 0) & (F.col("stale") == 0), F.when(F.col("posture") == "migrate", "none left: it can be enforced").otherwise("none left"))
        .when(F.col("grandfathered") == 0, F.concat(F.lit("none left, "), n("stale"), F.lit(" fixed and to be accepted")))
        .otherwise(F.concat(n("grandfathered"), F.lit(" excused, "), n("stale"), F.lit(" fixed")))
    )
    line = (
        F.when(F.coalesce("role", F.lit("")) == "tripwire", F.concat(F.lit("skipped "), "rule_id", F.lit(": looks at changes only")))
        .when(F.col("posture") == "enforce", F.concat(mark, "rule_id", F.when(plain != "", F.concat(F.lit(": "), plain)).otherwise("")))
        .otherwise(F.concat(mark, "rule_id", F.lit(" ("), "posture", F.lit("): "), ratchet))
    )
    return results.select("ord", line.alias("line"))


def status_json(report: Report) -> str:
    """How each rule stands, as JSON."""
    rows = [{"id": r["rule_id"], "posture": r["posture"], "status": r["status"].lower(), "violations": r["violations"], "grandfathered": r["grandfathered"], "stale": r["stale"], "captured": r["captured"]} for r in report.results.orderBy("ord").collect()]
    return json.dumps({"schemaVersion": 1, "rules": rows, "summary": totals(report.results).first().asDict()}, indent=2)


def graph_json(inside: DataFrame, outside: DataFrame, inventory: DataFrame) -> str:
    """The survey as JSON."""
    rows = lambda df: [r.asDict() for r in df.orderBy(*df.columns).collect()]
    return json.dumps({"schemaVersion": 1, "namespaces": rows(inventory), "projectEdges": rows(inside), "externalEdges": rows(outside)}, indent=2, ensure_ascii=False)


def graph_text(inside: DataFrame, outside: DataFrame, inventory: DataFrame) -> str:
    """The survey as text."""
    out = []
    for r in inventory.groupBy("project").agg(F.sum("types").alias("n"), F.array_sort(F.collect_list(F.struct("namespace", "types"))).alias("s")).orderBy("project").collect():
        out.append(f"{r['project']}: {r['n']} types")
        out += [f"  {s['namespace'] or '(global)'}: {s['types']}" for s in r["s"] if s["types"]]
    out += [f"{r[0]} -> {r[1]}: {r[2]}" for df in (inside, outside) for r in df.orderBy(*df.columns).collect()]
    return "\n".join(out) + "\n"


BEGIN, END = "<!-- factloom:begin -->", "<!-- factloom:end -->"


def splice(existing: str, body: str) -> str:
    """existing with body between the marks, which are added at the end if there are none; all
    else stays, and lines end as most of existing's do. Marks that don't pair up once are an error."""
    n, m = existing.count(BEGIN), existing.count(END)
    if n != m or n > 1 or n and existing.index(BEGIN) > existing.index(END):
        raise ValueError("the marks of the managed block don't pair up")
    many = existing.count("\r\n")
    newline = "\r\n" if 2 * many > existing.count("\n") else "\n"
    lines = newline.join(body.strip().replace("\r\n", "\n").split("\n"))
    if n:
        return existing[: existing.index(BEGIN) + len(BEGIN)] + newline + lines + newline + existing[existing.index(END) :]
    block = BEGIN + newline + lines + newline + END + newline
    return f"{existing.rstrip('\r\n')}{newline}{newline}{block}" if existing.strip() else block


def context_of(facts: Facts, model: Model, path: str, root: str = "") -> str:
    """What is to be known of a file or folder, as text: the frozen areas and the layers that it
    lies in, with their rules; a line that says where to look if it lies in none."""
    from ..operators import survey

    own = path.replace("\\", "/").rstrip("/")
    base = root.replace("\\", "/").rstrip("/")
    asked = [own] if own.startswith("/") or not base else [own, f"{base}/{own}"]
    inside = lambda places: any(not survey.covering(places.where("directory <> ''"), p).isEmpty() for p in asked)
    out = []
    by_id = {r.id: r for r in model.rules}
    for name, places in survey.frozen_places(facts, model):
        if inside(places):
            rule = by_id[f"{name}/containment"]
            out.append(f"Frozen: {name}\n{rule.sentence} {rule.because}" + (f"\nBeware: {rule.dragons or rule.dragons_doc}" if rule.dragons or rule.dragons_doc else ""))
    for name, rules, places in survey.layer_places(facts, model):
        if inside(places):
            out.append(f"Layer: {name}\n" + "\n".join(f"- `{i}`: {by_id[i].sentence} {by_id[i].because}" for i in rules))
    return "\n\n".join(out) + "\n" if out else f"Nothing frozen and no layer with rules covers '{path}'; `explain` shows a rule, `render` writes all of them.\n"


def context(model: Model) -> str:
    """The rules as text for those who write code: the map of layers, then each rule and why, then
    the terms that occur."""
    from ..prose import layer_definition

    out = ["## Architecture"] + [f"- {layer_definition(n)}" for n in model.layers.values()]
    for title, posture in (("Rules", "enforce"), ("On the move", "migrate"), ("Frozen", "freeze")):
        rows = [r for r in model.rules if r.posture == posture and r.sentence]
        out += [f"\n### {title}"] * bool(rows)
        for r in rows:
            out.append(f"- `{r.id}`: {r.sentence} {r.because}" + (f" Instead: {r.fix}" if r.fix else "") + (f" Before: {r.from_}" if r.from_ else "") + (f" Beware: {r.dragons or r.dragons_doc}" if r.dragons or r.dragons_doc else ""))
    verbs = {r.constraint.verb for r in model.rules if r.constraint}
    terms = [t for v, t in (("must_not_inject", "Injection is what constructors ask for."), ("must_not_expose", "Exposed is what public signatures name."), ("must_not_catch", "Catching is meant of the very type, not of its bases."), ("must_only_throw", "Throwing is meant of the very type.")) if v in verbs]
    return "\n".join(out + ["\n### Terms"] * bool(terms) + [f"- {t}" for t in terms]) + "\n"


def truncated(text: str, budget: int | None = None) -> str:
    """text cut to 25,000 signs, or to two and a half for each token of a client's budget."""
    most = int(budget * 2.5) if budget else 25_000
    if len(text) <= most:
        return text
    note = f"\n... {len(text) - most} signs more"
    return text[: max(0, most - len(note))] + note
