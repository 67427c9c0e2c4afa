"""Baseline files: JSON with one section per rule, sealed by a digest."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.baseline import BaselineError, digest_of
from ..schema import BASELINE

VERSION = 1
_FORMS = ({"source", "target"}, {"subject"})


def parse(text: str, name: str = "baseline") -> dict[str, list[dict]]:
    """The sections of a file; BaselineError for another form, an unknown field, or a digest that doesn't fit."""
    try:
        d = json.loads(text)
    except ValueError as e:
        raise BaselineError(f"{name} is no JSON: {e}") from e
    if not isinstance(d, dict) or set(d) != {"schemaVersion", "digest", "rules"} or d["schemaVersion"] != VERSION:
        raise BaselineError(f"{name} isn't a baseline of version {VERSION}")
    rules: dict[str, list[dict]] = {}
    for rule, body in d["rules"].items():
        if not isinstance(body, dict) or set(body) != {"entries"}:
            raise BaselineError(f"{name}: the section of '{rule}' has other fields than entries")
        for e in body["entries"]:
            if not isinstance(e, dict) or set(e) - {"because"} not in _FORMS or not all(isinstance(v, str) and v for v in e.values()):
                raise BaselineError(f"{name}: an entry of '{rule}' is neither an edge nor a subject")
        rules[rule] = body["entries"]
    if digest_of(rules) != d["digest"]:
        raise BaselineError(f"{name} was changed by hand: its digest doesn't fit")
    return rules


def render(rules: dict[str, list[dict]]) -> str:
    """The canonical text of sections: sorted, an entry a line."""
    lines = ["{", f'  "schemaVersion": {VERSION},', f'  "digest": "{digest_of(rules)}",', '  "rules": {']
    for i, rule in enumerate(sorted(rules)):
        own = sorted(rules[rule], key=lambda e: (e.get("source") or e.get("subject") or "", e.get("target") or ""))
        body = [f"        {json.dumps({k: e[k] for k in ('source', 'target', 'subject', 'because') if e.get(k)}, ensure_ascii=False)}" for e in own]
        lines += [f"    {json.dumps(rule)}: {{", '      "entries": [' + ("" if body else "]")]
        lines += [",\n".join(body), "      ]"] if body else []
        lines.append("    }" + "," * (i < len(rules) - 1))
    return "\n".join([*lines, "  }", "}"]) + "\n"


def write(path: Path, rules: dict[str, list[dict]]) -> bool:
    """Writes sections whole or not at all; False, and nothing done, if the file says the same already."""
    text = render(rules)
    if path.exists() and path.read_text() == text:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        f.write(text)
    os.replace(temporary, path)
    return True


def load(spark: SparkSession, root: Path, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(baseline, sections) of the files that exist; an empty section is a section."""
    rows, sections = [], []
    for p in dict.fromkeys(paths):
        if (root / p).exists():
            for rule, entries in parse((root / p).read_text(), p).items():
                sections.append((rule,))
                rows += [(rule, e.get("source"), e.get("target"), e.get("subject"), e.get("because")) for e in entries]
    return spark.createDataFrame(rows, BASELINE), spark.createDataFrame(sections, "rule_id string")


def sections_of(baseline: DataFrame, sections: DataFrame) -> dict[str, list[dict]]:
    """Tables to sections, to be written; a baseline is a small file by nature."""
    out: dict[str, list[dict]] = {r[0]: [] for r in sections.select("rule_id").distinct().collect()}
    for r in baseline.collect():
        out.setdefault(r["rule_id"], []).append({k: r[k] for k in ("source", "target", "subject", "because") if r[k] is not None})
    return out
